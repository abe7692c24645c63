"""Operators for training-data pipelines. Nothing outside this folder (but the
guarded part of ``__spark_entry__``) imports it."""
