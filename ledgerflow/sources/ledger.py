"""The ledger's folders: a manifest for each run, under its day and shard.

A run's folder is <root>/invocations/<day>/<shard>/<id>: day and shard follow from the id (a
UUIDv7: 48 bits of milliseconds first; the shard is the last digit). A manifest is read by
its version, and what can't be read is an error of its own, never a row of defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def folder_of(run: Column) -> Column:
    """day/shard/id of a run's id."""
    ms = F.conv(F.substring(F.replace(run, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")
    day = F.lpad(F.lower(F.hex(F.floor(ms / 86_400_000).cast("bigint"))), 8, "0")
    return F.concat_ws("/", day, F.concat(F.lit("0"), F.substring(run, -1, 1)), run)


def decoded(content: Column, schema: str, required: tuple[str, ...]) -> Column:
    """(record, error) of a manifest's text. error is `unsupported N` for another version, even if
    nothing else of it can be read, and `corrupt` for what isn't JSON of the schema or lacks one
    of the required fields (paths with dots)."""
    version = F.from_json(content, "schema_version bigint")["schema_version"]
    record = F.from_json(content, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    lacks = record.isNull() | record["_broken"].isNotNull()
    for path in required:
        field = record
        for name in path.split("."):
            field = field[name]
        lacks = lacks | field.isNull()
    error = F.when(version != VERSION, F.concat(F.lit("unsupported "), version.cast("string"))).when(version.isNull() | lacks, "corrupt")
    return F.struct(F.when(error.isNull(), record.dropFields("_broken")).alias("record"), error.alias("error"))


def manifests(files: DataFrame, schema: str, run_id: str, required: tuple[str, ...] = ()) -> DataFrame:
    """path, id, bytes, record, error of files(path, content). run_id: where a record holds its id.
    Beside the errors of `decoded`: `not a run` where the folder's name is no id, `misplaced`
    outside of the id's day or shard, `another id` where the record has another one."""
    parts = F.split("path", "/")
    run = F.try_element_at(parts, F.lit(-2))
    at = F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), 3))
    rows = files.select("path", run.alias("id"), F.octet_length("content").cast("bigint").alias("bytes"), at.alias("_at"), decoded(F.col("content").cast("string"), schema, (*required, run_id)).alias("_x"))
    own = F.col("_x.record")
    for name in run_id.split("."):
        own = own[name]
    error = (F.when(~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), "not a run").when(F.col("_at") != folder_of(F.col("id")), "misplaced")
             .otherwise(F.coalesce("_x.error", F.when(own != F.col("id"), "another id"))))
    return rows.withColumn("error", error).select("path", "id", "bytes", F.when(F.col("error").isNull(), F.col("_x.record")).alias("record"), "error")


def load_ledger(spark: SparkSession, root: str, schema: str, run_id: str, required: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """manifests() of all runs below root. Folders without a manifest were never committed and give no
    row, and neither do manifests of no bytes, which Spark's readers pass over. strict: the first error ends the query, as a ledger that is read in part must not be
    taken for the whole; else errors are rows."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/invocations/*/*/*/manifest.json").select("path", "content")
    rows = manifests(files, schema, run_id, required)
    if not strict:
        return rows
    # The check stands in the column itself, so that no plan can leave it out.
    told = F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")
    return rows.withColumn("id", F.when(F.col("error").isNotNull(), told).otherwise(F.col("id"))).drop("error")
