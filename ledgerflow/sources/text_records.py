"""Records in text: rows of a text, its tail, and line coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio_percent
from ..operators.events import filled


def rows_in(text: Column) -> Column:
    """How many rows a text has; the last one needs no line feed. Null and empty: 0."""
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(feeds + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0), F.lit(0)).cast("bigint")


def tail(content: Column, most: int) -> Column:
    """The last `most` bytes of a binary value; null gives none."""
    return F.coalesce(F.when(F.octet_length(content) <= most, content).otherwise(F.substring(content, -most, most)), F.lit(b""))


def lcov(lines: DataFrame, by: str, order: str = "ordinal", line: str = "line") -> DataFrame:
    """by, path, found, hit, percent of ordered lines; the row with a null path is the total of
    each `by`. Hits before the first file count nowhere; a number that isn't one is an error."""
    c = F.col(line)
    some = lines.where(c.startswith("SF:") | c.startswith("DA:"))
    x = filled(some, by, order, F.when(c.startswith("SF:"), F.substring(c, 4, 1 << 30)), "path").where(c.startswith("DA:"))
    fields = F.split(F.substring(c, 4, 1 << 30), ",", -1)
    number = lambda k: F.when(F.get(fields, k).rlike("^[0-9]+$"), F.get(fields, k)).otherwise(F.raise_error(F.lit("a coverage record has no number"))).cast("decimal(20,0)")
    y = x.select(by, "path", (number(1) > 0).alias("_hit"), (number(0) >= 0).alias("_ok")).where("_ok and path is not null")
    out = y.groupingSets([[F.col(by)], [F.col(by), F.col("path")]], F.col(by), F.col("path")).agg(F.count("*").alias("found"), F.count_if("_hit").alias("hit"))
    return out.withColumn("percent", F.round(ratio_percent(F.col("hit").cast("double"), F.col("found").cast("double")), 6))
