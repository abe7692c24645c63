"""Results that must fit a number of bytes: sizes by arithmetic, and the longest part that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cut_to


def json_text_bytes(c: Column) -> Column:
    """Bytes of a text as a JSON string with its quotes, without making it: signs with a short
    escape take one more byte, other control characters five more. A null is `null`."""
    short = F.length(c) - F.length(F.translate(c, '"\\\b\f\n\r\t', ""))
    others = "".join(map(chr, [*range(8), 11, *range(14, 32)]))
    long = F.length(c) - F.length(F.translate(c, others, ""))
    return F.when(c.isNull(), 4).otherwise(F.octet_length(c) + 2 + short + 5 * long).cast("bigint")


def json_number_bytes(c: Column) -> Column:
    """Bytes of a whole number as JSON."""
    return F.when(c.isNull(), 4).otherwise(F.length(c.cast("bigint").cast("string"))).cast("bigint")


def json_object_bytes(fields: dict[str, Column]) -> Column:
    """Bytes of an object of these fields, given those of their values."""
    head = 2 + sum(len(k.encode()) + 3 for k in fields) + max(0, len(fields) - 1)
    out = F.lit(head).cast("bigint")
    for size in fields.values():
        out = out + size
    return out


def fitting_pages(items: DataFrame, by: str, order: str, size: Column, limit: int, envelope: int, cursor: Column, start: int) -> DataFrame:
    """items with `kept`, `truncated` and `next_order`: each page's longest part whose JSON fits in
    `limit` bytes. A page is `envelope` bytes, its items with commas between them, and a cursor,
    which stands for the last item that is kept (`start` bytes where none is). Cutting the page
    by an item moves the cursor to the one before it, so the cursor's size is part of what
    must fit. A page of which nothing fits keeps nothing."""
    w = Window.partitionBy(by).orderBy(order)
    x = items.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("_sum") + F.col("_n") - 1 + F.lit(envelope) + cursor <= limit
    # A later part may fit though an earlier one doesn't: cursors have sizes of their own.
    best = x.groupBy(by).agg(F.coalesce(F.max(F.when(fits, F.col("_n"))), F.lit(0)).alias("_best"), F.count(F.lit(1)).alias("_all"), F.lit(envelope + start <= limit).alias("fits"))
    last = x.join(best, by).withColumn("kept", F.col("_n") <= F.col("_best"))
    return last.withColumn("truncated", F.col("_best") < F.col("_all")).withColumn("next_order", F.max(F.when(F.col("kept"), F.col(order))).over(Window.partitionBy(by))).drop("_n", "_sum", "_best", "_all")


#: Lists of a result in the order in which their items are given up, the last item first.
GIVEN_UP = ("output_excerpt", "query_sample", "diagnostics")
_TRUE, _FALSE = 4, 5


def fitted_results(heads: DataFrame, items: DataFrame, by: str, limit: Column, least_headline: int = 96, least_command: int = 32) -> tuple[DataFrame, DataFrame]:
    """heads(by, headline, command, base: bytes of all the rest with `truncated` false and empty
    lists) and items(by, list, position, size) -> heads with headline, command, truncated and
    bytes, and the items that stay. Items go from the end of the excerpt, then of the sample,
    then of the diagnostics; where that isn't enough the headline and then the command are cut
    by a fourth again and again. bytes is over the limit where nothing helps."""
    rank = F.lit(len(GIVEN_UP))
    for k, name in enumerate(GIVEN_UP):
        rank = F.when(F.col("list") == name, len(GIVEN_UP) - k).otherwise(rank)
    kept_first = Window.partitionBy(by).orderBy("_rank", "position")
    own = Window.partitionBy(by, "list").orderBy("position")
    x = items.withColumn("_rank", rank).withColumn("_comma", (F.row_number().over(own) > 1).cast("bigint"))
    x = x.withColumn("_sum", F.sum(F.col("size") + F.col("_comma")).over(kept_first.rowsBetween(Window.unboundedPreceding, 0)))
    h = heads.withColumn("_fixed", F.col("base") + json_text_bytes(F.col("headline")) + json_text_bytes(F.col("command"))).withColumn("_limit", limit)
    room = h.select(F.col(by).alias("_by"), (F.col("_limit") - F.col("_fixed")).alias("_room"))
    x = x.join(room, F.col(by) == F.col("_by")).drop("_by")
    total = F.max("_sum").over(Window.partitionBy(by))
    # Where not all fit the last one goes, even if the shorter `true` makes room for it.
    x = x.withColumn("kept", (total <= F.col("_room")) | ((F.col("_sum") <= F.col("_room") + (_FALSE - _TRUE)) & (F.col("_sum") < total)))
    sums = x.groupBy(F.col(by).alias("_by")).agg(F.max(F.when(F.col("kept"), F.col("_sum"))).alias("_used"), F.bool_or(~F.col("kept")).alias("_cut"))
    h = h.join(sums, F.col(by) == F.col("_by"), "left").drop("_by").fillna(0, ["_used"])
    h = h.withColumn("_over", F.col("_fixed") + F.col("_used") > F.col("_limit"))
    h = h.withColumn("truncated", F.coalesce(F.col("_cut"), F.lit(False)) | F.col("_over"))
    h = h.withColumn("_rest", F.col("base") + F.col("_used") - F.when(F.col("truncated"), _FALSE - _TRUE).otherwise(0))
    # Only heads that are too long by themselves are cut.
    over = lambda a, b: F.col("_rest") + json_text_bytes(a) + json_text_bytes(b) > F.col("_limit")

    def shorter(c: Column, least: int) -> Column:
        return F.concat(cut_to(c, F.greatest((F.octet_length(c) * 3 / 4).cast("int"), F.lit(least))), F.lit("…"))

    def step(s: Column, _: Column) -> Column:
        a, b = s["headline"], s["command"]
        # What the ellipsis makes no shorter stays.
        cuts = lambda c, least: (F.octet_length(c) > least) & (F.octet_length(shorter(c, least)) < F.octet_length(c))
        return (F.when(over(a, b) & cuts(a, least_headline), F.struct(shorter(a, least_headline).alias("headline"), b.alias("command")))
                .when(over(a, b) & cuts(b, least_command), F.struct(a.alias("headline"), shorter(b, least_command).alias("command"))).otherwise(s))

    heads = F.struct(F.col("headline").alias("headline"), F.col("command").alias("command"))
    h = h.withColumn("_heads", F.when(over(F.col("headline"), F.col("command")), F.aggregate(F.sequence(F.lit(1), F.lit(CUTS)), heads, step)).otherwise(heads))
    h = h.withColumn("headline", F.col("_heads.headline")).withColumn("command", F.col("_heads.command"))
    h = h.withColumn("bytes", F.col("_rest") + json_text_bytes(F.col("headline")) + json_text_bytes(F.col("command")))
    return h.drop("_fixed", "_limit", "_used", "_cut", "_over", "_rest", "_heads"), x.where("kept").drop("_rank", "_comma", "_sum", "_room", "kept")


#: Cuts by a fourth that bring two texts of any length to their least.
CUTS = 160
