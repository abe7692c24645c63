"""Filtered pages with cursors. A page is a DataFrame; its cursor is data of its last row."""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_first(df: DataFrame, ms: str, key: str, limit: int, after: tuple | None = None, where: Column | None = None, scan: int | None = None) -> DataFrame:
    """The next rows in descending (ms, key), at most `limit` of those that pass `where` among
    the next `scan` rows. Both limits are top-k, so nothing is sorted as a whole."""
    rows = df if after is None else df.where((F.col(ms) < after[0]) | ((F.col(ms) == after[0]) & (F.col(key) < after[1])))
    if scan is not None:
        rows = rows.orderBy(F.desc(ms), F.desc(key)).limit(scan)
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(F.desc(ms), F.desc(key)).limit(limit)


def by_ordinal(df: DataFrame, limit: int, after: int = -1, where: Column | None = None, scan: int | None = None, order: str = "ordinal") -> DataFrame:
    rows = df.where(F.col(order) > after)
    if scan is not None:
        rows = rows.orderBy(order).limit(scan)
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(order).limit(limit)


def scanned_page(df: DataFrame, limit: int, after: int, where: Column, scan: int, order: str = "ordinal") -> DataFrame:
    """The rows that a page reads, with `hit` (part of the page), `truncated` (more may follow)
    and `next` (the last row that was read, if so). It reads at most `scan` rows beyond
    `after` and ends before a hit that finds the page full, so a page may be empty and still
    have a next one. Only scan + 1 rows, taken by top-k, meet in one task."""
    rows = df.where(F.col(order) > after).orderBy(order).limit(scan + 1).withColumn("hit", F.coalesce(where, F.lit(False)))
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    x = rows.withColumn("_k", F.row_number().over(w)).withColumn("_hits", F.sum(F.col("hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_ends", (F.col("_k") > scan) | (F.col("hit") & (F.col("_hits") > limit)))
    x = x.withColumn("_over", F.max("_ends").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("truncated", F.max("_ends").over(Window.partitionBy(F.lit(0))))
    read = x.where(~F.col("_over"))
    last = F.max(order).over(Window.partitionBy(F.lit(0)))
    return read.withColumn("next", F.when(F.col("truncated"), last)).drop("_k", "_hits", "_ends", "_over")


def context(*parts: str) -> bytes:
    """16 bytes that tie a cursor to the query it came from."""
    raw = b"".join(struct.pack("<Q", len(p.encode())) + p.encode() for p in parts)
    return hashlib.sha256(raw).digest()[:16]


class InvalidCursor(ValueError):
    pass


def encode_cursor(kind: int, ctx: bytes, *payload: int) -> str:
    raw = bytes([1, kind]) + ctx + b"".join(struct.pack("<q", p) for p in payload)
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode_cursor(cursor: str, kind: int, ctx: bytes) -> tuple[int, ...]:
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    except ValueError as e:
        raise InvalidCursor(cursor) from e
    if len(raw) < 18 or (len(raw) - 18) % 8 or raw[:2] != bytes([1, kind]) or raw[2:18] != ctx:
        raise InvalidCursor(cursor)
    return struct.unpack(f"<{(len(raw) - 18) // 8}q", raw[18:])


def evidence_pages(records: DataFrame, requests: DataFrame, context_lines: int = 1, raised: bool = True) -> DataFrame:
    """A page of evidence for each of many requests at once: request, items (position and text,
    in order), truncated, next (the record to go on from, if so). records(inv, position, label,
    text) with positions 0, 1, ... in each inv; requests(request, inv, start, items, scan,
    filter, test_log).

    A record is a hit where its text or label holds the filter, without regard to the case of
    A-Z (a null holds nothing); in test logs also beside such a record of the same label (null labels are one). A page
    has 1 to 100 items and reads at most `scan` records (10,000 at most; where raised, never
    fewer than items, else as many as are asked for, though the page then can't fill); it ends before a hit that finds it full. A request for a run without records has an
    empty page. Only the records that a page may read meet in a task, however long a log is."""
    from ..functions.text import ascii_lower

    items = F.least(F.greatest(F.col("items"), F.lit(1)), F.lit(100))
    scan = F.least(F.greatest(F.col("scan"), *([F.col("items")] if raised else []), F.lit(1)), F.lit(10_000))
    asked = requests.select("request", F.col("inv").alias("_inv"), F.coalesce("start", F.lit(0)).cast("bigint").alias("start"), items.alias("_items"), scan.alias("_scan"), ascii_lower(F.col("filter")).alias("_filter"), F.coalesce("test_log", F.lit(False)).alias("_test"))
    near = F.col("position").between(F.col("start") - context_lines, F.col("start") + F.col("_scan") + context_lines)
    rows = records.join(asked, (F.col("inv") == F.col("_inv")) & near)
    says = [F.coalesce(F.contains(ascii_lower(F.col(c)), F.col("_filter")), F.lit(False)) for c in ("text", "label")]
    w = Window.partitionBy("request").orderBy("position")
    own = rows.withColumn("_own", F.col("_filter").isNull() | says[0] | says[1])
    beside = [F.coalesce(step("_own", n).over(w) & step(F.struct("label"), n).over(w).eqNullSafe(F.struct("label")), F.lit(False)) for step in (F.lag, F.lead) for n in range(1, context_lines + 1)]
    hit = F.col("_own")
    for b in beside:
        hit = hit | (F.col("_test") & b)
    read = own.withColumn("_hit", hit).where(F.col("position").between(F.col("start"), F.col("start") + F.col("_scan")))
    counted = read.withColumn("_hits", F.sum(F.col("_hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("position") - F.col("start") >= F.col("_scan")
    ends = over | (F.col("_hit") & (F.col("_hits") > F.col("_items")))
    item = F.when(F.col("_hit") & ~ends, F.struct("position", "text"))
    pages = counted.groupBy("request").agg(F.sort_array(F.collect_list(item)).alias("found"), F.min(F.when(ends, F.col("position"))).alias("next"))
    none = F.array().cast("array<struct<position:bigint,text:string>>")
    return requests.select("request").join(pages, "request", "left").select("request", F.coalesce(F.col("found").cast("array<struct<position:bigint,text:string>>"), none).alias("items"), F.col("next").isNotNull().alias("truncated"), F.col("next").cast("bigint").alias("next"))
