"""Whitening of embeddings by their principal components, from a covariance by polarisation.

Entries become whole numbers, so sums are exact whatever the order of the rows. One pass
counts the vectors and sums each dimension; a second sums, for each dimension and each sum of
two dimensions, the squares of the values centred by n (n*x - S, a whole number too). The
variances of x_i, x_j and x_i + x_j give each covariance as (V(i+j) - V(i) - V(j)) / 2,
divided only once, on the driver, which holds nothing but the D x D matrix for eigh. A third
pass measures the covariance of the whitened vectors, the last one writes them.

Every pass is a map over Arrow batches with sums combined in each task: a task sends
D * (D + 1) / 2 numbers at most, whatever its rows; nothing is shuffled but these.

Cases: a null vector and one with a null, NaN or infinite entry is dropped. Vectors of
another length than most have (of equally frequent lengths the longest counts) can't be in
the fit list and are dropped too; so is an empty vector. Null, equal and repeated vec_ids
give rows each. An x beyond a long is the nearest long; a deviation beyond a long is null. A
component whose eigenvalue is 0 up to rounding has no whitened value (null) and isn't in
identity_error. An empty table gives no rows; further columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Numbers of a slice of rows that are worked on at once.
SLICE = 1 << 18
#: Whole numbers travel as four limbs of 40 bits, the highest signed, whose sums are exact.
LIMB, LIMBS = 40, 4
_SUMS = "i int, j int, l0 bigint, l1 bigint, l2 bigint, l3 bigint"
_TOP = 2**63 - 1


def _limbs(v: int) -> list[int]:
    return [v >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS - 1)] + [v >> LIMB * (LIMBS - 1)]


def _whole(limbs) -> int:
    return sum(int(x) << LIMB * k for k, x in enumerate(limbs))


def vectors(batch: pa.RecordBatch, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and x (rows by dimensions) of the rows that stay, by the length of the vectors or
    of this length alone; slices of about SLICE numbers."""
    col = batch.column("embedding")
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    for d in [size] if size else sorted({*lengths.tolist()} - {-1, 0}):
        rows = np.flatnonzero(lengths == d)
        for a in range(0, len(rows), max(1, SLICE // d)):
            at = pa.array(rows[a:a + max(1, SLICE // d)])
            flat = col.take(at).flatten()
            c = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, d)
            good = np.isfinite(c).all(axis=1)
            if good.any():
                c = np.floor(SCALE * c[good])
                # Small ones are longs, the others whole numbers of any size.
                small = np.abs(c).max() < 2.0**40
                x = c.astype(np.int64) + SHIFT if small else np.vectorize(lambda v: max(-_TOP - 1, min(_TOP, (int(v) if abs(v) < 1e300 else int(np.sign(v)) << 80) + SHIFT)), otypes=[object])(c)
                yield batch.column("vec_id").take(at).filter(pa.array(good)), x


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as longs where all of their sums' squares are sure to be longs."""
    if x.dtype != object:
        most = n * max(int(np.abs(x).max()), 1) + max(map(abs, sums))
        if most < 2**62:
            y = n * x - np.array(sums, np.int64)
            # The sum over rows and dimensions of (y_i + y_j)^2 must be a long.
            if (2 * int(np.abs(y).max())) ** 2 * y.size < 2**62:
                return y
            x = x.astype(object)
        else:
            x = x.astype(object)
    return n * x - np.array(sums, object)


def _summed(rows: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Whole numbers by (i, j) as limbs."""
    limbs = [_limbs(v) for v in rows.values()]
    cols = [pa.array([k[0] for k in rows], pa.int32()), pa.array([k[1] for k in rows], pa.int32())]
    cols += [pa.array([x[k] for x in limbs], pa.int64()) for k in range(LIMBS)]
    return pa.RecordBatch.from_arrays(cols, ["i", "j", "l0", "l1", "l2", "l3"])


def _totals(df: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks; as many rows as there are pairs (i, j)."""
    return {(r[0], r[1]): _whole(r[2:]) for r in df.groupBy("i", "j").agg(*(F.sum(f"l{k}") for k in range(LIMBS))).collect()}


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension of x, over the vectors of the most frequent length."""

    def run(batches):
        found: dict[tuple[int, int], int] = {}
        for b in batches:
            for _, x in vectors(b):
                d = x.shape[1]
                found[d, -1] = found.get((d, -1), 0) + len(x)
                for k, s in enumerate(x.sum(axis=0).tolist() if x.dtype == object else x.sum(axis=0, dtype=np.int64).tolist()):
                    found[d, k] = found.get((d, k), 0) + s
        yield _summed(found)

    # i is the length, j the dimension (-1: how many).
    found = _totals(map_arrow(rows, run, _SUMS))
    counts = {d: v for (d, k), v in found.items() if k < 0}
    if not counts:
        return 0, []
    d = max(counts, key=lambda d: (counts[d], d))
    return counts[d], [found[d, k] for k in range(d)]


def squares_of(rows: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """For each dimension (i, i) the sum of the squares of n*x_i - S_i, for each pair i < j
    that of the squares of their sum; exact."""
    size = len(sums)

    def run(batches):
        total = [[0] * (size - i) for i in range(size)]
        for b in batches:
            for _, x in vectors(b, size):
                y = np.ascontiguousarray(_centred(x, n, sums).T)
                for i in range(size):
                    pair = y[i + 1:] + y[i]
                    own = [(y[i] * y[i]).sum(), *(pair * pair).sum(axis=1).tolist()]
                    total[i] = [a + int(v) for a, v in zip(total[i], own)]
        yield _summed({(i, i + k): v for i, row in enumerate(total) for k, v in enumerate(row)})

    return _totals(map_arrow(rows, run, _SUMS))


def covariance(squares: dict[tuple[int, int], int], n: int, size: int) -> np.ndarray:
    """V with divisor n: differences of variances, divided once."""
    v = np.empty((size, size))
    for i in range(size):
        v[i, i] = squares[i, i] / n**3
        for j in range(i + 1, size):
            v[i, j] = v[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest and their unit vectors as columns; what is 0 up to rounding is 0."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    e = np.where(e > len(e) * np.finfo(float).eps * max(e[0], 0), e, 0.0)
    return e[:most], u[:, :most]


def whitened(table: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    vector that stays and each of the first `most` components."""
    spark = table.sparkSession
    rows = table.selectExpr("cast(vec_id as bigint) vec_id", "embedding")
    n, sums = sums_of(rows)
    if not n:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    size = len(sums)
    v = covariance(squares_of(rows, n, sums), n, size)
    e, u = components(v, most)
    trace = float(np.trace(v))
    scale = np.divide(1, np.sqrt(e), out=np.zeros_like(e), where=e > 0)

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(x, n, sums)
        near = (y / n).astype(float)
        return y, near @ u * scale

    def measure(batches):
        total, first = np.zeros((len(e), len(e))), np.zeros(len(e))
        for b in batches:
            for _, x in vectors(b, size):
                z = projected(x)[1]
                total += z.T @ z
                first += z.sum(axis=0)
        both = np.vstack([total, first])
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel())], ["i", "j", "v"])

    moments = np.zeros((len(e) + 1, len(e)))
    for r in map_arrow(rows, measure, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        moments[r[0], r[1]] = r[2]
    live = e > 0
    moments /= n
    off = np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(e)))[np.ix_(live, live)]
    error = float(off.max()) if live.any() else 0.0

    def project(batches):
        for b in batches:
            for ids, x in vectors(b, size):
                y, z = projected(x)
                wide = y.dtype == object or float(np.abs(y).max()) ** 2 * size >= 2.0**63
                far = (y.astype(object) ** 2).sum(axis=1).tolist() if wide else (y * y).sum(axis=1).tolist()
                z = pa.array(np.where(live, z, np.nan).ravel(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([f if f <= _TOP else None for f in far], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(e), pa.int32()), z)],
                    ["vec_id", "deviation", "z"])

    shares = F.array(*(F.lit(float(x / trace) if trace > 0 else 0.0) for x in e))
    out = map_arrow(rows, project, "vec_id bigint, deviation bigint, z array<double>").select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
