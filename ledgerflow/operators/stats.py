"""Paired comparison, nearest-rank percentiles and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import reduction_percent

# Fixed values of the generators.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LCG_FACTOR, LCG_STEP = 6364136223846793005, 1442695040888963407
MASK = (1 << 64) - 1
RESAMPLES = 4000
#: Draws that are made at once, and tasks over which a group's resamples are dealt.
PIECE, BLOCKS = 1 << 20, 16


def nearest_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    kind = dict(df.dtypes)[value]
    p = lambda q: F.expr(f"cast(percentile_disc({q}) within group (order by {value}) as {kind})")
    return df.groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("median"), p(0.95).alias("p95"))


def paired(base: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each pair; a key that one side lacks or repeats is an error."""
    b = base.groupBy(*keys).agg(F.count("*").alias("_nb"), F.first(value).alias("base"))
    n = new.groupBy(*keys).agg(F.count("*").alias("_nn"), F.first(value).alias("new"))
    both = b.join(n, keys, "full")
    ok = (F.col("_nb") == 1) & (F.col("_nn") == 1)
    return both.withColumn("_ok", F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit("a sample has no pair")).cast("boolean"))).where("_ok").drop("_ok", "_nb", "_nn")


def paired_or_alone(base: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key of either side, with null for the side that lacks it."""
    b, n = base.select(*keys, F.col(value).alias("base")), new.select(*keys, F.col(value).alias("new"))
    return b.join(n, keys, "full")


def compare(pairs: DataFrame, by: str) -> DataFrame:
    """Reduction of sums, over all (null group) and by group."""
    out = pairs.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count("*").alias("pairs"), F.sum("base").alias("base"), F.sum("new").alias("new"))
    return out.withColumn("reduction", F.round(reduction_percent(F.col("base").cast("double"), F.col("new").cast("double")), 6))


def seed(label: str) -> int:
    h = FNV_BASIS
    for b in label.encode():
        h = (h ^ b) * FNV_PRIME & MASK
    return max(h, 1)


def jumped(state: int, steps: int) -> int:
    """The state that many steps on."""
    a, b, fa, fb = 1, 0, LCG_FACTOR, LCG_STEP
    while steps:
        if steps & 1:
            a, b = fa * a & MASK, fa * b + fb & MASK
        fa, fb = fa * fa & MASK, fa * fb + fb & MASK
        steps >>= 1
    return a * state + b & MASK


def draws_from(state: int, total: int, n: int, high: bool = False) -> np.ndarray:
    """The next indexes below n. The state after k steps is A[k]*state + B[k], so all of
    them are made at once."""
    a = np.cumprod(np.full(total, LCG_FACTOR, np.uint64))
    b = np.concatenate([np.ones(1, np.uint64), a[:-1]]).cumsum(dtype=np.uint64) * np.uint64(LCG_STEP)
    states = a * np.uint64(state) + b
    return ((states >> np.uint64(32) if high else states) % np.uint64(n)).astype(np.int64)


def draws(label: str, n: int, resamples: int = RESAMPLES, high: bool = False) -> np.ndarray:
    """Indexes of each resample of n; high: from the high 32 bits of the state."""
    return draws_from(seed(label), n * resamples, n, high).reshape(resamples, n)


def share(b, n):
    return np.where(b == 0, 0.0, 100.0 * (b - n) / np.where(b == 0, 1, b))


def estimates(base: np.ndarray, new: np.ndarray, label: str, first: int, last: int, high: bool = False) -> np.ndarray:
    """Reductions of the resamples from first to before last, PIECE draws at a time."""
    n, start = len(base), seed(label)
    sums, rows = np.zeros((2, last - first)), max(1, PIECE // n)
    for r in range(first, last, rows):
        m = min(rows, last - r)
        for k in range(0, n, PIECE):  # more than once only if a resample is longer than that
            w = min(PIECE, n - k)
            at = draws_from(jumped(start, r * n + k), m * w, n, high).reshape(m, w)
            sums[:, r - first:r - first + m] += base[at].sum(1), new[at].sum(1)
    return share(*sums)


def bootstrap(base: np.ndarray, new: np.ndarray, label: str, high: bool = False) -> tuple[float, float, float]:
    """Reduction and the ends of its 95 % interval."""
    est = np.sort(estimates(base, new, label, 0, RESAMPLES, high))
    k = lambda p: -(-RESAMPLES * p // 1000) - 1
    return float(share(base.sum(), new.sum())), float(est[k(25)]), float(est[k(975)])


def bootstrap_by(pairs: DataFrame, by: str, order: list[str], high: bool = False) -> DataFrame:
    """by, value, low, high: each group's pairs (samples of one experiment). Its resamples
    are dealt over BLOCKS tasks, of which each holds the group's pairs."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        base, new, k = p["base"].to_numpy(float), p["new"].to_numpy(float), int(p["_block"].iloc[0])
        est = estimates(base, new, str(p[by].iloc[0]), RESAMPLES * k // BLOCKS, RESAMPLES * (k + 1) // BLOCKS, high)
        return pd.DataFrame({by: [p[by].iloc[0]], "value": [float(share(base.sum(), new.sum()))], "est": [est]})

    kind = dict(pairs.dtypes)[by]
    dealt = pairs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    blocks = dealt.groupBy(by, "_block").applyInPandas(run, f"{by} {kind}, value double, est array<double>")
    all_ = blocks.groupBy(by).agg(F.first("value").alias("value"), F.sort_array(F.flatten(F.collect_list("est"))).alias("est"))
    rank = lambda p: F.element_at("est", -(-RESAMPLES * p // 1000))
    return all_.select(by, "value", rank(25).alias("low"), rank(975).alias("high"))


def bootstrap_clusters(pairs: DataFrame, by: str, cluster: str) -> DataFrame:
    """As bootstrap_by, but whole clusters are drawn: each adds all its pairs, so that only
    its sums go to the draws, in order of the clusters' keys."""
    sums = pairs.groupBy(by, cluster).agg(F.sum("base").alias("base"), F.sum("new").alias("new"))
    return bootstrap_by(sums, by, [cluster], high=True)


#: Places of a percentile p among n sorted values, counted from 0, by the name of the rule.
PLACES = {
    "nearest": lambda n, p: F.greatest(F.ceil(n * p / 100) - 1, F.lit(0)),
    "lower": lambda n, p: F.floor((n - 1) * p / 100),
    "rounded": lambda n, p: F.floor((n - 1) * p / 100 + 0.5),
}


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """by, n and for each name of wanted the value at that rule's place. Equal values are
    counted before they are sorted; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    x = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    pick = [F.min(F.when(F.col("_upto") > PLACES[rule](F.col("_n"), F.lit(p)), F.col(value))).alias(name) for name, (rule, p) in wanted.items()]
    return x.groupBy(*by).agg(F.max("_n").alias("n"), *pick)


def arms(pairs: DataFrame, by: str) -> DataFrame:
    """Two arms of paired rounds: interpolating medians of each and of the improvements in
    percent, and the least improvement. A base of 0 counts as no improvement."""
    better = reduction_percent(F.col("base").cast("double"), F.col("new").cast("double"))
    return pairs.groupBy(by).agg(F.count("*").alias("rounds"), F.median("base").alias("base_median"), F.median("new").alias("new_median"), F.round(F.median(better), 6).alias("median_improvement"), F.round(F.min(better), 6).alias("least_improvement"))
