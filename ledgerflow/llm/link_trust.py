"""URL filters: rules first, then trust and distrust that spread over host links.

Trust starts at the hosts of urls that an allow rule fits and follows links; distrust
starts at the hosts of urls that a block rule fits and follows them backwards (who links
to a blocked host becomes suspect). Both are personalised PageRank over host edges,
weighted by their number of links. A host that no rule decides is blocked when the
distrust it *received* is at least MARGIN of what it received in all, and at least
LEAST of one host's even share; its own seed counts for others only, since a rule
about /de/ says nothing of the rest of a host.

Each row says what its verdict rests on: `rule`, `rank` (its host received trust or
distrust over links) or `none`: no link of other hosts reached it, so it is allowed.
Relative links lead to their own host and tell nothing about it.

Cases: a null url, or one without ://, has an empty host and path, fits no rule and is
allowed; a null html has no links; hosts without links receive nothing and are allowed;
of equally long fitting rules a block rule wins; rows that repeat get equal rows (and
their links count again); html of any length is searched whole by Spark's expressions; an
empty table gives no rows; columns other than page_id, url and html are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_group, written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 12
MARGIN = 0.5
LEAST = 0.01
LINK = r"(?i)<(?:a|area)\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/\"'?#\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return _lower(raw), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host and the rank it received by way of edges(src, dst, w) from seeds(host, seed)."""
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("w").alias("_all"))
    steps = written(spark, edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("_all")).alias("p")), "steps")
    total = seeds.agg(F.sum("seed")).first()[0] or 0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("received")).limit(0)
    start = seeds.select("host", (F.col("seed") / F.lit(float(total))).alias("seed"))
    rank = start.select("host", F.col("seed").alias("rank"))
    received = None
    for k in range(rounds):
        moved = steps.join(rank, steps["src"] == rank["host"]).groupBy("dst").agg((F.sum(F.col("rank") * F.col("p")) * damping).alias("received"))
        received = moved.withColumnRenamed("dst", "host")
        if k % 3 == 2 or k == rounds - 1:
            received = written(spark, received, "rank")
        rank = received.join(start, "host", "full").select("host", (F.coalesce("received", F.lit(0.0)) + (1 - damping) * F.coalesce("seed", F.lit(0.0))).alias("rank"))
    return received


def host_scores(pages: DataFrame, judged: DataFrame) -> DataFrame | None:
    """host, trust, distrust for hosts that received any; None if no host links to another."""
    spark = pages.sparkSession
    host, _ = host_and_path(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", _lower(F.regexp_replace("dst", r"^[^@]*@", "")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    edges = written(spark, links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "edges")
    if edges.isEmpty():
        return None
    seeds = written(spark, judged.where("rule is not null").groupBy("host", "rule_verdict").agg(F.count("*").cast("double").alias("seed")), "seeds")
    trust = spread(edges, seeds.where("rule_verdict = 'allow'")).withColumnRenamed("received", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = spread(back, seeds.where("rule_verdict = 'block'")).withColumnRenamed("received", "distrust")
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, distrusted, evidence, trust and distrust of each
    row of pages (trust and distrust in shares of one host's even share; null without any)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = (pages.select("page_id", "url").withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
              .withColumn("rule", name).withColumn("rule_verdict", verdict).drop("url"))
    scores = host_scores(pages, judged)
    if scores is None:
        out = judged.withColumns({"trust": F.lit(None).cast("double"), "distrust": F.lit(None).cast("double")})
    else:
        scores = written(spark, scores, "scores")
        even = float(max(1, scores.count()))
        # A host of many pages is joined by broadcast or salted.
        sizes = judged.groupBy("host").agg(F.count("*").alias("rows"))
        groups = sizes.join(scores, "host").select("host", "rows", (F.col("trust") * even).alias("trust"), (F.col("distrust") * even).alias("distrust"))
        out = joined_by_group(judged, written(spark, groups, "hosts"), "host")
    bad = F.coalesce((F.col("distrust") >= LEAST) & (F.col("distrust") >= MARGIN * (F.col("trust") + F.col("distrust"))), F.lit(False))
    evidence = F.when(F.col("rule").isNotNull(), "rule").when(F.col("trust") + F.col("distrust") > 0, "rank").otherwise("none")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), bad.alias("distrusted"), evidence.alias("evidence"), "trust", "distrust")
