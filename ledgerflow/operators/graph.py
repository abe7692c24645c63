"""Transitive closure of sets over edges that may hold cycles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, or as it is cached if unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df.persist()
    path = f"{at.rstrip('/')}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots(inv, node), edges(inv, parent, child) -> (inv, node, depth): each node once, by
    semi-naive steps, so that neither cycles nor diamonds cost more than their edges."""
    spark = roots.sparkSession
    front = roots.select("inv", "node").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    seen = front
    depth = 0
    while True:
        depth += 1
        new = (front.join(edges, (front["inv"] == edges["inv"]) & (front["node"] == edges["parent"]))
               .select(front["inv"], edges["child"].alias("node")).distinct().join(seen.select("inv", "node"), ["inv", "node"], "left_anti"))
        front = checkpointed(spark, new.withColumn("depth", F.lit(depth).cast("bigint")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
