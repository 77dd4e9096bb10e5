"""Connected components by alternating stars, as joins and aggregates of an edge table.

Every edge is kept as (child, parent) with child > parent. A large star hangs each child below the
smallest neighbour of its parent, a small star hangs all parents of a child below the smallest of them.
A node with very many neighbours is met by a partial aggregate and by joins whose edge side Spark
splits, never as one group. Each round is written, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.functions.staging import fresh_path, release

FILE_ROWS = 500_000


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).where("child > parent").distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child."""
    ends = stars.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        stars.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count() == 0


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest node that it reaches.

    Null ends, loops and repeated edges count as nothing; without edges the result is empty. The tables of
    a round have as many files as their rows need, and go when the next round is written.
    """
    spark = edges.sparkSession
    now, path = _written(_ordered(edges), "edges")
    files = 1 + now.count() // FILE_ROWS
    while not _settled(now):
        least = (
            now.select(F.col("child").alias("node"), F.col("parent").alias("other"))
            .unionByName(now.select(F.col("parent").alias("node"), F.col("child").alias("other")))
            .groupBy("node")
            .agg(F.min("other").alias("other"))
            .select(F.col("node").alias("parent"), F.least("node", "other").alias("m"))
        )
        met = now.join(least, "parent").select("child", F.col("m").alias("parent")).distinct()
        large, large_path = _written(met.coalesce(files), "large-star")
        lowest = large.groupBy("child").agg(F.min("parent").alias("m"))
        moved = large.join(lowest, "child").where("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        stars = lowest.select("child", F.col("m").alias("parent")).unionByName(moved).distinct()
        gone = [path, large_path]
        now, path = _written(stars.coalesce(files), "small-star")
        release(spark, gone)
    members = now.select(F.col("child").alias("id"), F.col("parent").alias("component"))
    roots = now.select(F.col("parent").alias("id"), F.col("parent").alias("component")).distinct()
    return members.unionByName(roots)
