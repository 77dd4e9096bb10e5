"""Sharding by longest processing time: groups that stay together, largest first, to the least loaded shard.

The load of a group is the sum of its rows' sizes. Groups of equal load are interchangeable, so the
schedule runs over the distinct loads in falling order: a heap deals the groups of a load to the least
loaded shard (the lower number at equal load); many groups of one load are dealt at once by the level
that the heap would fill the shards to. There are at most sqrt(2 * total size) distinct loads; they are
read as a stream, and what is dealt goes back as a table in pieces. The groups themselves, their ranks
within a load and the rows' slots are counted by Spark, per partition and then over partitions.

A null text is a text of no bytes, equal to an empty one. A null id is an id like others. Equal texts are
one group however many rows they have. Columns of other names are left out; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass.functions.staging import fresh_path, staged
from stormglass.llm import arrow as A

HEAP_UP_TO = 64
CHUNK = 20_000


def _taken(loads: list[int], load: int, level: int) -> list[int]:
    """Groups each shard gets while its load is below ``level``."""
    return [max(0, -((x - level) // load)) if level > x else 0 for x in loads]


def deal(loads: list[int], load: int, count: int) -> list[int]:
    """How many of ``count`` groups of one load each shard gets; ``loads`` are brought up to date."""
    given = [0] * len(loads)
    if count > HEAP_UP_TO:
        low, high = min(loads), max(loads) + load * (count + 1)
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(_taken(loads, load, level)) <= count else (low, level - 1)
        given = _taken(loads, load, low)
        loads[:] = [x + load * g for x, g in zip(loads, given)]
    heap = [(x, shard) for shard, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        least, shard = heap[0]
        heapq.heapreplace(heap, (least + load, shard))
        given[shard] += 1
    for x, shard in heap:
        loads[shard] = x
    return given


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For (load, groups) in falling order of load: the load and, per shard, the rank at which its share ends."""
    loads = [0] * shards
    for load, count in classes:
        ends, total = [], 0
        for given in deal(loads, load, count):
            total += given
            ends.append(total)
        yield load, ends


def _dealt(spark: SparkSession, classes: DataFrame, shards: int) -> tuple[DataFrame, int]:
    schema, path, chunk, n = "load bigint, ends array<bigint>", fresh_path(spark, "shard-classes"), [], 0
    rows = ((r["load"], r["groups"]) for r in classes.orderBy(F.desc("load")).toLocalIterator())
    spark.createDataFrame([], schema).write.parquet(path)
    for item in schedule(rows, shards):
        chunk.append(item)
        n += 1
        if len(chunk) == CHUNK:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
            chunk = []
    if chunk:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path), n


def _numbered(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 among rows of equal ``by``: counted within the written parts of ``df``
    (column part), plus what the parts before hold."""
    counts = df.groupBy(by, "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", by).orderBy(*order)) - 1
    ranked = df.select("*", inside.alias("inside"))
    return ranked.join(offsets, ["part", by]).select(*[c for c in df.columns if c != "part"], (F.col("inside") + F.col("before")).alias(name))


def _in_parts(df: DataFrame, name: str) -> DataFrame:
    return staged(df.withColumn("part", F.spark_partition_id()), name)


def shard(
    documents: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", group: Column | None = None
) -> DataFrame:
    """Per row: the id, size, text_crc32, shard and slot. ``group``: what stays together, by default the text;
    an expression over the columns id and text."""
    spark = documents.sparkSession
    rows = A.pick(documents, key, text).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    kept = F.col("text") if group is None else group.cast("string").cast("binary")
    rows = _in_parts(
        rows.select(
            "id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.unhex(F.sha2(F.coalesce(kept, F.lit("").cast("binary")), 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = _in_parts(rows.groupBy("group").agg(F.sum("size").alias("load")), "shard-groups")
    dealt, n = _dealt(spark, groups.groupBy("load").agg(F.count("*").alias("groups")), shards)
    if n * (shards + 3) * 8 <= 64 << 20:
        dealt = F.broadcast(dealt)
    ranked = _numbered(groups, "load", ["group"], "rank").join(dealt, "load")
    chosen = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    placed = rows.join(ranked.select("group", chosen.alias("shard")), "group")
    # numbered by the part in which a row was read, so a large group is not one part
    placed = staged(placed.select("id", "size", "text_crc32", "shard", "part"), "shard-placed")
    return _numbered(placed, "shard", ["id", "text_crc32", "size"], "slot").withColumnRenamed("id", key)
