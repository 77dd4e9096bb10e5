"""Small tables with everything that may go wrong, and plain versions of the rules shared by several tests."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
CLASHING = [
    "id", "key", "Text", "node", "size", "source", "n_words", "score", "ids", "ends", "decoded", "shard", "slot", "kept",
    "rule", "label", "component", "component_id", "n_lines", "n_dropped", "_0", "_1", "hits", "gone", "matches", "packed",
]
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\r "),
    (4, "One line\none LINE \n\nlast"),
    (None, "a row without an id"),
    (5, LONG),
    (6, "x" * 200_000),
    (4, "One line\none LINE \n\nlast"),
    (7, "É ß 中文 𝄞 don't 'll 12³"),
    (None, None),
]


def documents(spark, rows, clash=False):
    """Documents; with ``clash`` also columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    for i, name in enumerate(CLASHING if clash else []):
        df = df.toDF(*df.columns).selectExpr("*", f"{i} AS `{name}~`").withColumnRenamed(f"{name}~", name) if name != "Text" else df
    return df


def edges(spark, clash=False):
    return documents(spark, EDGES, clash)


def nothing(spark):
    return documents(spark, [])


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark, folder=SF):
    return [(r.doc_id, r.text) for r in table(spark, "documents", folder).select("doc_id", "text").collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
