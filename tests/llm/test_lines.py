import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stormglass.llm import lines as L
from stormglass.llm.queries import QUERIES
from stormglass.llm.sql import SQL
from tests.check_sql import compare, connect
from tests.llm import helpers as H


def key(line):
    return H.lower(line.strip(" \t\n\x0b\x0c\r"))


def stripped(rows, n):
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return sorted((i or 0, "\n".join(x for x in (t or "").split("\n") if counts[key(x)] < n)) for i, t in rows)


def got(df):
    return sorted((r["_0"] or 0, r["_1"] or "") for r in df.select("_0", "_1").collect())


def keys(n, seed=0):
    return np.random.default_rng(seed).integers(-(2**62), 2**62, (n, 2))


def test_query_against_sql(spark):
    assert compare(QUERIES["op5_line_dedup"](spark, H.SF), connect(H.SF), SQL["op5_line_dedup"]) == ""


def test_filter_never_forgets_and_deletes():
    k = keys(60_000)
    f = L.CuckooFilter()
    f.add(k[:20_000, 0], k[:20_000, 1])
    f.add(k[20_000:40_000, 0], k[20_000:40_000, 1])
    f = L.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(k[:40_000, 0], k[:40_000, 1]).all()
    assert f.contains(k[40_000:, 0], k[40_000:, 1]).mean() < 0.002
    f.remove(k[:30_000, 0], k[:30_000, 1])
    assert f.contains(k[30_000:40_000, 0], k[30_000:40_000, 1]).all()
    assert f.contains(k[:30_000, 0], k[:30_000, 1]).mean() < 0.002
    assert sum(int(np.count_nonzero(t)) for t in f.tables) == 10_000


def test_filter_takes_equal_marks():
    f = L.CuckooFilter()
    same = np.repeat(keys(1), 9, axis=0)
    f.add(same[:, 0], same[:, 1])
    for _ in range(9):
        assert f.contains(same[:1, 0], same[:1, 1]).all()
        f.remove(same[:1, 0], same[:1, 1])
    assert not f.contains(same[:1, 0], same[:1, 1]).any()


def corpus():
    rows = [(i, f"only {i}\nTwice {i // 2}\n hot LINE\t\nten {i % 3}\n\n{'x' * (i % 5)}") for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "hot line"), (103, "hot line\nhot line"), (None, "HOT line\nz"), (102, "hot line")]


def test_both_ways_and_increments(spark):
    rows = corpus()
    df = H.documents(spark, rows)
    for shipped in (0, 1 << 20):
        index = L.LineIndex(spark, 10, shards=3, max_shipped=shipped)
        index.insert(df.where("doc_id < 17"))
        index.insert(df.where("doc_id >= 17 OR doc_id IS NULL"))
        assert got(index.strip(df)) == stripped(rows, 10)


def test_deletion_undoes_insertion(spark):
    rows = corpus()
    df = H.documents(spark, rows)
    gone, rest = df.where("doc_id % 3 = 0"), df.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    index, fresh = L.LineIndex(spark, 10, shards=3), L.LineIndex(spark, 10, shards=3)
    index.insert(df)
    index.delete(gone)
    fresh.insert(rest)
    assert sorted(map(tuple, index.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
    left = [(i, t) for i, t in rows if i is None or i % 3]
    assert got(index.strip(rest)) == got(fresh.strip(rest)) == stripped(left, 10)


def test_many_deletions_from_grown_filters(spark):
    """Every key still found in two documents is known to its filter, also after removals from several tables."""
    text = lambda lo, hi: "\n".join(f"line {i}" for i in range(lo, hi))
    df = lambda *spans: H.documents(spark, [(i, text(*s)) for i, s in enumerate(spans)])
    index = L.LineIndex(spark, 2, shards=1)
    index.insert(df((0, 30_000), (0, 30_000)))
    index.insert(df((30_000, 150_000), (30_000, 150_000)))
    assert index.filters.first().tables > 1
    index.delete(df((30_000, 130_000)))
    held = L.CuckooFilter.from_bytes(index.filters.first()["filter"])
    left = np.array([tuple(r) for r in index.repeated.collect()], dtype=np.int64)
    assert len(left) == 50_000 and held.contains(left[:, 0], left[:, 1]).all()
    index.delete(df((0, 30_000), (130_000, 150_000)))
    assert index.repeated.count() == 0 and index.strip(df((0, 9))).first().n_dropped == 0


def test_edges(spark):
    for clash in (False, True):
        df = H.edges(spark, clash)
        for shipped in (0, 1 << 20):
            out = L.dedup(df, 2, max_shipped=shipped)
            assert out.columns == df.columns
            assert sorted((r.doc_id or 0, r.text or "") for r in out.select("doc_id", "text").collect()) == stripped(H.EDGES, 2)
            assert out.where("doc_id = 1").select("text").first()[0] is None
    assert L.dedup(H.nothing(spark), 2).collect() == []


def test_digest(spark):
    rows = QUERIES["op5_line_dedup"](spark, H.SF).where(F.col("n_dropped") == 0).limit(5).collect()
    texts = dict(H.texts(spark))
    assert all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.kept_sha256 for r in rows)
