import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stormglass.llm import ftrl as C
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op9_quality_classifier"](spark, folder)
    rows = scored.join(H.table(spark, "labels", folder), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.98
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_only_allowed_labels_count(spark):
    docs, labels = H.table(spark, "documents"), H.table(spark, "labels")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(C.fit(docs, labels, fold != 1), C.fit(docs, turned, fold != 1))


def test_features_are_unit_vectors_of_distinct_places():
    texts = ["a a b $$ $$", None, "", "x" * 50_000, "Über über ÜBER"]
    places, values, firsts = C.text_features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        own, x = places[firsts[i] : firsts[i + 1]], values[firsts[i] : firsts[i + 1]]
        shape = np.isclose(x, C.SHAPE_VALUE).sum() if not text else 3
        assert shape == 3 and len(own) >= 3
        if text:
            assert np.isclose(np.sum(x * x), 1 + 3 * C.SHAPE_VALUE**2)


def test_leader_follows_the_plain_update():
    pick = np.random.default_rng(0)
    leader = C.Leader(4)
    z, n = np.zeros(16), np.zeros(16)
    for _ in range(200):
        at = pick.choice(16, 4, replace=False)
        x, y = pick.random(4), float(pick.random() < 0.4)
        w = np.array([0.0 if abs(z[j]) <= C.L1 else -(z[j] - np.sign(z[j]) * C.L1) / ((C.BETA + n[j] ** 0.5) / C.ALPHA + C.L2) for j in at])
        p = 1 / (1 + np.exp(-w @ x))
        for k, j in enumerate(at):
            g = (p - y) * x[k]
            z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / C.ALPHA * w[k]
            n[j] += g * g
        leader.learn(at, x, y)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_score_is_a_dot_product(spark):
    weights = np.random.default_rng(1).normal(size=1 << C.BITS)
    places, values, firsts = C.text_features(pa.array(["one two, two!", None]))
    expected = [C.logistic(weights[places[a:b]] @ values[a:b]) for a, b in zip(firsts, firsts[1:])]
    got = C.score(H.documents(spark, [(1, "one two, two!"), (2, None)]), weights).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], expected)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (None, 0), (6, None), (7, 3)], "doc_id bigint, quality int")
    for clash in (False, True):
        df = H.edges(spark, clash)
        got = C.score(df, C.fit(df, labels)).collect()
        assert len(got) == len(H.EDGES) and all(0.0 <= r.score <= 1.0 for r in got)
    assert not C.fit(H.edges(spark), labels.limit(0)).any()
    assert C.score(H.nothing(spark), np.zeros(1 << C.BITS)).collect() == []
