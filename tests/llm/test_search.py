import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from stormglass.llm import search
from tests.llm import helpers as H


def brute(documents, items, k=10):
    texts = [(i, Counter(H.plain_words(t))) for i, t in documents]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_all, total = len(texts), sum(n for _, _, n in texts)
    df = Counter(w for _, c, _ in texts for w in c)
    out = set()
    for item, text in set(items):
        scored = []
        for i, counts, n in texts:
            m = 100 - 90 + (90 * n * n_all) // total
            score = 0
            for term in set(H.plain_words(text)):
                if counts[term]:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)}
    return out


def found(spark, documents, items, k=10):
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    return {tuple(r) for r in search.top_documents(search.build(docs), asked, k).collect()}


def corpus(draw, n, words=200):
    return [(i, " ".join(f"w{int(draw.random() ** 2 * words)}" for _ in range(draw.choice([1, 5, 40, 300])))) for i in range(n)]


def test_against_brute_force(spark):
    draw = random.Random(2)
    docs = corpus(draw, 600)
    docs += [(1000 + i, docs[7][1]) for i in range(25)] + [(5, "w1 w2"), (None, docs[7][1]), (None, "w3 w3 w3"), (7000, None), (7001, " .\n")]
    items = [(i, " ".join(f"W{int(draw.random() ** 2 * 220)}" for _ in range(draw.randint(1, 30)))) for i in range(30)]
    items += [(90, docs[7][1]), (91, "unknown"), (92, ""), (93, None), (90, docs[7][1]), (None, "w1 w3"), (94, "w1"), (94, "w2")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items[:5], 3) == brute(docs, items[:5], 3)


def test_blocks_of_items_and_small_blocks_of_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BYTES", 200)
    monkeypatch.setattr(search, "ROWS", 16)
    draw = random.Random(6)
    docs = corpus(draw, 300)
    items = [(i, " ".join(f"w{draw.randint(0, 200)}" for _ in range(12))) for i in range(25)]
    assert found(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    items = [(1, "one line don't É 𝄞 12"), (2, "w1 w2 w976"), (3, "x" * 200_000)]
    assert found(spark, H.EDGES, items) == brute(H.EDGES, items)
    assert found(spark, [], items) == set() and found(spark, H.EDGES, []) == set()
    docs = H.documents(spark, H.EDGES, clash=True)
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS number", "2 AS Text", "3 AS terms")
    assert {tuple(r) for r in search.top_documents(search.build(docs), asked).collect()} == brute(H.EDGES, items)


def test_bounds_are_never_below_the_score():
    draw = random.Random(9)
    texts = [t for _, t in corpus(draw, 200)]
    column = pa.array(texts)
    hashes, firsts = search.term_hashes(column)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), column], names=["source", "text"])
    terms = np.unique(hashes)
    weights = np.arange(len(terms), dtype=np.int64) * 37
    of_item = [np.array(draw.sample(range(len(terms)), 20)) for _ in range(15)]
    items = search.Items(terms, weights, of_item, 200, len(hashes))
    rows = 0
    for block in search._signatures(iter([batch])):
        for own, bound in search._blocks(iter([block.select(["kind", "sources", "lengths", "slices"])]), items):
            for row, source in enumerate(own):
                text = hashes[firsts[source] : firsts[source + 1]]
                exact = items.scores(np.arange(15), *np.unique(text, return_counts=True), len(text))
                assert (bound[:, row] >= exact).all()
                rows += 1
    assert rows == 200
