import random
import re
from collections import Counter

from stormglass.functions.staging import written_paths
from stormglass.llm import collocations, queries
from tests.llm import helpers as H


def brute(rows, least, top):
    """(lang, rank) -> (phrase, a, l, r, n, score), by plain counting of all phrases."""
    totals, found = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        counts = found.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", H.lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in found.items():
        n, candidates = totals[lang], {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            inner = {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}
            covered |= {q for q in inner if a >= counts[q]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, counts[p[:k]], counts[p[k:]], n, score)))
        for rank, row in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = row[3]
    return out


def mined(spark, rows, least, top):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return {(r.lang, r["rank"]): tuple(r)[2:] for r in collocations.mine(df, least, top).collect()}


def test_against_brute_force(spark):
    draw = random.Random(3)
    words = ["a", "b", "New", "york", "city", "é", "of", "the", "x-1", "𝄞"]
    rows = []
    for _ in range(400):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  \t", ". ", "\n", ", ", "! "]) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "en", "en", "fr", None, "und"]), text))
    rows += [("en", "new york city hall of records")] * 40 + [("de", "a a a a a a a a")] * 30 + [("en", None), (None, None), ("es", "")]
    for least, top in ((2, 2000), (9, 7), (30, 50)):
        assert mined(spark, rows, least, top) == brute(rows, least, top)


def test_long_words_texts_and_empty_table(spark):
    rows = [("en", H.LONG), ("en", "x" * 100_000 + " y"), ("en", "x" * 100_000 + " y")]
    assert mined(spark, rows, 2, 30) == brute(rows, 2, 30)
    assert mined(spark, [], 1, 5) == {}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("en", "a b. a b")] * 3, "lang string, text string")
    clashing = df.selectExpr("*", "1 AS language", "2 AS Text", "3 AS word", "4 AS n", "5 AS w1", "6 AS words")
    assert collocations.mine(clashing, 2).collect() == collocations.mine(df, 2).collect()


def test_hot_places_of_the_bitmaps_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORD_BITS", 15)
    monkeypatch.setattr(collocations, "PAIR_BITS", 15)
    monkeypatch.setattr(collocations, "HELD", 1000)
    draw = random.Random(4)
    rows = [("en", " ".join(f"w{int(draw.random() ** 3 * 300)}" for _ in range(400))) for _ in range(50)]
    assert mined(spark, rows, 4, 2000) == brute(rows, 4, 2000)


def test_windows_end_before_rare_triples(spark, monkeypatch):
    """All pairs are frequent and most triples are rare: no more windows than pairs and frequent triples."""
    monkeypatch.setattr(collocations, "SLICE", 50)
    monkeypatch.setattr(collocations, "SLICES", 3)
    draw = random.Random(5)
    rows = [(draw.choice(["en", "fr"]), " ".join(f"w{draw.randrange(20)}" for _ in range(300))) for _ in range(60)]
    rows += [("en", "w1 w2 w3 w4 w5 w6")] * 10
    assert mined(spark, rows, 9, 2000) == brute(rows, 9, 2000)
    path = [p for p in written_paths(spark) if "phrase-windows" in p][-1]
    assert spark.read.parquet(path).count() < 2 * 20 * 20 + 500


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.lang, r.text) for r in H.table(spark, "documents", folder).select("lang", "text").collect()]
    got = {(r.lang, r["rank"]): tuple(r)[2:] for r in queries.op11_phrase_collocations(spark, folder).collect()}
    assert got == brute(rows, 100, 2000) and len(got) > 50
