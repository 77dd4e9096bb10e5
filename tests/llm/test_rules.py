import numpy as np
import pyarrow as pa

from stormglass.llm import rules as R
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


def counts(text):
    text = text or ""
    words = H.space_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 4000 else None
    if covered is None:
        from collections import Counter

        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = text.split("\n")
    duplicates = sum(bool(H.space_words(x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else 0
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_query_against_brute_force(spark):
    rows = H.texts(spark)
    learned = R.learn(H.table(spark, "documents"), H.table(spark, "labels"))
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, H.SF).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, expected = got[doc_id], counts(text)
        assert tuple(r[n] for n in NAMES) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        measured = {k: v[:1] for k, v in R.count_texts(pa.array([text])).items()}
        assert r.base_failed == failed
        assert r.kept == (not failed and not bool(learned.rejects(R.features(measured))[0]))


def test_labelled_junk_goes_and_clean_stays(spark):
    folder = "/root/testdata/sf0.01"
    judged = QUERIES["op3_quality_rules"](spark, folder).where("NOT base_failed")
    both = judged.join(H.table(spark, "labels", folder), "doc_id").groupBy("quality", "kept").count().collect()
    share = {(r.quality, r.kept): r["count"] for r in both}
    good, junk = share[(1, True)], share[(0, False)]
    assert share.get((1, False), 0) <= 0.01 * good and share.get((0, True), 0) <= 0.1 * junk


def test_list_finds_planted_rules():
    pick = np.random.default_rng(0)
    x = pick.random((3000, len(R.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 1] <= 0.5) | (x[:, 4] > 0.9)
    learned = R.cover(x, bad, pick.random(3000) < 0.33)
    assert (learned.rejects(x) == bad).mean() > 0.99
    assert 2 <= len(learned.rules) <= 5 and "keep" in str(learned)


def test_pruning_keeps_noise_out():
    pick = np.random.default_rng(1)
    x = pick.random((3000, len(R.FEATURES)))
    assert R.cover(x, pick.random(3000) < 0.2, pick.random(3000) < 0.33).rules == ()


def test_column_equals_rejects(spark):
    learned = R.DecisionList(((R.Condition("words", True, 2.0), R.Condition("symbols_per_word", True, 0.2)), (R.Condition("words", False, 1.0),)))
    rows = [(i, t) for i, t in enumerate([None, "", "a", "a b #", "# # # b", "a b c d"])]
    got = {r.doc_id: r.rule for r in R.judge(H.documents(spark, rows), learned).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: None}


def test_edges(spark):
    for clash in (False, True):
        df = H.edges(spark, clash)
        got = R.judge(df, R.DecisionList()).collect()
        assert len(got) == len(H.EDGES)
        expected = sorted((i or 0, counts(t)) for i, t in H.EDGES)
        assert sorted((r.doc_id or 0, tuple(r[n] for n in NAMES)) for r in got) == expected
        kept = R.keep(df, R.DecisionList())
        assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == []
    assert R.judge(H.nothing(spark), R.DecisionList()).collect() == []
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None), (6, 7)], "doc_id bigint, quality int")
    assert R.learn(H.edges(spark), labels) is not None
    assert R.learn(H.edges(spark), labels.where("quality = 1")).rules == ()
    assert R.learn(H.nothing(spark), labels.limit(0)).rules == ()
