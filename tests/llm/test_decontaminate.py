import math
import random
from collections import Counter

import pyarrow as pa

from stormglass.llm import decontaminate as D
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def grams(part):
    n = min(D.GRAM, len(part))
    return {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if n else set()


def overlap(part, passage):
    wanted = grams(part)
    n = min(D.GRAM, len(part))
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(wanted & there) / len(wanted) if wanted else 1.0


class Brute:
    """Scores every passage against every item."""

    def __init__(self, items):
        self.items = [(i, words(t), len(words(t[: D.answer_start(t)]))) for i, t in items if t and words(t)]
        df = Counter(w for _, own, _ in self.items for w in set(own))
        mean = sum(len(own) for _, own, _ in self.items) / max(1, len(self.items))
        self.impacts = []
        for _, own, _ in self.items:
            impact = {}
            for w, tf in Counter(own).items():
                idf = math.log(1 + (len(self.items) - df[w] + 0.5) / (df[w] + 0.5))
                impact[w] = idf * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(own) / mean))
            total = sum(impact.values())
            self.impacts.append({w: x / total for w, x in impact.items()})

    def search(self, text):
        own, found = words(text), {}
        for (item, wanted, at), impact in zip(self.items, self.impacts):
            limit = max(64, 1 << math.ceil(math.log2(len(wanted))))
            for start in range(0, len(own), limit):
                passage = own[start : start + 2 * limit]
                score = sum(x for w, x in impact.items() if w in set(passage))
                if score >= D.MIN_SCORE - 1e-9:
                    question, answer = (wanted[:at], wanted[at:]) if 0 < at < len(wanted) else (wanted, wanted)
                    over = [overlap(p, passage) for p in (wanted, question, answer)]
                    if min(over) >= D.MIN_OVERLAP:
                        found[item] = max(found.get(item, 0.0), min(score, 1.0))
        return found


def rounded(rows):
    return sorted((i, k, round(s, 6)) for i, k, s in rows)


def test_query_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in H.table(spark, "benchmark").collect()]
    brute = Brute(items)
    got = QUERIES["op6_benchmark_decontamination"](spark, H.SF).collect()
    expected = [(i, k, s) for i, t in H.texts(spark) for k, s in brute.search(t).items()]
    assert expected and rounded((r.doc_id, r.item_id, r.score) for r in got) == rounded(expected)


def test_whole_items_are_found_and_clean_texts_stay(spark):
    folder = "/root/testdata/sf0.01"
    items = [(r.item_id, " ".join(words(r.text))) for r in H.table(spark, "benchmark", folder).collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_benchmark_decontamination"](spark, folder).collect()}
    planted = set()
    for doc_id, text in H.texts(spark, folder):
        plain = f" {' '.join(words(text))} "
        planted |= {(doc_id, item) for item, t in items if f" {t} " in plain}
    assert planted and planted <= got
    assert len({d for d, _ in got}) <= 1.2 * len({d for d, _ in planted})


def test_block_max_wand_equals_exhaustive():
    pick = random.Random(3)
    n, terms = 400, 60
    import numpy as np

    postings = [(t, i, pick.random() / 6) for t in range(terms) for i in sorted(pick.sample(range(n), pick.randint(1, 300)))]
    firsts = np.searchsorted([t for t, _, _ in postings], range(terms + 1))
    index = D.Index(
        64, [], [], list(range(n)), np.arange(terms, dtype=np.uint64), firsts,
        np.array([i for _, i, _ in postings]), np.array([x for _, _, x in postings]),
    )
    for threshold in (0.2, 0.5, 0.8):
        asked = pick.sample(range(terms), 12)
        scores = Counter()
        for t, i, x in postings:
            if t in asked:
                scores[i] += x
        expected = {i: round(s, 9) for i, s in scores.items() if s >= threshold}
        assert {i: round(s, 9) for i, s in D.block_max_wand(index, asked, threshold)} == expected


def test_any_place_in_a_long_text_and_edits(spark):
    pick = random.Random(8)
    fill = lambda n: " ".join(f"f{pick.randrange(50_000)}" for _ in range(n))
    item = "What colour has the northern harbour light? It shines in pale amber tones all night."
    items = spark.createDataFrame([(7, item), (8, "Unrelated words only here. Nothing more to say about it.")], "item_id bigint, text string")
    rows = [(k, f"{fill(k)} {item.upper()} {fill(200)}") for k in range(0, 140, 9)]
    rows += [(1000, f"{fill(90)} {item.replace('northern', 'southern')} {fill(10)}"), (1001, fill(500)), (1002, "What colour has the northern harbour light?")]
    got = D.contaminated(H.documents(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, 7) for i, _ in rows if i <= 1000]


def test_edited_or_missing_last_sentences(spark):
    pick = random.Random(10)
    fill = lambda n: " ".join(f"f{pick.randrange(50_000)}" for _ in range(n))
    body = lambda k: " ".join(f"{w}{k}" for w in "Grey herons nest early beside shallow lakes and feed on fish at dawn".split())
    forms = {  # the item, then documents' versions of it
        1: [f"{body(1)}. Er.", f"{body(1)}. Em.", f"{body(1)}."],
        2: [f"{body(2)}. Old trees.", f"{body(2)}. Old shrubs.", f"{body(2)}."],
        3: [f"{body(3)}. They return to one colony.", f"{body(3)}. Others wander off.", f"{body(3)}."],
        4: [f"{body(4)}, see http://birds.org/a?id=3. Yes.", f"{body(4)}, see http://birds.org/a?id=3. No."],
        5: [f"{body(5)}? Heron", f"{body(5)}? Egret"],
    }
    items = spark.createDataFrame([(i, texts[0]) for i, texts in forms.items()], "item_id bigint, text string")
    rows = [(10 * i + k, f"{fill(50)} {t} {fill(70)}") for i, texts in forms.items() for k, t in enumerate(texts)] + [(1000, fill(300))]
    df = H.documents(spark, rows)
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(df, items).collect()) == [(k, k // 10) for k, _ in rows[:-1]]
    assert [r.doc_id for r in D.clean(df, items).collect()] == [1000]


def test_blocks_and_long_items(spark):
    pick = random.Random(9)
    items = [(i, " ".join(f"t{pick.randrange(4000)}" for _ in range(pick.choice([5, 20, 64, 65, 200])))) for i in range(60)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, f"start {t} end") for i, t in items] + [(100, "nothing here")]
    whole = rounded((r.doc_id, r.item_id, r.score) for r in D.contaminated(H.documents(spark, rows), table).collect())
    assert {(i, k) for i, k, _ in whole} >= {(i, i) for i, _ in items}
    blocks = D.build(table, max_bytes=2000)
    assert len(blocks) > len({b.limit for b in blocks})
    column = pa.array([t for _, t in rows])
    split = [(rows[f[0]][0], b.ids[f[1]], f[2]) for b in blocks for f in D.search(b, column)]
    assert rounded(split) == whole


def test_edges(spark):
    items = spark.createDataFrame(
        [(1, "One line one line last"), (None, "a row without an id"), (2, None), (3, " ?! "), (1, "One line one line last")],
        "item_id bigint, text string",
    )
    for clash in (False, True):
        df = H.edges(spark, clash)
        got = sorted(((r.doc_id or 0), (r.item_id or 0)) for r in D.contaminated(df, items).collect())
        assert got == [(0, 0), (4, 1), (4, 1)]
        clean = D.clean(df, items)
        assert clean.columns == df.columns
        assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, t in H.EDGES if i != 4 and t != "a row without an id")
        assert D.contaminated(df, items.limit(0)).collect() == []
    assert D.contaminated(H.nothing(spark), items).collect() == []
    assert D.clean(H.nothing(spark), items).collect() == []
