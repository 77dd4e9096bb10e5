import random
from collections import Counter, defaultdict

import numpy as np

from stormglass.llm import jaccard as J
from stormglass.llm.components import components
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


def shingles(text):
    words = H.space_words(H.lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df).collect()}


def variants(seed, families=12, copies=8):
    """Families of edited texts of many lengths, most of them near the limit of 0.8."""
    pick = random.Random(seed)
    rows = []
    for _ in range(families):
        n = pick.choice([3, 5, 6, 8, 9, 10, 12, 15, 18, 25, 33, 40, 64, 70, 100, 180, 300])
        words = [f"v{pick.randrange(5000)}" for _ in range(n)]
        for _ in range(copies):
            own = list(words)
            for _ in range(pick.choice([0, 1, 1, 2, 3, max(1, n // 40)])):
                at = pick.randrange(len(own))
                change = pick.randrange(4)
                if change == 0:
                    own[at] = f"e{pick.randrange(10**6)}"
                elif change == 1 and len(own) > 1:
                    own.pop(at)
                elif change == 2:
                    own.insert(at, f"e{pick.randrange(10**6)}")
                else:
                    own = own[: max(1, len(own) - pick.randrange(1 + n // 8))]
            rows.append((len(rows), " ".join(own)))
    pick.shuffle(rows)
    return rows


def test_query_against_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_ngram_jaccard_join"](spark, H.SF).collect()}
    assert got == brute(H.texts(spark))


def test_variants_near_the_limit(spark):
    rows = [(i, t) for i, t in variants(1, families=60)]
    assert joined(H.documents(spark, rows)) == brute(rows)


def test_hot_family_and_shared_passage(spark):
    pick = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(150):
        own = list(base)
        own[pick.randrange(120)] = f"z{i}"
        rows.append((i, " ".join(own)))
    for i in range(150, 260):
        rows.append((i, passage + " " + " ".join(f"q{pick.randrange(10**6)}" for _ in range(70))))
    rows += [(i, passage) for i in range(260, 330)]
    assert joined(H.documents(spark, rows)) == brute(rows)


def test_signatures_meet_the_pigeonhole():
    """Whatever a set searches, a partner at the limit shares a searched unit, also with empty segments."""
    pick = np.random.default_rng(3)
    for n in [4, 5, 7, 8, 9, 12, 15, 16, 20, 31, 32, 60, 63, 64, 127, 128, 300, 511, 512, 900]:
        for _ in range(6):
            universe = pick.integers(1, 2**63, 3 * n + 20, dtype=np.uint64)
            a = universe[:n]
            gone = int(pick.integers(0, n // 5 + 1))
            more = 0
            while (n - gone) * 100 >= 80 * (n + more + 1):
                more += 1
            b = np.concatenate([a[gone:], universe[n : n + more]])
            if not len(b) or (n - gone) * 100 < 80 * (n + more):
                continue
            sets = [np.unique(a), np.unique(b)]
            firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            (slot, signature, code), (own, band, needed, available) = J.band_signatures(np.concatenate(sets), firsts)
            entries = defaultdict(dict)
            for s, sig, c in zip(slot.tolist(), signature.tolist(), code.tolist()):
                entries[(int(own[s]), int(band[s]))][sig] = c
            shared_bands = {k for _, k in entries}
            met = False
            for k in shared_bands:
                x, y = entries.get((0, k), {}), entries.get((1, k), {})
                both = set(x) & set(y)
                for mine, who in ((x, 0), (y, 1)):
                    slots = [s for s in range(len(own)) if (int(own[s]), int(band[s])) == (who, k)]
                    if slots and both:
                        lives, searched = J.allocate(
                            int(needed[slots[0]]), int(available[slots[0]]), [(2, s, mine[s]) for s in both]
                        )
                        met |= lives and bool(searched & both)
            assert met, (n, gone, more)


def _slots(flat, firsts):
    """Per (set, band): needed, available and the signatures with their codes."""
    (slot, signature, code), (own, band, needed, available) = J.band_signatures(flat, firsts)
    slots = {s: (int(n), int(a), {}) for s, (n, a) in enumerate(zip(needed, available))}
    for s, sig, c in zip(slot.tolist(), signature.tolist(), code.tolist()):
        slots[s][2][sig] = c
    return {(int(own[s]), int(band[s])): x for s, x in slots.items()}


def _meet(x, y):
    """Whether two slots of one band find each other where no other set has their signatures, and also
    where every signature has other sets, whichever of them are dear."""
    met = []
    for shared_only in (True, False):
        for dear in range(4):
            both, finds = set(x[2]) & set(y[2]), False
            results = []
            for needed, available, signatures in (x, y):
                chosen = both if shared_only else set(signatures)
                entries = [(2 + (hash((s, dear)) % 5 if dear else 0), s, signatures[s]) for s in sorted(chosen)]
                results.append(J.allocate(needed, available, entries))
            if all(lives for lives, _ in results):
                finds = any(searched & both for _, searched in results)
            met.append(finds)
    return all(met)


def test_wide_segments_of_one_shingle_meet():
    """Random pairs at the limit, also with nearly empty segments."""
    pick = np.random.default_rng(11)
    for n, gone, more in [(10, 2, 0), (11, 2, 0), (15, 3, 0), (10, 1, 1), (11, 1, 1), (14, 1, 1), (16, 3, 0), (18, 2, 2), (27, 3, 3), (31, 6, 0), (40, 8, 0)]:
        for _ in range(300):
            universe = np.unique(pick.integers(1, 2**63, n + more, dtype=np.uint64))
            pick.shuffle(universe)
            sets = [np.sort(universe[:n]), np.sort(universe[gone:])]
            assert (n - gone) * 100 >= 80 * (n + more)
            slots = _slots(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
            bands = {k for i, k in slots if i == 0} & {k for i, k in slots if i == 1}
            assert any(_meet(slots[(0, k)], slots[(1, k)]) for k in bands), (n, gone, more)


def test_components(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    pick.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_edges(spark):
    rows = H.EDGES + [(9, "A b c"), (8, "a B  c"), (10, "a b"), (None, "a b c"), (None, "only without id")]
    for clash in (False, True):
        df = H.documents(spark, rows, clash)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()]
        assert len(got) == len(rows)
        assert {(8, 1, 8), (9, 1, 8), (10, 1, 10), (1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, 8), (None, 1, None)} <= set(got)
        kept = J.keep_first(df)
        assert kept.columns == df.columns
        once = [i or 0 for i, _ in rows if i != 9]
        once.remove(4)  # one of two rows with equal id and text
        assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(once)
    assert J.join(H.nothing(spark)).collect() == []


def test_repeated_ids_keep_one_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (3, b), (7, a), (7, c), (7, c), (None, a), (None, a), (9, ""), (9, "")]
    df = H.documents(spark, rows)
    kept = sorted((str(r.doc_id), r.text) for r in J.keep_first(df).collect())
    assert kept == sorted([("5", a), ("3", b), ("7", c), ("None", a), ("None", a), ("9", ""), ("9", "")])
    named = df.selectExpr("'d' || doc_id AS doc_id", "text", "struct(doc_id AS `first name`) AS `a b`")
    kept = sorted((r.doc_id or "", r.text) for r in J.keep_first(named).collect())
    assert kept == sorted([("d5", a), ("d3", b), ("d7", c), ("", a), ("", a), ("d9", ""), ("d9", "")])
