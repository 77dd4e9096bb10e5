import heapq
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from stormglass.llm import shards as S
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


def size(text):
    return len((text or "").encode()) + 1


def longest_first(rows, shards):
    """Loads after dealing whole groups, largest first, through a heap."""
    groups = defaultdict(int)
    for _, text in rows:
        groups[text or ""] += size(text)
    heap = [(0, s) for s in range(shards)]
    for load in sorted(groups.values(), reverse=True):
        least, s = heapq.heappop(heap)
        heapq.heappush(heap, (least + load, s))
    return sorted(load for load, _ in heap)


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    loads, slots = defaultdict(int), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(list(loads.values()) + [0] * (shards - len(loads))) == longest_first(rows, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_against_the_plain_heap(spark):
    for folder in (H.SF, "/root/testdata/sf0.01"):
        rows = H.texts(spark, folder)
        got = QUERIES["op10_sharding"](spark, folder).collect()
        check(rows, got, 8)
        home = dict(rows)
        by_text = defaultdict(set)
        for r in got:
            by_text[home[r.doc_id]].add(r.shard)
        assert all(len(s) == 1 for s in by_text.values())
        assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)


def test_dealing_many_equals_the_heap():
    pick = random.Random(3)
    for _ in range(300):
        loads = [pick.randint(0, 500) for _ in range(pick.randint(1, 9))]
        load, count = pick.randint(1, 60), pick.randint(0, 400)
        heap, expected = [(x, i) for i, x in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            x, i = heapq.heappop(heap)
            expected[i] += 1
            heapq.heappush(heap, (x + load, i))
        after = list(loads)
        assert S.deal(after, load, count) == expected
        assert after == [x + load * n for x, n in zip(loads, expected)]


def test_many_equal_sizes_and_copies(spark):
    rows = [(i, f"{i:05d}") for i in range(700)] + [(1000 + i, "the same text") for i in range(90)] + [(2000 + i, "z" * i) for i in range(60)]
    for n in (1, 3, 8):
        check(rows, S.shard(H.documents(spark, rows), n).collect(), n)


def test_other_groups_stay_together(spark):
    rows = [(i, f"text {i}") for i in range(60)]
    got = S.shard(H.documents(spark, rows), 4, group=F.col("id") % 7).collect()
    home = defaultdict(set)
    for r in got:
        home[r.doc_id % 7].add(r.shard)
    assert all(len(s) == 1 for s in home.values()) and len({r.shard for r in got}) == 4


def test_edges(spark):
    for clash in (False, True):
        check(H.EDGES, S.shard(H.edges(spark, clash), 3).collect(), 3)
    assert S.shard(H.nothing(spark), 3).collect() == []
