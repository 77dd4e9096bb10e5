"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing. A passage is a window of ``2 * L``
words, one every ``L`` words, with ``L`` the word limit of the items' length class, so any item that
stands in a document lies in one passage. Scores are BM25 of the passage's distinct words divided by the
item's score for its own words: 1 when all words are there. An item's impacts, document frequencies and
lengths are aggregated by Spark over all items.

Retrieval gives all items of ``MIN_SCORE`` or more. A vectorised bound first leaves out passages in which
no item can reach it: items' frequent words count in full, the others as found. For the rest block-max
WAND walks the posting lists. A retrieved item is reported if the two-word sequences of the item, of
its question and of its answer are each found in the passage to ``MIN_OVERLAP`` or more. The answer is
the text after the last ``?`` before white space; an item without one has no parts and is decided as a
whole. One edited word can break most sequences of a part of ``SHORT_PART`` words or fewer, so such a
part also counts as found if the whole item is found to ``HIGH_OVERLAP`` or more.

The index goes to every task in blocks of bounded size; items beyond it make more blocks, each a pass
over the documents. Items without words match nothing; a null item id stays null in the result; repeated
items count once. Null and empty texts hold no passage. Without items the result is empty.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.functions.staging import staged
from stormglass.llm import arrow as A

K1, B = 1.2, 0.75
MIN_SCORE = 0.5
MIN_OVERLAP = 0.5
GRAM = 2
SHORT_PART = 2 * GRAM
HIGH_OVERLAP = 0.75
SHORTEST_CLASS = 64
BLOCK_POSTINGS = 32
MAX_INDEX_BYTES = 16 << 20
_SLACK = 1e-9


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin, and the end."""
    data, begins = A.spaced(pc.utf8_lower(column))
    starts, ends = A.runs(A.WORD[data])
    return A.Hasher(data)(starts, ends), np.searchsorted(starts, begins)


def answer_start(text: str) -> int:
    """Where the answer begins in an item's text; 0 if no question mark tells question and answer apart."""
    marks = [m.end() for m in re.finditer(r"\?(?=\s)", text.rstrip())]
    return marks[-1] if marks else 0


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in A.pieces(batches, 1):
        hashes, firsts = word_hashes(piece.column(1))
        texts = piece.column(1).to_pylist()
        heads, head_firsts = word_hashes(pa.array([t[: answer_start(t)] if t else "" for t in texts], pa.string()))
        lists = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), lists, pa.array(np.diff(head_firsts))], names=["item", "words", "answer_at"]
        )


@dataclass
class Index:
    """Posting lists over items numbered by place, in blocks with their largest impact."""

    limit: int
    words: list[np.ndarray]
    answers: list[int]
    ids: list
    vocabulary: np.ndarray
    firsts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    lists: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        n = len(self.vocabulary)
        for t in range(n):
            own = slice(self.firsts[t], self.firsts[t + 1])
            items, impacts = self.items[own].tolist(), self.impacts[own].tolist()
            heads = range(0, len(items), BLOCK_POSTINGS)
            last = [items[min(h + BLOCK_POSTINGS, len(items)) - 1] for h in heads]
            top = [max(impacts[h : h + BLOCK_POSTINGS]) for h in heads]
            self.lists.append((items, impacts, max(top), last, top))
        self._divide()

    def _divide(self) -> None:
        """Frequent words, taken for granted in the bound: no item has half of MIN_SCORE from them."""
        mass = np.zeros(len(self.ids))
        self.rare = np.ones(len(self.vocabulary), dtype=bool)
        for t in np.argsort(-np.diff(self.firsts), kind="stable").tolist():
            own = slice(self.firsts[t], self.firsts[t + 1])
            mass[self.items[own]] += self.impacts[own]
            if mass.max() > MIN_SCORE / 2:
                mass[self.items[own]] -= self.impacts[own]
                break
            self.rare[t] = False
        self.granted = mass
        self.rare_terms = np.flatnonzero(self.rare)
        self.rare_hashes = self.vocabulary[self.rare]
        self.best = np.array([x[2] for x in self.lists])
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.rare_hashes >> np.uint64(48)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> list[int]:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.unique(at[self.vocabulary[at] == hashes]).tolist()


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of ``threshold`` or more."""
    threshold -= _SLACK
    lists = index.lists
    cursors = [[lists[t][0][0], 0, t] for t in terms]
    out = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            bound += lists[t][2]
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, target = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
        for _, _, t in cursors[: pivot + 1]:
            last = lists[t][3]
            b = bisect_left(last, item)
            if b < len(last):
                bound += lists[t][4][b]
                target = min(target, last[b] + 1)
        if bound >= threshold:
            if cursors[0][0] == item:
                score = sum(lists[t][1][at] for _, at, t in cursors[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
        alive = []
        for k, cursor in enumerate(cursors):
            if k <= pivot and cursor[0] < target:
                items = lists[cursor[2]][0]
                cursor[1] = bisect_left(items, target, cursor[1])
                if cursor[1] == len(items):
                    continue
                cursor[0] = items[cursor[1]]
            alive.append(cursor)
        cursors = alive
    return out


def _grams(words: np.ndarray) -> set:
    n = min(GRAM, len(words))
    listed = words.tolist()
    return {tuple(listed[k : k + n]) for k in range(len(listed) - n + 1)} if n else set()


def _overlap(part: np.ndarray, passage: np.ndarray) -> float:
    wanted = _grams(part)
    if not wanted:
        return 1.0
    n = min(GRAM, len(part))
    listed = passage.tolist()
    there = {tuple(listed[k : k + n]) for k in range(len(listed) - n + 1)}
    return len(wanted & there) / len(wanted)


def _verified(overlaps: list[float], question: int, answer: int) -> bool:
    """Whether the overlaps of item, question and answer, parts of so many words, make a find."""
    whole = overlaps[0]
    found = [o >= MIN_OVERLAP or (n <= SHORT_PART and whole >= HIGH_OVERLAP) for o, n in zip(overlaps[1:], (question, answer))]
    return whole >= MIN_OVERLAP and all(found)


def passages(firsts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of every passage."""
    words = np.diff(firsts)
    count = -(-words // limit)
    document = np.repeat(np.arange(len(words)), count)
    number = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    start = firsts[:-1][document] + number * limit
    return document, start, np.minimum(start + 2 * limit, firsts[1:][document])


def _promising(index: Index, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Passages in which some item can reach MIN_SCORE."""
    near = np.flatnonzero(index.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.rare_hashes, hashes[near]), len(index.rare_hashes) - 1)
    hit = index.rare_hashes[at] == hashes[near]
    place, term = near[hit], index.rare_terms[at[hit]]
    lacking = MIN_SCORE - float(index.granted.max()) - _SLACK
    sums = np.concatenate([[0.0], np.cumsum(index.best[term])])
    lo, hi = np.searchsorted(place, start), np.searchsorted(place, end)
    maybe = np.flatnonzero(sums[hi] - sums[lo] >= lacking - 1e-6)
    if not len(maybe):
        return maybe
    counts = hi[maybe] - lo[maybe]
    owner = np.repeat(np.arange(len(maybe)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[maybe], counts)
    pair = np.unique(owner * len(index.vocabulary) + term[inside])
    owner, term = pair // len(index.vocabulary), pair % len(index.vocabulary)
    lengths = np.diff(index.firsts)[term]
    posting = np.repeat(index.firsts[:-1][term], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = np.repeat(owner, lengths) * len(index.ids) + index.items[posting]
    distinct, inverse = np.unique(key, return_inverse=True)
    scores = np.bincount(inverse, weights=index.impacts[posting]) + index.granted[distinct % len(index.ids)]
    return maybe[np.unique(distinct[scores >= MIN_SCORE - _SLACK] // len(index.ids))]


def search(index: Index, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of the verified items, the best passage of each."""
    hashes, firsts = word_hashes(column)
    document, start, end = passages(firsts, index.limit)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in _promising(index, hashes, start, end).tolist():
        passage = hashes[start[p] : end[p]]
        for item, score in block_max_wand(index, index.terms(passage), MIN_SCORE):
            words, at = index.words[item], index.answers[item]
            question, answer = (words[:at], words[at:]) if 0 < at < len(words) else (words, words)
            overlaps = [_overlap(part, passage) for part in (words, question, answer)]
            if _verified(overlaps, len(question), len(answer)):
                own = (min(score, 1.0), overlaps[1], overlaps[2])
                key = (int(document[p]), item)
                found[key] = max(found.get(key, own), own)
    return [(row, item, *values) for (row, item), values in sorted(found.items())]


def build(items: DataFrame, key: str = "item_id", text: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> list[Index]:
    """The index, in blocks by length class and size; each block has at most about ``max_bytes`` of text."""
    rows = A.pick(items, key, text).toDF("id", "text").where("text IS NOT NULL").distinct()
    rows = staged(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    words = A.map_arrow(rows.select("item", "text"), _item_words, "item bigint, words array<bigint>, answer_at bigint")
    words = words.where(F.size("words") > 0).join(rows.select("item", "id", F.octet_length("text").alias("bytes")), "item")
    shortest = F.lit(SHORTEST_CLASS)
    limit = F.greatest(shortest, F.pow(2, F.ceil(F.log2(F.size("words")))).cast("int"))
    words = staged(words.withColumn("limit", limit), "item-words")
    sizes = {r.limit: r.bytes for r in words.groupBy("limit").agg(F.sum("bytes").alias("bytes")).collect()}
    if not sizes:
        return []
    terms = words.select("item", F.size("words").alias("length"), F.explode("words").alias("term"))
    terms = terms.groupBy("item", "length", "term").agg(F.count("*").alias("tf"))
    total = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(total.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(total.mean))))
    scored = staged(terms.join(df, "term").select("item", "term", (idf * tf).alias("impact")), "item-impacts")
    own = scored.groupBy("item").agg(F.sum("impact").alias("own"))
    postings = scored.join(own, "item").select("item", "term", (F.col("impact") / F.col("own")).alias("impact"))
    out = []
    for size in sorted(sizes):
        blocks = -(-sizes[size] // max_bytes)
        for b in range(blocks):
            chosen = words.where((F.col("limit") == size) & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == b))
            out.append(_block(size, chosen, postings))
    return [x for x in out if x is not None]


def _block(limit: int, words: DataFrame, postings: DataFrame) -> Index | None:
    items = words.select("item", "id", "words", "answer_at").orderBy("item").collect()
    if not items:
        return None
    own = postings.join(words.select("item"), "item").toPandas()
    number = {r["item"]: k for k, r in enumerate(items)}
    item = own["item"].map(number).to_numpy(dtype=np.int64)
    term = own["term"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.lexsort((item, term))
    vocabulary, firsts = np.unique(term[order], return_index=True)
    return Index(
        limit,
        [np.array(r["words"], dtype=np.int64).view(np.uint64) for r in items],
        [r["answer_at"] for r in items],
        [r["id"] for r in items],
        vocabulary,
        np.append(firsts, len(order)),
        item[order],
        own["impact"].to_numpy(dtype=float)[order],
    )


def _hits(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for piece in A.pieces(batches, 1):
            found = search(index, piece.column(1))
            rows = pa.array([f[0] for f in found], pa.int64())
            ids = pa.array([index.ids[f[1]] for f in found], id_type)
            scores = [pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)]
            names = ["id", "item", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), ids, *scores], names=names)

    return run


def _clean(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for piece in A.pieces(batches, place):
            stays = np.ones(piece.num_rows, dtype=bool)
            stays[[f[0] for f in search(index, piece.column(place))]] = False
            yield piece.filter(pa.array(stays))

    return run


def contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document and verified item: both ids, score, question_overlap, answer_overlap."""
    spark = documents.sparkSession
    rows = A.pick(documents, key, text).toDF("id", "text")
    item_field = items.schema[items.columns.index(item)]
    id_type = pa.int64() if item_field.dataType.simpleString() == "bigint" else pa.string()
    kind = "bigint" if pa.types.is_int64(id_type) else "string"
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {kind}, score double, question_overlap double, answer_overlap double"
    items = A.pick(items, item, text).toDF("item_id", "text").withColumn("item_id", F.col("item_id").cast(kind))
    out = spark.createDataFrame([], schema)
    for index in build(items):
        out = out.unionByName(A.map_arrow(rows, _hits(spark.sparkContext.broadcast(index), id_type), schema))
    return out.withColumnsRenamed({"id": key, "item": item})


def clean(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with the columns they have, that hold no verified item."""
    spark, place = documents.sparkSession, documents.columns.index(text)
    rows = A.by_place(documents)
    schema = rows.schema
    for index in build(items):
        rows = A.map_arrow(rows, _clean(spark.sparkContext.broadcast(index), place), schema)
    return rows.toDF(*documents.columns)
