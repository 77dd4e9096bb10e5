"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score, exact scores decide.

Terms are the runs ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z lower-cased.

Index. Each different text is a signature: every term sets three bits, and three more for each power of two
that its occurrences reach. Texts with about as many entries share a width, and up to ``ROWS`` of them lie side
by side as a block of slices: slice s holds bit s of each row. Beside the blocks stands the number of
documents per term. Both are written tables; building them reads all texts whole.

Search. The slices of a term, met bit by bit, mark the rows that may hold it (and may hold it 2, 4, ... times);
they overestimate. A sum over the slices, weighted by the item's term weights and by what a term can add in a row
of that length, is an upper bound of the score.
1. The rows with the highest bounds are scored exactly from their texts; the k-th best score of an item is its
   threshold.
2. Every row whose bound reaches its item's threshold is scored exactly. All others are provably behind.
3. The best k texts of an item are spelled out to their documents, k per text at most, as copies score alike.

Items are searched in blocks of about ``ITEM_BYTES`` of text, which alone go through the driver; each block
reads the signatures twice and scans the documents for the texts that are still possible.

Nulls and repeats: a null text has no terms and is never found; a null document id ranks behind the others of
its score. Repeated documents are ranked each. Items repeated with id and text are one; an id with several texts
gets a ranking for each. Items and documents without terms give no rows, as do empty tables. Only ids and texts
are read. Texts and terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.staging import release, staged, written_paths
from stormglass.llm import arrow as A

HASHES = 3
BITS_PER_ENTRY = 12
LEVELS = 12
ROWS = 1024
BLOCK_BITS = 1 << 24
ITEM_BYTES = 4 << 20
FIRST = 16  # rows per item and task, then per item, that set the threshold
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Index:
    """Written signatures and term counts of ``documents`` (id, text)."""

    documents: DataFrame
    blocks: DataFrame
    terms: DataFrame
    paths: list[str]

    def release(self) -> None:
        release(self.documents.sparkSession, self.paths)


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms; where each text's begin, and the end."""
    data, begins = A.spaced(column)
    data = A.LOWER[data]
    starts, ends = A.runs(A.WORD[data])
    return A.Hasher(data)(starts, ends), np.searchsorted(starts, begins)


def _entries(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the term, and level, of every entry: level j stands for 2 ** j occurrences or more."""
    at, level = [np.arange(len(terms))], [np.zeros(len(terms), np.int64)]
    for j in range(1, LEVELS):
        often = np.flatnonzero(counts >= 1 << j)
        if not len(often):
            break
        at.append(often)
        level.append(np.full(len(often), j))
    return np.concatenate(at), np.concatenate(level)


def _slots(terms: np.ndarray, level: np.ndarray, width: int) -> np.ndarray:
    """The slices of each entry, one row of ``HASHES``."""
    base = A.mix(terms + level.astype(np.uint64) * A.PLACES[4])
    salts = A.PLACES[5 : 5 + HASHES]
    return (A.mix(base[:, None] + salts[None, :]) % np.uint64(width)).astype(np.int64)


def _class(entries: int) -> int:
    return max(3, int(entries - 1).bit_length())


def _width(kind: int) -> int:
    return BITS_PER_ENTRY << kind


class _Block:
    """Signatures of one width, row by row until they are written as slices."""

    def __init__(self, kind: int):
        self.kind, self.width = kind, _width(kind)
        self.most = max(8, min(ROWS, BLOCK_BITS // self.width))
        self.sources: list[int] = []
        self.copies: list[int] = []
        self.lengths: list[int] = []
        self.slots: list[np.ndarray] = []

    def batch(self) -> pa.RecordBatch:
        bits = np.zeros((self.width, len(self.sources)), dtype=bool)
        for row, slots in enumerate(self.slots):
            bits[slots, row] = True
        slices = np.packbits(bits, axis=1).tobytes()
        lists = [pa.array([c], pa.list_(pa.int64())) for c in (self.sources, self.copies, self.lengths)]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.kind], pa.int32()), *lists, pa.array([slices], pa.binary())],
            names=["kind", "sources", "copies", "lengths", "slices"],
        )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, _Block] = {}
    for piece in A.pieces(batches, 1):
        hashes, firsts = term_hashes(piece.column(1))
        sources = piece.column(0).to_numpy(zero_copy_only=False)
        _, one, copies = np.unique(sources, return_index=True, return_counts=True)
        for i, n in zip(one.tolist(), copies.tolist()):
            own = hashes[firsts[i] : firsts[i + 1]]
            if not len(own):
                continue
            terms, counts = np.unique(own, return_counts=True)
            at, level = _entries(terms, counts)
            kind = _class(len(at))
            block = blocks.setdefault(kind, _Block(kind))
            block.sources.append(int(sources[i]))
            block.copies.append(n)
            block.lengths.append(len(own))
            block.slots.append(np.unique(_slots(terms[at], level, block.width)))
            if len(block.sources) >= block.most:
                yield blocks.pop(kind).batch()
    for block in blocks.values():
        yield block.batch()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in A.pieces(batches, 0):
        hashes, firsts = term_hashes(piece.column(0))
        owner = np.repeat(np.arange(piece.num_rows), np.diff(firsts))
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        if not len(hashes):
            continue
        new_term = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        new = new_term | np.concatenate([[True], owner[1:] != owner[:-1]])
        begins = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[begins].view(np.int64)), pa.array(np.add.reduceat(new.astype(np.int64), begins))], names=["term", "df"]
        )


def build(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    before = set(written_paths(documents.sparkSession))
    rows = A.pick(documents, key, text).toDF("id", "text")
    blocks = A.map_arrow(
        rows.select(F.xxhash64("text").alias("source"), "text"),
        _signatures,
        "kind int, sources array<bigint>, copies array<bigint>, lengths array<bigint>, slices binary",
    )
    blocks = staged(blocks, "search-blocks")
    terms = A.map_arrow(rows.select("text"), _term_counts, "term bigint, df bigint")
    terms = staged(terms.groupBy("term").agg(F.sum("df").alias("df")), "search-terms")
    return Index(rows, blocks, terms, [p for p in written_paths(documents.sparkSession) if p not in before])


@dataclass
class Items:
    """A block of items: per item its terms by place in ``terms``, and the terms' weights."""

    terms: np.ndarray
    weights: np.ndarray
    of_item: list[np.ndarray]
    documents: int
    occurrences: int

    def part(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What ``tf`` occurrences in a document of ``n`` terms add, per unit of weight."""
        m = 100 - 90 + (90 * n * self.documents) // self.occurrences
        return (UNIT * tf) // (1000 * tf + 8 * m)

    def bounds(self, kind: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bound of the score of every item (rows) in every row of a block (columns)."""
        rows, width = len(lengths), _width(kind)
        packed = np.frombuffer(slices, np.uint8).reshape(width, -1)
        out = np.zeros((len(self.of_item), rows))
        below = np.zeros(rows, dtype=np.int64)
        alive = np.arange(len(self.terms))
        for level in range(LEVELS):
            slots = _slots(self.terms[alive], np.full(len(alive), level), width)
            met = packed[slots[:, 0]]
            for h in range(1, HASHES):
                met = met & packed[slots[:, h]]
            some = met.any(axis=1)
            alive, met = alive[some], met[some]
            if not len(alive):
                break
            weighted = np.zeros((len(self.terms), rows), dtype=np.float32)
            weighted[alive] = np.unpackbits(met, axis=1, count=rows)
            weighted[alive] *= self.weights[alive, None].astype(np.float32)
            most = lengths if level == LEVELS - 1 else np.minimum(lengths, (2 << level) - 1)
            top = np.maximum(self.part(most, lengths), below)
            live = np.zeros(len(self.terms), dtype=bool)
            live[alive] = True
            for item, own in enumerate(self.of_item):
                own = own[live[own]]
                if len(own):
                    out[item] += weighted[own].sum(axis=0, dtype=np.float64) * (top - below)
            below = top
        return out

    def scores(self, items: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Exact scores of one text for the items asked."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        tf = np.where(terms[at] == self.terms, counts[at], 0) if len(terms) else np.zeros(len(self.terms), np.int64)
        parts = self.weights * self.part(tf, np.int64(n))
        return np.array([parts[self.of_item[i]].sum() for i in items], dtype=np.int64)


def _best_bounds(items, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(items.value.of_item)
        best, sources = np.zeros((n, first)), np.zeros((n, first), dtype=np.int64)
        for own, bound in _blocks(batches, items.value):
            all_bounds = np.concatenate([best, bound], axis=1)
            take = np.argpartition(-all_bounds, first - 1, axis=1)[:, :first]
            best = np.take_along_axis(all_bounds, take, axis=1)
            sources = np.take_along_axis(np.concatenate([sources, np.broadcast_to(own, bound.shape)], axis=1), take, axis=1)
        item, place = np.nonzero(best > 0)
        yield _pairs(item, sources[item, place], best[item, place])

    return run


def _reaching(items, thresholds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, bound in _blocks(batches, items.value):
            item, row = np.nonzero(bound >= thresholds[:, None])
            yield _pairs(item, own[row], bound[item, row])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lengths = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
            yield batch.column(1)[i].values.to_numpy(zero_copy_only=False), items.bounds(
                batch.column(0)[i].as_py(), lengths, batch.column(3)[i].as_py()
            )


def _pairs(item: np.ndarray, source: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(item.astype(np.int32)), pa.array(source), pa.array(bound.astype(np.int64))], names=["item", "source", "bound"]
    )


def _exact(items):
    """Scores of texts for the items that ask for them; a copy within a task is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in A.pieces(batches, 1):
            hashes, firsts = term_hashes(piece.column(1))
            sources = piece.column(0).to_pylist()
            for i, source in enumerate(sources):
                if source in seen:
                    continue
                seen.add(source)
                own = hashes[firsts[i] : firsts[i + 1]]
                asked = piece.column(2)[i].values.to_numpy(zero_copy_only=False)
                score = items.value.scores(asked, *np.unique(own, return_counts=True), len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.int32()), pa.array(np.full(len(asked), source)), pa.array(score)], names=["item", "source", "score"]
                )

    return run


def _small(df: DataFrame, width: int) -> DataFrame:
    """The written table, with a broadcast hint if its rows of ``width`` bytes take 32 MB at most."""
    return F.broadcast(df) if df.count() * width <= 32 << 20 else df


def _scored(index: Index, items, pairs: DataFrame) -> DataFrame:
    """(item, source, score) of all pairs, from the texts."""
    asked = staged(pairs.groupBy("source").agg(F.collect_set("item").alias("items")), "search-asked")
    rows = index.documents.select(F.xxhash64("text").alias("source"), "text")
    texts = rows.join(_small(asked, 64), "source").select("source", "text", "items")
    scored = A.map_arrow(texts, _exact(items), "item int, source bigint, score bigint")
    return staged(scored.where("score > 0").distinct(), "search-scored")


def _first(df: DataFrame, k: int, by: str, *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in A.pieces(batches, 1):
        hashes, firsts = term_hashes(piece.column(1))
        terms = [np.unique(hashes[firsts[i] : firsts[i + 1]]).view(np.int64) for i in range(piece.num_rows)]
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["number", "terms"])


def _items(index: Index, block: DataFrame, documents: int, occurrences: int) -> tuple[list[int], Items]:
    rows = A.map_arrow(block.select("number", "text"), _item_terms, "number bigint, terms array<bigint>").where(F.size("terms") > 0)
    rows = staged(rows, "search-items")
    wanted = staged(rows.select(F.explode("terms").alias("term")).distinct(), "search-wanted")
    found = index.terms.join(F.broadcast(wanted), "term").toArrow()
    terms = found.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, df = terms[order], found.column("df").to_numpy()[order]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    numbers, of_item = [], []
    for row in rows.collect():
        own = np.array(row.terms, dtype=np.int64).view(np.uint64)
        numbers.append(row.number)
        of_item.append(np.flatnonzero(np.isin(terms, own)))
    return numbers, Items(terms, weights, of_item, documents, occurrences)


def top_documents(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """Per item its k best documents: item id, rank, doc_id, score."""
    spark = items.sparkSession
    sums = F.explode(F.arrays_zip("copies", "lengths")).alias("x")
    one = index.blocks.select(sums).agg(F.sum("x.copies").alias("n"), F.sum(F.col("x.copies") * F.col("x.lengths")).alias("l")).first()
    named = A.pick(items, key, text).toDF("item_id", "text").distinct()
    named = staged(named.select("item_id", "text", F.xxhash64("item_id", "text").alias("number")), "search-asked-items")
    size = named.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    parts = -(-size // ITEM_BYTES) if one.n else 0
    found = [_block_top(index, named.where(F.pmod("number", F.lit(parts)) == p), one.n, one.l, k) for p in range(parts)]
    schema = f"number bigint, rank int, doc_id {index.documents.schema['id'].dataType.simpleString()}, score bigint"
    best = spark.createDataFrame([], schema)
    for df in found:
        best = best.unionByName(df)
    return named.join(best, "number").select(F.col("item_id").alias(key), "rank", "doc_id", "score")


def _block_top(index: Index, block: DataFrame, documents: int, occurrences: int, k: int) -> DataFrame:
    spark = block.sparkSession
    numbers, items = _items(index, block, documents, occurrences)
    sent = spark.sparkContext.broadcast(items)
    blocks = index.blocks.select("kind", "sources", "lengths", "slices")
    first = max(FIRST, k)
    schema = "item int, source bigint, bound bigint"
    likely = staged(_first(A.map_arrow(blocks, _best_bounds(sent, first), schema), first, "item", F.desc("bound")), "search-likely")
    scored = _scored(index, sent, likely)
    kth = _first(scored, k, "item", F.desc("score")).groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    thresholds = np.ones(len(numbers))
    for row in kth.where(F.col("n") >= k).collect():
        thresholds[row.item] = row.score
    possible = staged(A.map_arrow(blocks, _reaching(sent, thresholds), schema).distinct(), "search-possible")
    scored = _scored(index, sent, possible)
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") <= k)
    best = staged(best.select("item", "source", "score"), "search-best")
    wanted = staged(best.select("source").distinct(), "search-sources")
    rows = index.documents.select("id", F.xxhash64("text").alias("source")).join(_small(wanted, 16), "source")
    members = staged(_first(rows, k, "source", F.asc_nulls_last("id")).select("source", "id"), "search-members")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = _first(best.join(members, "source"), k, "item", *order)
    names = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "item int, number bigint")
    out = ranked.join(F.broadcast(names), "item").select("number", F.col("place").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
    out = staged(out, "search-top")
    sent.unpersist()
    return out
