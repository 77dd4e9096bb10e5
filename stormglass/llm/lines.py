"""Line dedup that can be undone: exact reference counts per line, cuckoo filters of the repeated ones.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; its
128-bit hash stands for it in two longs. An index keeps, in a folder that all executors reach,

- ``refs``: for every key the number of documents (rows) that have it, exact;
- ``filters``: for every shard of the key space a cuckoo filter of the keys found in ``min_docs``
  documents or more. A cuckoo filter forgets what is taken out, so documents can be deleted again.

``insert`` and ``delete`` add or subtract the counts of a batch and move the keys that cross
``min_docs`` into or out of their shard's filter. A mark can stand for another key only within one table,
so a shard whose filter has grown several tables and loses keys gets a new filter from the counts. ``strip`` asks the filter for every line; a line it
does not know stays without any look-up, the others are checked against the exact counts.

A row is a document; repeated rows count once each. A null or empty text is one empty line; an empty
key is never dropped. A null text stays null. Columns of other names pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.staging import staged
from stormglass.llm import arrow as A

MAX_SHIPPED_BYTES = 64 << 20
SLOTS = 4
MAX_LOAD = 0.85
MAX_ROUNDS = 200
KEY_BYTES = 16


class CuckooFilter:
    """16-bit fingerprints in buckets of four; all operations take arrays of keys.

    A full table gets another, twice as large, beside it, so nothing has to be read again to grow.
    """

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @staticmethod
    def _marks(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = A.mix(k1.astype(np.uint64) ^ A.PLACES[0])
        return spot, ((A.mix(k2.astype(np.uint64)) >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    @staticmethod
    def _other(bucket: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
        turn = A.mix(mark.astype(np.uint64) + A.PLACES[1]).astype(np.int64)
        return bucket ^ (turn & (buckets - 1))

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        spot, mark = self._marks(k1, k2)
        found = np.zeros(len(k1), dtype=bool)
        for table in self.tables:
            first = (spot & np.uint64(len(table) - 1)).astype(np.int64)
            second = self._other(first, mark, len(table))
            found |= (table[first] == mark[:, None]).any(1) | (table[second] == mark[:, None]).any(1)
        return found

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        spot, mark = self._marks(k1, k2)
        if self.tables:
            room = max(0, int(self.tables[-1].size * MAX_LOAD) - int(np.count_nonzero(self.tables[-1])))
            if room and self._place(self.tables[-1], spot[:room], mark[:room]):
                spot, mark = spot[room:], mark[room:]
        take = len(spot)
        while len(spot):
            have = len(self.tables[-1]) if self.tables else 0
            least = 1 << max(4, int(np.ceil(np.log2(take / (SLOTS * MAX_LOAD)))))
            fresh = np.zeros((max(2 * have, least) if take == len(spot) else least, SLOTS), dtype=np.uint16)
            if self._place(fresh, spot[:take], mark[:take]):
                self.tables.append(fresh)
                spot, mark = spot[take:], mark[take:]
                take = len(spot)
            else:  # more than eight equal marks in two buckets: they need tables of their own
                take = (take + 1) // 2

    def _place(self, table: np.ndarray, spot: np.ndarray, mark: np.ndarray) -> bool:
        """Puts all marks into the table, in rounds: what finds its bucket full goes to its other bucket,
        and from the second round on pushes a mark out of there. When rounds run out, all is taken back."""
        buckets = len(table)
        before = table.copy()
        at, marks = (spot & np.uint64(buckets - 1)).astype(np.int64), mark.copy()
        generator = np.random.Generator(np.random.PCG64(buckets))
        for turn in range(MAX_ROUNDS):
            order = np.argsort(at, kind="stable")
            at, marks = at[order], marks[order]
            head = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            empty = table[at] == 0
            has = rank < empty.sum(1)
            which = np.argmax(np.cumsum(empty[has], axis=1) == (rank[has] + 1)[:, None], axis=1)
            table[at[has], which] = marks[has]
            at, marks, rank = at[~has], marks[~has], rank[~has]
            if not len(at):
                return True
            pusher = np.concatenate([[True], at[1:] != at[:-1]])
            if turn:
                victim = generator.integers(0, SLOTS, int(pusher.sum()))
                out = table[at[pusher], victim]
                table[at[pusher], victim] = marks[pusher]
                marks[pusher] = out
            at = self._other(at, marks, buckets)
        table[:] = before
        return False

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Clears one equal mark per key. Equal marks are interchangeable within a table but not between
        tables, where another key's may go instead: with several tables, build the filter anew."""
        spot, mark = self._marks(k1, k2)
        for table in self.tables:
            flat = table.reshape(-1)
            left = np.ones(len(spot), dtype=bool)
            first = (spot & np.uint64(len(table) - 1)).astype(np.int64)
            for bucket in (first, self._other(first, mark, len(table))):
                for slot in range(SLOTS):
                    place = bucket * SLOTS + slot
                    match = np.flatnonzero(left & (flat[place] == mark))
                    _, one = np.unique(place[match], return_index=True)
                    flat[place[match[one]]] = 0
                    left[match[one]] = False
            spot, mark = spot[left], mark[left]

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.tables), *map(len, self.tables)], dtype=np.int64)
        return sizes.tobytes() + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, tables = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            tables.append(np.frombuffer(raw, np.uint16, size * SLOTS, at).reshape(size, SLOTS).copy())
            at += 2 * SLOTS * size
        return cls(tables)


def split_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and their keys' hashes, empty for an empty key."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip(A.SPACES).lower() for x in lines]
    return lines, [xxhash.xxh3_128_digest(k) if k else b"" for k in keys]


def as_longs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2) of every distinct key of every row."""
    for piece in A.pieces(batches, 1):
        hashes, counts = [], []
        for text in _raw(piece.column(1)):
            own = {h for h in split_keys(text)[1] if h}
            hashes.extend(own)
            counts.append(len(own))
        keys = as_longs(hashes)
        rows = np.repeat(np.arange(piece.num_rows), counts)
        yield pa.RecordBatch.from_arrays(
            [piece.column(0).take(pa.array(rows)), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["id", "k1", "k2"]
        )


def line_keys(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = A.pick(documents, key, text).toDF("id", "text")
    return A.map_arrow(rows, _keys, f"id {rows.schema['id'].dataType.simpleString()}, k1 bigint, k2 bigint")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: the filter's row first, then the keys to move; gives the new filter."""
    shard, held, moves = None, CuckooFilter(), []

    def done():
        k = np.concatenate(moves) if moves else np.zeros((0, 3), dtype=np.int64)
        for word, rows in (("remove", k[k[:, 2] < 0]), ("add", k[k[:, 2] > 0])):
            if len(rows):
                getattr(held, word)(rows[:, 0], rows[:, 1])
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([len(held.tables)], pa.int32()), pa.array([held.to_bytes()], pa.binary())],
            names=["shard", "tables", "filter"],
        )

    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shards)]):
            if hi == lo:
                continue
            if shards[lo] != shard:
                if shard is not None:
                    yield done()
                shard, held, moves = int(shards[lo]), CuckooFilter(), []
            part = batch.slice(lo, hi - lo)
            blob = part.column(4)
            if blob.null_count < len(blob):
                held = CuckooFilter.from_bytes(blob[0].as_py())
                part = part.slice(1)
            moves.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2, 3)], axis=1))
    if shard is not None:
        yield done()


class LineIndex:
    """Reference counts and filters of the documents inserted so far.

    ``shards``: filters, by default as many as shuffle partitions, so one filter and its changes fit a
    task. ``max_shipped``: while the repeated keys take at most so many bytes, they and the filters go
    to every task; beyond, lines are joined with them by key and documents by id. Both give the same.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, shards: int | None = None, max_shipped: int = MAX_SHIPPED_BYTES):
        self.spark, self.min_docs, self.max_shipped = spark, min_docs, max_shipped
        self.shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None

    def insert(self, documents: DataFrame, text: str = "text") -> None:
        self._change(documents, text, 1)

    def delete(self, documents: DataFrame, text: str = "text") -> None:
        """Takes documents out again; they must have been inserted with the same text."""
        self._change(documents, text, -1)

    def _change(self, documents: DataFrame, text: str, sign: int) -> None:
        bare = A.pick(documents, text).toDF("text").select(F.lit(None).cast("int").alias("id"), "text")
        change = line_keys(bare, "id", "text").groupBy("k1", "k2").agg((F.count("*") * sign).alias("n"))
        if self.refs is None:
            merged = change.select("k1", "k2", F.lit(0).cast("long").alias("old"), F.col("n").alias("refs"))
        else:
            had = self.refs.select("k1", "k2", F.col("refs").alias("old"), F.lit(0).cast("long").alias("n"))
            both = had.unionByName(change.withColumn("old", F.lit(0).cast("long")))
            merged = both.groupBy("k1", "k2").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("n")).alias("refs"))
        merged = staged(merged.where("refs > 0 OR old > 0"), "line-refs")
        none, shard = F.lit(None), F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")
        known = F.col("refs") >= self.min_docs
        move = F.when(known, 1).otherwise(-1).cast("int").alias("move")
        crossed = merged.where(known != (F.col("old") >= self.min_docs)).select(shard, "k1", "k2", move)
        filters = self.filters
        if filters is not None and sign < 0:
            lossy = crossed.where("move < 0").select("shard").join(filters.where("tables > 1").select("shard"), "shard")
            anew = F.broadcast(staged(lossy.distinct(), "line-anew"))  # one row per shard at most
            kept = merged.where(known).select(shard, "k1", "k2", move).join(anew, "shard", "left_semi")
            crossed = crossed.join(anew, "shard", "left_anti").unionByName(kept)
            filters = filters.join(anew, "shard", "left_anti")
        crossed = crossed.withColumn("filter", none.cast("binary"))
        if filters is not None:
            held = [none.cast("long").alias("k1"), none.cast("long").alias("k2"), none.cast("int").alias("move")]
            crossed = filters.select("shard", *held, "filter").unionByName(crossed)
        ordered = crossed.repartition(self.shards, "shard").sortWithinPartitions("shard", F.col("filter").isNull())
        self.refs = merged.where("refs > 0").select("k1", "k2", "refs")
        self.filters = staged(A.map_arrow(ordered, _moved, "shard int, tables int, filter binary"), "line-filters")

    @property
    def repeated(self) -> DataFrame:
        """Keys of ``min_docs`` documents or more, from the exact counts."""
        return self.refs.where(F.col("refs") >= self.min_docs).select("k1", "k2")

    def strip(self, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The documents without their repeated lines, by place (_0, _1, ...), n_lines and n_dropped."""
        size = self.repeated.count() * KEY_BYTES + (self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0)
        rows = A.by_place(documents)
        place = documents.columns.index(text)
        schema = A.wider(rows, "n_lines bigint, n_dropped bigint")
        if size <= self.max_shipped:
            return A.map_arrow(rows, _drop_shipped(place, self._ship()), schema)
        hits = self._suspects(line_keys(documents, key, text)).join(self.repeated, ["k1", "k2"])
        hits = hits.groupBy("id").agg(F.collect_set(F.struct("k1", "k2")).alias("hits"))
        id_of = F.col(f"_{documents.columns.index(key)}")
        joined = rows.join(hits, id_of.eqNullSafe(F.col("id")), "left").drop("id")
        return A.map_arrow(joined, _drop_joined(place), schema)

    def _ship(self):
        found = self.repeated.orderBy("k1", "k2").toArrow()
        keys = np.stack([found.column(c).to_numpy() for c in ("k1", "k2")], axis=1)
        filters = {r.shard: r.filter for r in self.filters.collect()}
        return self.spark.sparkContext.broadcast((self.shards, filters, keys))

    def _suspects(self, lines: DataFrame) -> DataFrame:
        """Lines that the filters may know. Each shard's filter is sent to several tasks, and the lines
        of a shard are dealt over these, since a frequent line may be in a third of all documents."""
        copies = 8
        shard = F.pmod("k1", F.lit(self.shards)).cast("int")
        spread = F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int")
        kind = lines.schema["id"].dataType
        tagged = lines.select(shard.alias("shard"), spread.alias("copy"), "id", "k1", "k2", F.lit(None).cast("binary").alias("filter"))
        none = F.lit(None)
        sent = self.filters.select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
            none.cast(kind).alias("id"),
            none.cast("long").alias("k1"),
            none.cast("long").alias("k2"),
            "filter",
        )
        both = sent.unionByName(tagged).repartition("shard", "copy")
        ordered = both.sortWithinPartitions("shard", "copy", F.col("filter").isNull())
        return A.map_arrow(ordered, _suspected, f"id {kind.simpleString()}, k1 bigint, k2 bigint")


def _suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, held = None, CuckooFilter()
    for batch in batches:
        shards, blobs = batch.column(0).to_numpy(), batch.column(5)
        has = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, has, [len(shards)]])).astype(int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if shards[lo] != shard:
                shard, held = int(shards[lo]), CuckooFilter()
            part = batch.slice(lo, hi - lo)
            if part.column(5)[0].is_valid:
                held = CuckooFilter.from_bytes(part.column(5)[0].as_py())
                part = part.slice(1)
            k1, k2 = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
            if len(k1):
                known = part.filter(pa.array(held.contains(k1, k2)))
                yield pa.RecordBatch.from_arrays([known.column(c) for c in (2, 3, 4)], names=["id", "k1", "k2"])


def _dropper(piece: pa.RecordBatch, place: int, dropped_of) -> pa.RecordBatch:
    """``dropped_of(hashes of all lines, number of lines per row)``: which lines go."""
    texts = _raw(piece.column(place))
    split = [split_keys(t) for t in texts]
    counts = np.array([len(lines) for lines, _ in split], dtype=np.int64)
    flat = [h for _, hashes in split for h in hashes]
    filled = np.array([bool(h) for h in flat], dtype=bool)
    drop = np.zeros(len(flat), dtype=bool)
    drop[filled] = dropped_of(as_longs(flat), np.repeat(np.arange(len(texts)), counts)[filled])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    gone = A.per_document(drop, firsts)
    out = []
    for i, (text, (lines, _)) in enumerate(zip(texts, split)):
        if gone[i]:
            own = drop[firsts[i] : firsts[i + 1]].tolist()
            text = b"\n".join([line for line, d in zip(lines, own) if not d])
        out.append(text)
    columns = list(piece.columns)
    columns[place] = pa.array(out, pa.binary()).cast(pa.string())
    names = [*piece.schema.names, "n_lines", "n_dropped"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(gone)], names=names)


def _drop_shipped(place: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, blobs, keys = shipped.value
        filters = {s: CuckooFilter.from_bytes(b) for s, b in blobs.items()}

        def dropped(hashes: np.ndarray, _) -> np.ndarray:
            out = np.zeros(len(hashes), dtype=bool)
            shard = np.mod(hashes[:, 0], shards)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(own) and int(shard[own[0]]) in filters:
                    out[own] = filters[int(shard[own[0]])].contains(hashes[own, 0], hashes[own, 1])
            suspects = np.flatnonzero(out)
            lo = np.searchsorted(keys[:, 0], hashes[suspects, 0], side="left")
            hi = np.searchsorted(keys[:, 0], hashes[suspects, 0], side="right")
            for s, a, b in zip(suspects.tolist(), lo.tolist(), hi.tolist()):
                out[s] = bool((keys[a:b, 1] == hashes[s, 1]).any())
            return out

        for piece in A.pieces(batches, place):
            yield _dropper(piece, place, dropped)

    return run


def _drop_joined(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in A.pieces(batches, place):
            hits = [
                {(h["k1"], h["k2"]) for h in own or ()} for own in piece.column(piece.num_columns - 1).to_pylist()
            ]

            def dropped(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
                return np.array([(a, b) in hits[r] for (a, b), r in zip(hashes.tolist(), rows.tolist())], dtype=bool)

            rows = pa.RecordBatch.from_arrays(piece.columns[:-1], names=piece.schema.names[:-1])
            yield _dropper(rows, place, dropped)

    return run


def dedup(documents: DataFrame, min_docs: int = 10, key: str = "doc_id", text: str = "text", **index) -> DataFrame:
    """The documents, with the columns they have, without the lines found in ``min_docs`` of them."""
    lines = LineIndex(documents.sparkSession, min_docs, **index)
    lines.insert(documents, text)
    stripped = lines.strip(documents, key, text)
    return stripped.drop("n_lines", "n_dropped").toDF(*documents.columns)
