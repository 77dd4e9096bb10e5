"""Arrow batches as numpy arrays: texts, words, lines and their hashes.

A batch is cut into pieces of a few MB, so the arrays of a task stay small however many rows a batch
has; only one text that is larger by itself makes a larger piece. Hashes have 64 bits: a sum over the
characters of a random number per byte times a power for its place, mixed at the end, so equal strings
have equal hashes and two different ones agree with a probability near 2**-64.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACES = b" \t\n\x0b\x0c\r"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_NUMBERS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


NOT_SPACE = ~table(SPACES)
#: Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing.
WORD = table(b"0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow whose workers find this package, as far as they see the driver's installation.

    A worker serves task after task; what one has taken goes back when it ends. Batches are held in the JVM
    and in the worker, so a session that keeps Spark's default of 64 MB gets batches of ``BATCH_BYTES``.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) == "67108864b":
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def wider(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df``, whatever its columns are called, and further columns given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def give_back() -> None:
    """Free memory that numpy, Arrow and the C library keep for later use goes to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_place(df: DataFrame) -> DataFrame:
    """The same rows with columns _0, _1, ..., so that no name of the input can clash with ours."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str, **extra: Column) -> DataFrame:
    """The first column of each name; every other column, clashing or not, is left out."""
    places = [df.columns.index(n) for n in names]
    return by_place(df).select(*[F.col(f"_{p}").alias(n) for p, n in zip(places, names)], *[c.alias(n) for n, c in extra.items()])


def offsets_of(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], place: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, each of at most ``limit`` bytes of text or one row."""
    for batch in batches:
        ends = offsets_of(batch.column(place))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other, a line feed after each; where each begins, and the end. Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    ends = offsets_of(column)
    buffer = column.buffers()[2] if n else None
    data = np.frombuffer(buffer, dtype=np.uint8)[ends[0] : ends[-1]] if buffer else np.zeros(0, np.uint8)
    lengths = np.diff(ends)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(begins[-1]), 10, dtype=np.uint8)
    kept = np.ones(len(out), dtype=bool)
    kept[begins[1:] - 1] = False
    out[kept] = data
    return out, begins


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end; the last element is False."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(member[1:] != member[:-1]) + 1
    if member[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES * 5 // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * PIECE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any slices of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        sums = BYTE_NUMBERS[data]
        sums *= _powers(_BASE, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(sums, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * PLACES[15])


def windows(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word, and hash, of every ``size`` consecutive words of one document.

    ``firsts``: index of each document's first word, and the end.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(len(hashes) + 1, dtype=np.int32)
    counts = np.diff(firsts)
    full = counts >= size
    np.add.at(inside, firsts[:-1][full], 1)
    np.add.at(inside, firsts[1:][full] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total += hashes[at + k] * PLACES[k]
    return at, mix(total)


def per_document(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``firsts``, also where a document has none."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[firsts[1:]] - sums[firsts[:-1]]
