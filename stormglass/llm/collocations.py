"""Phrase collocations: the phrases of 2 to 5 words whose parts meet more often than by chance, per language.

A text is lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.

- Words are counted per language; n is their sum.
- Cutting: a phrase found ``least`` times or more has only words, pairs and triples of neighbours found as
  often. So pairs of frequent words are counted, and texts fall into chains of frequent pairs, which are
  written; triples are counted in the chains, and a window ends before the first triple that is rarer. Which
  words, pairs and triples are frequent goes to the tasks as bitmaps of fixed size over hashed places: two in
  one place keep a window longer than need be, they never lose a count.
- Top-order marginalisation: each word begins one window of up to five words, the columns w1 to w5, padded
  with 0 behind its end. Only these longest windows are counted; a ROLLUP over the columns sums them
  for the shorter prefixes, and a prefix is a phrase with all its occurrences, as each begins one window.
- Cuts, the smallest score and the phrases inside longer ones are joins and aggregates over the phrases found.

Nulls: a null language is ``und``, a null text is empty. Repeated rows count as often as they stand there.
Equal scores take the smaller cut, equal ranks go by phrase in byte order. Only the two named columns are
read; an empty table gives no rows. Words and phrases are counted by 64-bit hashes. Products are decimals of
38 digits, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.staging import staged
from stormglass.llm import arrow as A

LONGEST = 5
WORD_BITS = 26
PAIR_BITS = 27
HELD = 1 << 20  # rows that a task holds before it counts and sends them
PIECE = 2 << 20
SLICE = 1024  # words of chains in a row; a longer chain stays whole
SLICES = 64  # rows of chains that a task lays out at a time
BREAK = A.table(b".,;:!?\n\x0b\x0c\r")
INSIDE = ~(BREAK | A.table(b" \t"))
COLUMNS = [f"w{i + 1}" for i in range(LONGEST)]


def _words(piece: pa.RecordBatch):
    """Of every word of a piece (language, text): start, end, hash, language; whether the next one follows
    in the same piece of text; and the bytes."""
    data, begins = A.spaced(piece.column(1))
    data = A.LOWER[data]
    starts, ends = A.runs(INSIDE[data])
    breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
    joined = np.zeros(len(starts), dtype=bool)
    joined[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
    languages = piece.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(begins, starts, side="right") - 1]
    return starts, ends, A.Hasher(data)(starts, ends), languages, joined, data


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def _word_keys(words: np.ndarray, languages: np.ndarray) -> np.ndarray:
    return A.mix(words * A.PLACES[0] + languages.view(np.uint64) * A.PLACES[1])


def _pair_keys(keys: np.ndarray) -> np.ndarray:
    """Key of each word with the next one; its language is in the words' keys."""
    return A.mix(keys[:-1] * A.PLACES[2] + keys[1:] * A.PLACES[3])


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _in(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    place = _places(keys, bits)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in A.pieces(batches, 1, PIECE):
        starts, ends, words, languages, _, data = _words(piece)
        keys = _word_keys(words, languages)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(languages[first]),
                pa.array(keys[first].view(np.int64)),
                _strings(data, starts[first], ends[first]),
                pa.array(counts),
            ],
            names=["language", "word", "name", "n"],
        )


def _counted(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row per different row of ``columns``, with its count."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for i, column in enumerate(columns):
        mixed += column.view(np.uint64) * A.PLACES[i]
    _, first, counts = np.unique(A.mix(mixed), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(c[first].view(np.int64)) for c in columns] + [pa.array(counts)], names=[*names, "n"])


def _gathered(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= HELD:
            yield _counted([np.concatenate(c) for c in zip(*held)], names)
            held, rows = [], 0
    if rows:
        yield _counted([np.concatenate(c) for c in zip(*held)], names)


def _count_pairs(frequent):
    def parts(batches):
        for piece in A.pieces(batches, 1, PIECE):
            _, _, words, languages, joined, _ = _words(piece)
            if len(words) > 1:
                keys = _word_keys(words, languages)
                known = _in(frequent.value, keys, WORD_BITS)
                pair = joined[:-1] & known[:-1] & known[1:]
                yield [_pair_keys(keys)[pair]]

    return lambda batches: _gathered(parts(batches), ["pair"])


def _chains(frequent):
    """Rows (language, words) with some chains of a piece, a 0 behind each: words linked by frequent pairs."""

    def run(batches):
        for piece in A.pieces(batches, 1, PIECE):
            _, _, words, languages, joined, _ = _words(piece)
            if len(words) < 2:
                continue
            keys = _word_keys(words, languages)
            linked = np.append(joined[:-1] & _in(frequent.value, _pair_keys(keys), PAIR_BITS), False)
            follows = np.append(False, linked[:-1])
            at = np.flatnonzero(linked | follows)
            if not len(at):
                continue
            begins = ~follows[at]
            chain = np.cumsum(begins) - 1
            out = np.zeros(len(at) + chain[-1] + 1, dtype=np.uint64)
            out[np.arange(len(at)) + chain] = keys[at]
            first = np.flatnonzero(begins)
            spoken, starts = languages[at[first]], first + np.arange(len(first))
            other = (spoken[1:] != spoken[:-1]) | (starts[1:] // SLICE != starts[:-1] // SLICE)
            cut = np.flatnonzero(np.append(True, other))
            offsets = np.append(starts[cut], len(out)).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(spoken[cut]), rows], names=["language", "words"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of chains one after another, and how many each row has."""
    words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return words, lists.value_lengths().to_numpy(zero_copy_only=False)


def _triple_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where three words of one chain begin, and the keys of all places."""
    second, third = (np.append(words[k:], np.zeros(min(k, len(words)), np.uint64)) for k in (1, 2))
    whole = (words != 0) & (second != 0) & (third != 0)
    return whole, A.mix(words * A.PLACES[0] + second * A.PLACES[1] + third * A.PLACES[2])


def _list_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, lengths = _flat(batch.column(0))
        whole, keys = _triple_keys(words)
        ends = np.concatenate([[0], np.cumsum(whole)])[np.concatenate([[0], np.cumsum(lengths)])]
        rows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[whole].view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows], names=["triples"])


def _list_windows(frequent):
    def run(batches):
        for rows in (batch.slice(i, SLICES) for batch in batches for i in range(0, batch.num_rows, SLICES)):
            words, lengths = _flat(rows.column(1))
            whole, keys = _triple_keys(words)
            kept = whole & _in(frequent.value, keys, PAIR_BITS)
            last = len(words) - 1
            begins = (words != 0) & np.append(words[1:] != 0, np.zeros(min(1, len(words)), dtype=bool))
            at = np.flatnonzero(begins)
            columns, alive = [words[at], words[np.minimum(at + 1, last)]], np.ones(len(at), dtype=bool)
            for k in range(2, LONGEST):
                alive = alive & kept[np.minimum(at + k - 2, last)]
                columns.append(np.where(alive, words[np.minimum(at + k, last)], np.uint64(0)))
            ends = np.concatenate([[0], np.cumsum(begins)])[np.concatenate([[0], np.cumsum(lengths)])]
            windows = pa.StructArray.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=COLUMNS)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), windows)
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["language", "windows"])

    return run


def _bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """One bit per hashed place, set where a key falls; 2 ** bits of them, whatever the number of keys."""
    number = F.shiftrightunsigned(key, 64 - bits) + 1  # bucket b holds the numbers from (b - 1) * 32768 + 1 on
    one = F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    rows = keys.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(one)
    out = np.zeros(((1 << bits) // 32768, 4096), dtype=np.uint8)
    for row in rows.toLocalIterator():
        out[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def mine(documents: DataFrame, least: int = 100, top: int = 2000, language: str = "lang", text: str = "text") -> DataFrame:
    """Per language the ``top`` phrases found ``least`` times or more, by score."""
    spark = documents.sparkSession
    named = A.pick(documents, language, text).toDF("lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = named.select(F.xxhash64("lang").alias("language"), "text")

    words = A.map_arrow(rows, _count_words, "language bigint, word bigint, name string, n bigint")
    words = staged(words.groupBy("language", "word", "name").agg(F.sum("n").alias("n")), "phrase-words")
    totals = staged(words.groupBy("language").agg(F.sum("n").alias("total")), "phrase-totals")
    frequent = staged(words.where(F.col("n") >= least), "phrase-frequent-words")

    known = spark.sparkContext.broadcast(_bitmap(frequent.select("word"), "word", WORD_BITS))
    pairs = A.map_arrow(rows, _count_pairs(known), "pair bigint, n bigint")
    pairs = staged(pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"), "phrase-pairs")
    known.unpersist()

    linked = spark.sparkContext.broadcast(_bitmap(pairs, "pair", PAIR_BITS))
    chains = staged(A.map_arrow(rows, _chains(linked), "language bigint, words array<bigint>"), "phrase-chains")
    linked.unpersist()

    triples = A.map_arrow(chains.select("words"), _list_triples, "triples array<bigint>").select(F.explode("triples").alias("triple"))
    triples = staged(triples.groupBy("triple").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("triple"), "phrase-triples")

    whole = spark.sparkContext.broadcast(_bitmap(triples, "triple", PAIR_BITS))
    schema = ", ".join(f"{c}: bigint" for c in COLUMNS)
    windows = A.map_arrow(chains, _list_windows(whole), f"language bigint, windows array<struct<{schema}>>").select("language", F.inline("windows"))
    windows = staged(windows.groupBy("language", *COLUMNS).agg(F.count(F.lit(1)).alias("n")), "phrase-windows")
    whole.unpersist()
    phrases = staged(_prefixes(windows, least), "phrases")
    scored = _scored(phrases, frequent, totals)
    kept = scored.join(_covered(phrases), ["language", "words"], "left_anti")
    languages = named.select("lang", F.xxhash64("lang").alias("language")).distinct()
    return _ranked(kept, frequent, languages, top, language)


def _prefixes(windows: DataFrame, least: int) -> DataFrame:
    """(language, words, a) of every prefix of two words or more that is found ``least`` times or more."""
    summed = windows.rollup("language", *COLUMNS).agg(F.sum("n").alias("a"), F.grouping_id().alias("level"))
    length = F.lit(LONGEST) - F.length(F.regexp_replace(F.bin("level"), "0", ""))
    found = summed.where(F.col("a") >= least).select("language", *COLUMNS, "a", length.cast("int").alias("length"))
    whole = F.slice(F.array(*COLUMNS), 1, F.col("length"))
    found = found.where((F.col("length") >= 2) & F.col("language").isNotNull()).select("language", whole.alias("words"), "a")
    return found.where(~F.array_contains("words", F.lit(0).cast("bigint")))


def _digits(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def _scored(phrases: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases with the counts and score of their worst cut."""
    single = frequent.select("language", F.array("word").alias("words"), F.col("n").alias("a"))
    counts = staged(phrases.unionByName(single), "phrase-counts")
    cuts = phrases.select("language", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    parts = cuts.select(
        "*", F.slice("words", F.lit(1), F.col("cut")).alias("left"), F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")).alias("right")
    )
    left = counts.select("language", F.col("words").alias("left"), F.col("a").alias("l"))
    right = counts.select("language", F.col("words").alias("right"), F.col("a").alias("r"))
    met = parts.join(left, ["language", "left"]).join(right, ["language", "right"]).join(totals, "language")
    score = F.call_function("div", _digits(F.col("a") * 1000) * F.col("total").cast("decimal(20,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
    worst = F.min(F.struct(score.cast("bigint").alias("score"), "cut", "l", "r", F.col("total").alias("n"))).alias("worst")
    return met.groupBy("language", "words", "a").agg(worst).select("language", "words", "a", "worst.l", "worst.r", "worst.n", "worst.score", "worst.cut")


def _covered(phrases: DataFrame) -> DataFrame:
    """Phrases that stand inside a longer one found as often."""
    size = F.size("words")
    within = phrases.where(size > 2).select(
        "language", F.col("a").alias("longer"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("length")
    )
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at")
    inner = within.select("language", "longer", "words", "length", at)
    inner = inner.select("language", "longer", F.slice("words", F.col("at"), F.col("length")).alias("words"))
    most = inner.groupBy("language", "words").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["language", "words"]).where(F.col("longer") * 100 >= F.col("a") * 100).select("language", "words")


def _ranked(kept: DataFrame, frequent: DataFrame, languages: DataFrame, top: int, language: str) -> DataFrame:
    spelled = kept.select("*", F.posexplode("words").alias("place", "word")).join(frequent.select("language", "word", "name"), ["language", "word"])
    spelled = spelled.groupBy("language", "words", "a", "l", "r", "n", "score", "cut").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("names"))
    phrase = F.array_join(F.transform("names", lambda x: x["name"]), " ")
    rows = spelled.select("language", phrase.alias("phrase"), "a", "l", "r", "n", "score", "cut")
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.join(languages, "language").select(F.col("lang").alias(language), "rank", "phrase", "a", "l", "r", "n", "score")
