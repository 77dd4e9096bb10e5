"""Byte-level BPE: pre-tokenisation as an associative scan, pair merging with a cache, exact decoding.

The split pattern is the common byte-level one: contractions, a word, number or other run with at most
one space before it, white space up to its last character, white space. It is a finite automaton over
classes of characters, so no regular expression is needed: every character is a function from state to
state, the functions and all their compositions are a small finite monoid, and an associative scan over
the monoid's multiplication table gives the state at every place of a piece of many texts at once.
Character classes come from the tokenizer library's own pattern engine.

The slices go through a cache of merged pairs; the output has the token ids and, for every token, the
place in the text's UTF-8 bytes where it ends, so any run of tokens can be traced back to its text.
Special tokens are ordinary text. A null or empty text has no tokens. Rows are independent; columns of
other names are left out.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.llm import arrow as A

LETTER, NUMBER, OTHER, SHORT, LONG, WHITE, SPACE, LAST_WHITE, END = range(9)
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _WHITES, _JOINED, _ONE_MORE, _TWO_MORE = range(8)
_ALONE = [_LETTERS, _NUMBERS, _OTHERS, _ONE_MORE, _TWO_MORE, _WHITES, _JOINED, _FRESH, _FRESH]
_BLOCK = 64
MAX_CACHED = 200_000
PIECE_BYTES = 1 << 20
MAX_CACHED_BYTES = 64
_HEAP_FROM = 200


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a character, and whether the character begins a token."""
    if symbol != END:
        if state in (_ONE_MORE, _TWO_MORE):
            return (_FRESH if state == _ONE_MORE else _ONE_MORE), False
        kind = OTHER if symbol in (SHORT, LONG) else symbol
        if state == _JOINED and kind in (LETTER, NUMBER, OTHER):
            return _ALONE[kind], False
        if (state, kind) in ((_LETTERS, LETTER), (_NUMBERS, NUMBER), (_OTHERS, OTHER), (_WHITES, WHITE)):
            return state, False
    return _ALONE[symbol], True


@lru_cache(1)
def automaton():
    """Monoid of the automaton: element of each symbol, multiplication table, effect on each state, and
    whether a symbol begins a token in a state."""
    symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    elements = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in symbols:
            both = tuple(g[s] for s in f)
            if both not in elements:
                elements[both] = len(elements)
                todo.append(both)
    effect = np.array(list(elements), dtype=np.uint8)
    n = len(elements)
    times = np.zeros((n, n), dtype=np.int32)
    for f, i in elements.items():
        for g, j in elements.items():
            times[i, j] = elements[tuple(g[s] for s in f)]
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([elements[g] for g in symbols], dtype=np.int32), times.ravel(), effect, begins, n


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, as the tokenizer's engine has it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    singles = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=singles, special_tokens={}).encode_ordinary(every)
        text = bytes(found).decode()
        out[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def scan(symbols: np.ndarray) -> np.ndarray:
    """Whether each character begins a token."""
    of_symbol, times, effect, begins, n = automaton()
    rows = -(-len(symbols) // _BLOCK)
    padded = np.full(rows * _BLOCK, END, dtype=np.uint8)
    padded[: len(symbols)] = symbols
    steps = of_symbol[padded.reshape(rows, _BLOCK).T]
    prefix = np.empty_like(steps)
    prefix[0] = steps[0]
    for t in range(1, _BLOCK):
        prefix[t] = times[prefix[t - 1] * n + steps[t]]
    total = prefix[-1].copy()
    shift = 1
    while shift < rows:
        total[shift:] = times[total[:-shift] * n + total[shift:]]
        shift *= 2
    entry = np.zeros(rows, dtype=np.uint8)
    entry[1:] = effect[total[:-1], _FRESH]
    before = np.empty((_BLOCK, rows), dtype=np.uint8)
    before[0] = entry
    before[1:] = effect[prefix[:-1], entry]
    return begins[before.T.ravel()[: len(symbols)], symbols]


def slices(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of all pre-tokens of texts that are followed by one separator byte each."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    separators = np.searchsorted(at, begins[1:] - 1)
    kind = classes()[points]
    white = kind == WHITE
    ends = np.zeros(len(points), dtype=bool)
    ends[separators] = True
    following = np.ones(len(points), dtype=bool)
    following[:-1] = white[1:] | ends[1:]
    last = white & ~following
    kind[last] = LAST_WHITE
    kind[last & (points == 32)] = SPACE
    quotes = np.flatnonzero(points == 39)
    one = np.append(points, [10, 10])[quotes + 1]
    two = np.append(points, [10, 10])[quotes + 2]
    kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    kind[quotes[long]] = LONG
    kind[separators] = END
    heads = np.flatnonzero(scan(kind))
    bounds = np.append(at[heads], len(data))
    real = ~ends[heads]
    return bounds[:-1][real], bounds[1:][real]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, behind each other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    """Ranks of a byte-level BPE; merges of slices are kept up to a number of slices."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}
        by_rank = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.lengths = np.array([len(t) for t in by_rank], dtype=np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(by_rank), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.pool_firsts = array("i"), array("q", [0])
        self.arrays = (np.zeros(0, np.int32), np.zeros(1, np.int64))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of lowest rank, the leftmost of equal ones, is joined until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > _HEAP_FROM:
            return self._merge_long(piece)
        get, none = self.ranks.get, len(self.lengths)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            lowest = min(pairs)
            if lowest == none:
                break
            i = pairs.index(lowest)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over a chained list, for slices of any length."""
        n, get = len(piece), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    to = end[after[left]]
                    rank = get(piece[left:to])
                    if rank is not None:
                        heappush(heap, (rank, left, to))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all slices behind each other, and the number of tokens of each slice."""
        if len(self.known) > MAX_CACHED:
            self._forget()
        raw, known = data.tobytes(), self.known
        cut = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        places = list(map(known.get, cut))
        own: list[bytes] = []
        for k in np.flatnonzero(np.array(places, dtype=object) == None).tolist():  # noqa: E711
            piece = cut[k]
            place = known.get(piece)
            if place is None:
                place = len(self.pool_firsts) - 1
                self.pool.extend(self.merge(piece))
                self.pool_firsts.append(len(self.pool))
                known[piece] = place
                if len(piece) > MAX_CACHED_BYTES:
                    own.append(piece)
            places[k] = place
        if len(self.arrays[1]) != len(self.pool_firsts):
            self.arrays = (np.array(self.pool, dtype=np.int32), np.array(self.pool_firsts, dtype=np.int64))
        pool, firsts = self.arrays
        for piece in own:
            del known[piece]
        place = np.array(places, dtype=np.int64)
        counts = firsts[place + 1] - firsts[place]
        return pool[spread(firsts[place], counts)], counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens behind each other, and each token's number of bytes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("a token id is not in the vocabulary")
        lengths = self.lengths[ids]
        return self.bytes[spread(self.firsts[ids], lengths)], lengths


def _lists(firsts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _encoder(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)  # ends with the task: workers serve other stages too
        for piece in A.pieces(batches, place, PIECE_BYTES):
            data, begins = A.spaced(piece.column(place))
            starts, ends = slices(data, begins)
            ids, counts = vocabulary.encode(data, starts, ends)
            per_slice = np.concatenate([[0], np.cumsum(counts)])
            firsts = per_slice[np.searchsorted(starts, begins)]
            token_ends = np.cumsum(vocabulary.lengths[ids])
            base = np.concatenate([[0], token_ends])[firsts]
            token_ends -= np.repeat(base[:-1], np.diff(firsts))
            columns = [*piece.columns, _lists(firsts, ids), _lists(firsts, token_ends)]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "ids", "ends"])

    return run


def _decoder(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)  # ends with the task: workers serve other stages too
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lists = batch.column(place)
                ends = A.offsets_of(lists)
                to = min(max(int(np.searchsorted(ends, ends[at] + PIECE_BYTES // 4, side="right")) - 1, at + 1), batch.num_rows)
                part = batch.slice(at, to - at)
                own = part.column(place)
                offsets = A.offsets_of(own)
                ids = own.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                data, lengths = vocabulary.decode(ids)
                firsts = np.concatenate([[0], np.cumsum(lengths)])[offsets - offsets[0]].astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(firsts.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])
                at = to

    return run


def _share(df: DataFrame, ranks: str):
    """The rank file's bytes, read once by the driver: a vocabulary has a fixed size."""
    with open(ranks, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(documents: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ids and ends (byte of the text where each token ends). ``ranks``: path of the rank file."""
    rows = A.pick(documents, key, text).toDF(key, "text")
    encoded = A.map_arrow(rows, _encoder(_share(documents, ranks), 1), A.wider(rows, "ids array<int>, ends array<int>"))
    return encoded.drop("text")


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """The input and ``decoded``, the bytes of the tokens of each row; a null list has none."""
    place = encoded.columns.index(ids)
    filled = encoded.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    return A.map_arrow(filled, _decoder(_share(encoded, ranks), place), A.wider(encoded, "decoded binary"))
