"""Token counts without tokens: Viterbi over a unigram vocabulary that carries score and count only.

A text is read with a space before it and every space as the vocabulary's space mark. No piece has a
mark behind another character, so the best path never crosses from a character to a mark: each run of
marks with the characters behind it is a problem of its own, solved once and kept for its repetitions.
An Aho-Corasick automaton enumerates all vocabulary matches of a run; dynamic programming keeps, per
place, the best score and the number of pieces on that path. The tokenizer's rules decide ties: the
first candidate by start wins, so the longest last piece; a character without a piece of its own costs
the lowest score less 10 and counts one piece per UTF-8 byte where the vocabulary has byte pieces.

A null or empty text has no tokens and the score 0. Rows are independent; columns of other names are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stormglass.llm import arrow as A

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_CACHED = 500_000
MAX_CACHED_BYTES = 64


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Best score and number of pieces of runs."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary):
            raise ValueError("a piece has a space mark behind another character")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {piece for piece, _ in vocabulary}
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scores: list[float] = []
        self.counts: list[int] = []
        self.arrays = (np.zeros(0), np.zeros(0, np.int64))

    def solve(self, run: str) -> tuple[float, int]:
        n = len(run)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown = [False] * (n + 1)
        at, score, pieces, start, single = 0, None, 0, 0, False

        def close(to: int) -> None:
            nonlocal at, score, single
            while at < to:
                if not single:
                    candidate = best[at] + self.unknown
                    if score is None or candidate > score:
                        own = len(run[at].encode()) if self.bytes else int(not unknown[at])
                        best[at + 1], count[at + 1], unknown[at + 1] = candidate, count[at] + own, True
                    else:
                        best[at + 1], count[at + 1] = score, pieces
                else:
                    best[at + 1], count[at + 1] = score, pieces
                at, score, single = at + 1, None, False

        for end, (length, value) in self.automaton.iter(run):
            close(end)
            first = end + 1 - length
            candidate = best[first] + value
            if score is None or candidate > score or (candidate == score and first < start):
                score, pieces, start = candidate, count[first] + 1, first
            single = single or length == 1
        close(n)
        return best[n], count[n]

    def count_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces and best score of every text."""
        data, begins = A.spaced(column)
        heads = begins[:-1]
        filled = np.diff(begins) > 1
        space = data == 32
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[heads] = False
        cut[begins[1:] - 1] = True
        starts = np.flatnonzero(cut)
        # a run goes from one cut to the next; the first of a text begins with the space put before it
        lows = np.concatenate([[0], starts[:-1] + np.isin(starts[:-1], begins[1:] - 1)]) if len(starts) else starts
        firsts = np.searchsorted(starts, begins)
        opening = np.zeros(len(starts), dtype=bool)
        opening[firsts[:-1]] = True
        if len(self.known) > MAX_CACHED:
            self._forget()
        raw, known = data.tobytes(), self.known
        runs = [raw[a:b] for a, b in zip(lows.tolist(), starts.tolist())]
        for k in np.flatnonzero(opening).tolist():
            runs[k] = b" " + runs[k]
        places = list(map(known.get, runs))
        own = []
        for k in np.flatnonzero(np.array(places, dtype=object) == None).tolist():  # noqa: E711
            run = runs[k]
            place = known.get(run)
            if place is None:
                score, count = self.solve(run.decode().replace(" ", MARK))
                place = known[run] = len(self.scores)
                self.scores.append(score)
                self.counts.append(count)
                if len(run) > MAX_CACHED_BYTES:
                    own.append(run)
            places[k] = place
        if len(self.arrays[0]) != len(self.scores):
            self.arrays = (np.array(self.scores, dtype=float), np.array(self.counts, dtype=np.int64))
        for run in own:
            del known[run]
        place = np.array(places, dtype=np.int64)
        counts = A.per_document(self.arrays[1][place], firsts)
        scores = np.add.reduceat(self.arrays[0][place], firsts[:-1]) if len(place) else np.zeros(0)
        return np.where(filled, counts, 0), np.where(filled, scores, 0.0)


def _mapper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)  # ends with the task: workers serve other stages too
        for piece in A.pieces(batches, 1):
            counts, scores = counter.count_texts(piece.column(1))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(counts, pa.int64()), pa.array(scores)], names=["id", "n_tokens", "score"]
            )

    return run


def count_tokens(
    documents: DataFrame, vocabulary: list[tuple[str, float]], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the id, n_tokens and the score of the best path. A vocabulary has a fixed size and goes to every task."""
    rows = A.pick(documents, key, text).toDF("id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, score double"
    return A.map_arrow(rows, _mapper(shared), schema).withColumnRenamed("id", key)
