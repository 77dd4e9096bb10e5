"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Tokens are runs of letters, digits and non-ASCII bytes or runs of other characters that are not white
space, after lower-casing A-Z. Features are the hashes of single tokens and of pairs, into ``2 ** bits``
places, each valued at the root of its share of all occurrences, so they make a unit vector; two more
tell the length (power of two) and the share of repeated token pairs (tenths), and one is constant. The score is the logistic
function of a sparse dot product. Only texts enter a score.

Training follows the regularised leader per coordinate over at most ``max_examples`` labelled texts,
those of smallest key hash, in one task with a fixed order; all documents are scored. Rows with a null
key or another label than 0 and 1 are no examples; with examples of one class or none the scores come
from the constant and what was learned of it. A null or empty text is scored by the length feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm import arrow as A

BITS = 18
MAX_EXAMPLES = 10_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
SHAPE_VALUE = 0.5
KINDS = np.where(A.WORD, 1, np.where(A.NOT_SPACE, 2, 0)).astype(np.uint8)


def text_features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places and values of all texts' features behind each other; where each text's begin, and the end."""
    data, begins = A.spaced(column)
    data = A.LOWER[data]
    kind = KINDS[data]
    edge = np.ones(len(kind), dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    heads = np.flatnonzero(edge)
    stops = np.append(heads[1:], len(kind))
    token = kind[heads] > 0
    starts, stops = heads[token], stops[token]
    firsts = np.searchsorted(starts, begins)
    hashes = A.Hasher(data)(starts, stops)
    at, pairs = A.windows(hashes, firsts, 2)
    pair_firsts = np.searchsorted(at, firsts)
    texts = np.arange(len(firsts) - 1)
    counts, pair_counts = np.diff(firsts), np.diff(pair_firsts)
    owner = np.repeat(texts, pair_counts)
    keyed = pairs + A.mix(texts.astype(np.uint64))[owner]
    _, one = np.unique(keyed, return_index=True)
    own_pairs = np.bincount(owner[one], minlength=len(texts))
    repeated = 10 * (pair_counts - own_pairs) // np.maximum(pair_counts, 1)
    length = np.floor(np.log2(counts + 1)).astype(np.int64)
    shape = A.mix(np.stack([1 + 0 * texts, 100 + length, 200 + repeated], axis=1).astype(np.uint64) * A.PLACES[13]).ravel()
    owners = np.concatenate([np.repeat(texts, counts), owner])
    places = (np.concatenate([hashes, pairs]) >> np.uint64(64 - bits)).astype(np.int64)
    distinct, times = np.unique((owners << bits) + places, return_counts=True)
    owners = np.concatenate([distinct >> bits, np.repeat(texts, 3)])
    places = np.concatenate([distinct & ((1 << bits) - 1), (shape >> np.uint64(64 - bits)).astype(np.int64)])
    values = np.concatenate([np.sqrt(times / (counts + pair_counts)[distinct >> bits]), np.full(len(shape), SHAPE_VALUE)])
    order = np.argsort(owners, kind="stable")
    return places[order], values[order], np.searchsorted(owners[order], np.arange(len(counts) + 1))


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Leader:
    """Per-coordinate FTRL-proximal with both penalties; weights are zero until their sum passes L1."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(places)
        gradient = (logistic(w @ values) - label) * values
        n = self.n[places]
        self.z[places] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[places] += gradient * gradient


def train(examples: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS) -> np.ndarray:
    """Weights after EPOCHS walks over (places, values, label); places are distinct within an example."""
    leader = Leader(bits)
    for _ in range(EPOCHS):
        for places, values, label in examples:
            leader.learn(places, values, label)
    return leader.weights()


def summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's features with those that share a place with the last three added up."""
    distinct, inverse = np.unique(places, return_inverse=True)
    return distinct, np.bincount(inverse, weights=values)


def _trainer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for piece in A.pieces(batches, 1):
            places, values, firsts = text_features(piece.column(1), bits)
            for i, label in enumerate(piece.column(0).to_pylist()):
                own = slice(firsts[i], firsts[i + 1])
                at, x = summed(places[own], values[own])
                examples.append((at.astype(np.int32), x.astype(np.float32), float(label)))
        weights = train(examples, bits) if examples else np.zeros(1 << bits)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used])], names=["place", "weight"])

    return run


def fit(
    documents: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    max_examples: int = MAX_EXAMPLES,
    bits: int = BITS,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> np.ndarray:
    """Weights learned from the labelled documents; ``allowed``: condition on the column ``id`` of those to use."""
    known = A.pick(labels, key, label).toDF("id", "label").where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    texts = A.pick(documents, key, text).toDF("id", "text").join(F.broadcast(chosen), "id")
    ordered = texts.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text").select("label", "text")
    rows = A.map_arrow(ordered, _trainer(bits), "place bigint, weight double").collect()
    weights = np.zeros(1 << bits)
    for row in rows:
        weights[row.place] = row.weight
    return weights


def score(documents: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and the score, the probability of label 1."""
    rows = A.pick(documents, key, text).toDF("id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        bits = len(w).bit_length() - 1
        for piece in A.pieces(batches, 1):
            places, values, firsts = text_features(piece.column(1), bits)
            dots = np.add.reduceat(w[places] * values, firsts[:-1])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(logistic(dots))], names=["id", "score"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double"
    return A.map_arrow(rows, run, schema).withColumnRenamed("id", key)
