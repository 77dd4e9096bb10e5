"""Quality rules: a decision list learned by sequential covering, applied as a Spark conditional.

``text_statistics`` counts a few things per document, ``learn`` grows and prunes conjunctions of
thresholds on them from labelled rows, ``DecisionList.verdict`` is the ordered CASE WHEN of the result.
A null or empty text has zeros everywhere. Rows with a null or other label are no examples. Without
examples of both classes the list is empty and its verdict is "keep". Repeated rows count once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormglass.llm import arrow as A

COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
]
SYMBOLS = A.table(b"#*$%&|<>")
UPPER = A.table(bytes(range(65, 91)))
MARKS = A.table(b"!\"'(),-./:;=?@[\\]^_`{}~+")
MAX_EXAMPLES = 20_000

#: Feature name -> (count, per which count). Each is a plain number of a document.
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "capitals_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of an Arrow array."""
    data, begins = A.spaced(column)
    hasher = A.Hasher(data)
    word = A.NOT_SPACE[data]
    starts, ends = A.runs(word)
    firsts = np.searchsorted(starts, begins)
    n_docs = len(begins) - 1
    sums = lambda member: A.per_document(member, begins)
    out = {
        "n_words": np.diff(firsts),
        "word_chars": sums(word & ((data & 0xC0) != 0x80)),
        "n_symbols": sums(SYMBOLS[data]),
        "n_upper": sums(UPPER[data]),
        "n_marks": sums(MARKS[data]),
    }
    owner = np.repeat(np.arange(n_docs, dtype=np.uint64), out["n_words"])
    salt = A.mix(np.arange(n_docs, dtype=np.uint64) + np.uint64(1))
    hashes = hasher(starts, ends)
    at, triples = A.windows(hashes, firsts, 3)
    again = at[_repeats(triples + salt[owner[at].astype(np.int64)])]
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = A.per_document(covered, firsts)

    stops = np.flatnonzero(data == 10)
    heads = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    line_firsts = np.searchsorted(heads, begins)
    out["n_lines"] = np.diff(line_firsts)
    filled = np.searchsorted(starts, stops) > np.searchsorted(starts, heads)
    line_owner = np.repeat(np.arange(n_docs), out["n_lines"])[filled]
    keys = hasher(heads[filled], stops[filled]) + salt[line_owner]
    _, first_at = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[first_at] = False
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n_docs)
    return out


def _counter(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in A.pieces(batches, place):
            counts = count_texts(piece.column(place))
            arrays = [pa.array(counts[c], pa.int64()) for c in COUNTS]
            names = [*piece.schema.names, *COUNTS]
            yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=names)

    return run


def text_statistics(df: DataFrame, text: str = "text", carry: bool = True) -> DataFrame:
    """The input by place (_0, _1, ...; left out unless ``carry``) and COUNTS of its text column."""
    rows = A.by_place(df if carry else df.select(text))
    place = df.columns.index(text) if carry else 0
    return A.map_arrow(rows, _counter(place), A.wider(rows, ", ".join(f"{c} bigint" for c in COUNTS)))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    columns = []
    for count, per in FEATURES.values():
        x = np.asarray(counts[count], dtype=float)
        columns.append(x if per is None else x / np.maximum(np.asarray(counts[per], dtype=float), 1.0))
    return np.stack(columns, axis=1) if columns else np.zeros((0, 0))


def feature_column(name: str) -> Column:
    count, per = FEATURES[name]
    x = F.col(count).cast("double")
    return x if per is None else x / F.greatest(F.col(per), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    @property
    def column(self) -> Column:
        v = feature_column(self.feature)
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules: the first whose conditions all hold rejects the document; without one it is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for rule in self.rules:
            out |= _covers(rule, x)
        return out

    @property
    def verdict(self) -> Column:
        """CASE WHEN rule 1 THEN 1 WHEN rule 2 THEN 2 ... END: number of the rule that rejects, else null."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = rule[0].column
            for c in rule[1:]:
                holds = holds & c.column
            out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        lines = [f"{k}. reject if {' and '.join(map(str, r))}" for k, r in enumerate(self.rules, 1)]
        return "\n".join([*lines, f"{len(lines) + 1}. keep"])


def _covers(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """Threshold with the largest information gain for the rejected class, times what it covers of it."""
    total_bad, total = int(bad.sum()), len(bad)
    base = np.log2(total_bad / total)
    best, found = 1e-9, None
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        for above in (False, True):
            p = (total_bad - b[cuts]) if above else b[cuts]
            n = (total - cuts - 1) if above else cuts + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best = float(gain[k])
                found = Condition(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best, found


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < max_conditions and bad.any() and not bad.all():
        _, condition = _best_condition(x, bad)
        if condition is None:
            break
        rule.append(condition)
        inside = condition.holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def _worth(rule, x: np.ndarray, bad: np.ndarray) -> float:
    inside = _covers(rule, x)
    p = int((inside & bad).sum())
    n = int(inside.sum()) - p
    return (p - n) / (p + n) if p + n else -1.0


def cover(
    x: np.ndarray, bad: np.ndarray, prune: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9
) -> DecisionList:
    """Sequential covering: grow a rule on the rows outside ``prune``, cut conditions off its end while
    that does not lower (p - n) / (p + n) on the others, take the rows it covers away, go on until a rule
    is right less often than ``precision`` on rows it was not grown on."""
    left = np.ones(len(bad), dtype=bool)
    rules = []
    while len(rules) < max_rules and (bad & left & ~prune).any():
        growing, pruning = left & ~prune, left & prune
        rule = _grow(x[growing], bad[growing], max_conditions)
        if not rule:
            break
        options = [rule[:k] for k in range(1, len(rule) + 1)]
        worth = [_worth(r, x[pruning], bad[pruning]) for r in options]
        rule = options[int(np.argmax(worth))]
        if max(worth) < 2 * precision - 1:
            break
        rules.append(tuple(rule))
        left &= ~_covers(rule, x)
    return DecisionList(tuple(rules))


def learn(
    documents: DataFrame,
    labels: DataFrame,
    max_examples: int = MAX_EXAMPLES,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DecisionList:
    """Decision list from at most ``max_examples`` labelled documents, those of smallest key hash.

    The bound is on the examples of the fit alone; a null key has no label. Ties go by key, so every
    run learns the same list; ids of any type serve, texts by their hash. Examples that the base rules reject teach nothing and are left out.
    """
    known = A.pick(labels, key, label).toDF("id", "label").where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    texts = A.pick(documents, key, text).toDF("id", "text")
    examples = texts.join(F.broadcast(chosen), "id")
    measured = text_statistics(examples.select("id", "label", "text"), "text").drop("_2")
    measured = measured.where(~base_failed())
    whole = isinstance(measured.schema["_0"].dataType, T.IntegralType)
    number = F.col("_0").cast("bigint") if whole else F.xxhash64("_0")
    rows = measured.select(number.alias("id"), F.col("_1").alias("label"), *COUNTS).orderBy("id", *COUNTS).toPandas()
    if rows.empty or rows["label"].nunique() < 2:
        return DecisionList()
    x = features({c: rows[c].to_numpy() for c in COUNTS})
    ids = A.mix(rows["id"].to_numpy().astype(np.int64).astype(np.uint64))
    return cover(x, rows["label"].to_numpy() == 0, (ids >> np.uint64(20)) % np.uint64(3) == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(documents: DataFrame, rules: DecisionList, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, COUNTS, base_failed, number of the rejecting rule (else null), kept."""
    measured = text_statistics(A.pick(documents, key, text).toDF("key", "text"), "text")
    out = measured.select(F.col("_0").alias(key), *COUNTS, base_failed().alias("base_failed"), rules.verdict.alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(documents: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns of the input."""
    measured = text_statistics(documents, text)
    good = measured.where(~base_failed() & rules.verdict.isNull())
    return good.select(*[f"_{i}" for i in range(len(documents.columns))]).toDF(*documents.columns)
