"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of ``0.8`` or more.

Two sets of sizes a <= b that link differ in at most (a + b) / 9 shingles. Sizes fall into bands, each
twice as wide as the one before; a set takes part in its own band and, if partners can be there, in the
next. A band cuts the universe of shingles by hash into segments. If a set is given units of search,
one for a segment that must agree wholly, two for one that may differ in one shingle, and has more
units than the difference allows, every partner is met in one of the searched segments (pigeonhole).

- Signatures: the hash of each segment's subset; for the few wide segments also of the subset without
  one of its shingles. Empty subsets count only for a set that has too few others; so a wide segment of
  one shingle, which a partner may lack without a signature for it, counts as a narrow one.
- Cost: a signature that no other set has costs nothing to search. A set whose free units suffice has
  no partner and is done; the others search their cheapest signatures besides, the frequent ones last.
- Candidates: per signature, each set is compared with one hub; sets linked by then are one component
  and need no more pairs among them; then the next hub, until few pairs between components are left,
  which are all compared. So no group is expanded into its pairs, and no link between components is lost.
- Pruning: a set shares 4 (a + b) / 9 or more with a partner. Its shingles that no candidate of another
  component has bound the sizes a partner can have; where no such size occurs, the set is settled.
- Verification counts the shared shingles of a candidate pair. Sets are told apart by 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words than a shingle is one
shingle; a null text or one without words has the empty set and links with nothing. Rows with equal
sets are one class whatever their ids; the component is the smallest id that is not null. Only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.staging import staged
from stormglass.llm import arrow as A
from stormglass.llm.components import components

SHINGLE = 5
FIRST_SIZE = 4
MAX_ROWS = 30_000
KNOWN = 255
MAX_HUB_ROUNDS = 4
MANY_PAIRS = 1000  # pairs per entry, before sizes are compared, that make another round with hubs worth it


@dataclass(frozen=True)
class Band:
    """Sets of ``least`` to ``most`` shingles; ``narrow`` segments of weight 1, ``wide`` ones of weight 2."""

    number: int
    least: int
    most: int
    narrow: int
    wide: int


def _band(k: int) -> Band:
    least = FIRST_SIZE << k
    most = 2 * least - 1
    units = 2 * most // 9 + 1
    if k == 0:
        return Band(k, least, most, 0, 1)
    if k == 1:
        return Band(k, least, most, 0, 3)
    if k == 2:
        return Band(k, least, most, 3, 3)
    return Band(k, least, most, units + units // 10 + 2, 2)


BANDS = [_band(k) for k in range(40)]


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, behind each other; where each text's begin, and the end."""
    data, begins = A.spaced(column)
    data = A.LOWER[data]
    starts, ends = A.runs(A.NOT_SPACE[data])
    firsts = np.searchsorted(starts, begins)
    hashes = A.Hasher(data)(starts, ends)
    at, shingles = A.windows(hashes, firsts, SHINGLE)
    bounds = np.searchsorted(at, firsts)
    words = np.diff(firsts)
    sets = []
    for d in range(len(words)):
        if words[d] >= SHINGLE:
            sets.append(np.unique(shingles[bounds[d] : bounds[d + 1]]))
        elif words[d]:
            few = hashes[firsts[d] : firsts[d + 1]]
            whole = np.append(few * A.PLACES[: len(few)], A.PLACES[8 + len(few)])
            sets.append(A.mix(whole.sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(shingles[:0])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def set_keys(flat: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One number per set: a mixed sum over its shingles and its size."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(flat ^ A.PLACES[9]))])
    own = sums[firsts[1:]] - sums[firsts[:-1]]
    return A.mix(own + np.diff(firsts).astype(np.uint64) * A.PLACES[10]).astype(np.int64)


def _signatures(flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray, band: Band):
    """Signatures of sets in one band.

    ``owner``: set of each shingle. Gives arrays (set, signature, code) and per set (needed, available)
    units. Codes: 0 narrow, 1 + 2w the whole of wide segment w, 2 + 2w the same without one shingle.
    A set whose own units are fewer than needed posts empty subsets too and has ``available`` negative,
    minus all units: they hold only against partners that do the same, the others find it by their own.
    """
    parts, segments = band.narrow + 2 * band.wide, band.narrow + band.wide
    salt = A.mix(np.array([band.number + 77], dtype=np.uint64))[0]
    mixed = A.mix(flat + salt)
    part = (mixed % np.uint64(parts)).astype(np.int64)
    segment = np.where(part < band.narrow, part, band.narrow + (part - band.narrow) // 2)
    place = owner * segments + segment
    total = len(sizes) * segments
    sums = np.zeros(total, dtype=np.uint64)
    value = A.mix(mixed ^ A.PLACES[11])
    np.add.at(sums, place, value)
    counts = np.bincount(place, minlength=total)
    names = np.tile(A.mix(np.arange(segments, dtype=np.uint64) + salt), len(sizes))
    name = lambda s, n, at: A.mix(s + n.astype(np.uint64) * A.PLACES[12] + names[at])

    partner = np.minimum(sizes * 5 // 4, band.most)
    needed = (sizes + partner) // 9 + 1
    units = np.where(np.arange(segments) < band.narrow, 1, 2)
    worth = np.minimum(counts.reshape(len(sizes), segments), units)
    available = worth.sum(1)
    few = available < needed
    available = np.where(few, -units.sum(), available)
    empty_too = np.repeat(few, segments)

    whole = np.flatnonzero((counts > 0) | empty_too)
    column = whole % segments
    as_narrow = (column < band.narrow) | ((counts[whole] == 1) & ~empty_too[whole])
    code = np.where(as_narrow, 0, 1 + 2 * (column - band.narrow))
    wide = np.flatnonzero((segment >= band.narrow) & ((counts[place] > 1) | empty_too[place]))
    at = place[wide]
    sets = np.concatenate([whole // segments, owner[wide]])
    signatures = np.concatenate([name(sums[whole], counts[whole], whole), name(sums[at] - value[wide], counts[at] - 1, at)])
    codes = np.concatenate([code, 2 + 2 * (segment[wide] - band.narrow)]).astype(np.uint8)
    return sets, signatures, codes, needed, available


def band_signatures(flat: np.ndarray, firsts: np.ndarray):
    """Signatures of every set in every band it takes part in.

    Gives (slot, signature, code) arrays and, per slot, (set, band, needed, available): a slot is one
    set in one band.
    """
    sizes = np.diff(firsts)
    own = np.floor(np.log2(np.maximum(sizes, 1) / FIRST_SIZE + 1e-12)).astype(np.int64)
    outs, slots, count = [], [], 0
    for k in range(int(own.max(initial=-1)) + 2):
        band = BANDS[k]
        takes = np.flatnonzero((sizes >= FIRST_SIZE) & ((own == k) | ((own == k - 1) & (sizes * 5 // 4 >= band.least))))
        if not len(takes):
            continue
        shingles = np.concatenate([flat[firsts[s] : firsts[s + 1]] for s in takes])
        owner = np.repeat(np.arange(len(takes)), sizes[takes])
        sets, signatures, codes, needed, available = _signatures(shingles, owner, sizes[takes], band)
        outs.append((sets + count, signatures, codes))
        slots.append((takes, np.full(len(takes), k), needed, available))
        count += len(takes)
    if not outs:
        none = np.zeros(0, np.int64)
        return (none, none.astype(np.uint64), none.astype(np.uint8)), (none, none, none, none)
    return tuple(np.concatenate(c) for c in zip(*outs)), tuple(np.concatenate(c) for c in zip(*slots))


#: One schema for what the first pass sends on: kind 0 rows, 1 slots, 2 packed signatures, 3 signatures.
_FIELDS = [
    ("kind", pa.int32(), "int"),
    ("deal", pa.int32(), "int"),
    ("id", None, None),
    ("node", pa.int64(), "bigint"),
    ("size", pa.int64(), "bigint"),
    ("source", pa.int64(), "bigint"),
    ("band", pa.int32(), "int"),
    ("signature", pa.int64(), "bigint"),
    ("code", pa.int32(), "int"),
    ("needed", pa.int64(), "bigint"),
    ("available", pa.int64(), "bigint"),
    ("packed", pa.binary(), "binary"),
]


def _schema(id_type: str) -> str:
    return ", ".join(f"{name} {spark or id_type}" for name, _, spark in _FIELDS)


def _rows(n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    arrays = []
    for name, kind, _ in _FIELDS:
        kind, value = kind or id_type, columns.get(name)
        if value is None:
            arrays.append(pa.nulls(n, kind))
        elif isinstance(value, pa.Array):
            arrays.append(value)
        else:
            arrays.append(pa.array(np.broadcast_to(value, (n,)) if np.ndim(value) == 0 else value, kind))
    return pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in _FIELDS])


def _first_pass(buckets: int):
    """Rows, slots, and signatures packed by bucket of the signature.

    Copies within a piece send one set of signatures. A signature that several sets of a piece have is
    known to be shared: its entries are sent on as they are, dealt by set, and the bucket gets one mark.
    So a bucket receives one entry per signature and piece, or one per set for the rare ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in A.pieces(batches, 2):
            for at in range(0, piece.num_rows, MAX_ROWS):
                yield from _pack(piece.slice(at, MAX_ROWS), buckets)

    return run


def _pack(piece: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    flat, firsts = shingle_sets(piece.column(2))
    nodes, sizes, id_type = set_keys(flat, firsts), np.diff(firsts), piece.column(0).type
    deal = (nodes.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    yield _rows(
        len(nodes), id_type, kind=0, deal=np.arange(len(nodes)) % buckets, id=piece.column(0), node=nodes, size=sizes, source=piece.column(1)
    )
    _, one = np.unique(nodes, return_index=True)
    one = one[sizes[one] >= FIRST_SIZE]
    if not len(one):
        return
    flat = np.concatenate([flat[firsts[i] : firsts[i + 1]] for i in one])
    firsts = np.concatenate([[0], np.cumsum(sizes[one])])
    (slot, signature, code), (own, band, needed, available) = band_signatures(flat, firsts)
    slot_node = nodes[one[own]]
    yield _rows(len(own), id_type, kind=1, deal=deal[one[own]], node=slot_node, band=band, needed=needed, available=available)

    order = np.argsort(signature)
    slot, signature, code = slot[order], signature[order], code[order]
    head = np.concatenate([[True], signature[1:] != signature[:-1]])
    group = np.cumsum(head) - 1
    begins = np.flatnonzero(head)
    several = np.minimum.reduceat(own[slot], begins) != np.maximum.reduceat(own[slot], begins)
    shared = several[group]
    yield _rows(
        int(shared.sum()),
        id_type,
        kind=3,
        deal=deal[one[own[slot[shared]]]],
        node=slot_node[slot[shared]],
        band=band[slot[shared]],
        signature=signature[shared].view(np.int64),
        code=code[shared].astype(np.int32),
    )
    marks = signature[begins[several]]
    node = np.concatenate([slot_node[slot[~shared]], np.zeros(len(marks), np.int64)])
    where = np.concatenate([slot[~shared], np.full(len(marks), len(own))])
    bands = np.concatenate([band[slot[~shared]], np.zeros(len(marks), np.int64)])
    signature = np.concatenate([signature[~shared], marks])
    code = np.concatenate([code[~shared], np.full(len(marks), KNOWN, np.uint8)])
    bucket = ((signature >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket * (len(own) + 1) + where, kind="stable")
    bucket, where, node, bands, signature, code = (x[order] for x in (bucket, where, node, bands, signature, code))
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    dealt, packed = [], []
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        heads = np.flatnonzero(np.concatenate([[True], where[lo + 1 : hi] != where[lo : hi - 1]]))
        runs = np.diff(np.concatenate([heads, [hi - lo]])).astype(np.uint32)
        sizes_of = np.array([hi - lo, len(heads)], dtype=np.int64)
        parts = [sizes_of, signature[lo:hi], node[lo:hi][heads], runs, bands[lo:hi][heads].astype(np.uint8), code[lo:hi]]
        dealt.append(b)
        packed.append(b"".join(p.tobytes() for p in parts))
    yield _rows(len(dealt), id_type, kind=2, deal=np.array(dealt, dtype=np.int32), packed=pa.array(packed, pa.binary()))


def _unpack(raw: bytes):
    n, m = np.frombuffer(raw, np.int64, 2)
    at = 16
    out = []
    for kind, count in ((np.uint64, n), (np.int64, m), (np.uint32, m), (np.uint8, m), (np.uint8, n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += int(count) * np.dtype(kind).itemsize
    signature, node, runs, band, code = out
    return signature, np.repeat(node, runs), np.repeat(band, runs), code


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and slots go through; of the packed signatures those stay that several sets have."""
    id_type, held = None, []
    for batch in batches:
        id_type = batch.schema.field("id").type
        packed = batch.column(len(_FIELDS) - 1)
        through = batch.filter(packed.is_null())
        if through.num_rows:
            yield through
        held.extend(_unpack(raw) for raw in packed.drop_null().to_pylist())
    if not held:
        return
    signature, node, band, code = (np.concatenate(c) for c in zip(*held))
    held = None
    order = np.argsort(signature)
    ordered = signature[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begins = np.flatnonzero(head)
    own = node[order]
    several = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins)
    several |= np.maximum.reduceat(code[order], begins) == KNOWN
    stay = order[several[np.cumsum(head) - 1]]
    stay = stay[code[stay] != KNOWN]
    for at in range(0, len(stay), 200_000):
        part = stay[at : at + 200_000]
        yield _rows(
            len(part),
            id_type,
            kind=3,
            node=node[part],
            band=band[part].astype(np.int32),
            signature=signature[part].view(np.int64),
            code=code[part].astype(np.int32),
        )


def allocate(needed: int, available: int, entries: list[tuple[int, int, int]]) -> tuple[bool, set[int]]:
    """Whether a slot can have partners, and the signatures it searches.

    ``entries``: (frequency, signature, code) of its shared signatures. A unit whose signatures no other
    set has is free; for what is still needed the cheapest units are taken, by the sum of frequencies.
    With ``available`` negative, empty subsets count as well, and as a partner may not have posted its own,
    the slot stays to be found.
    """
    units: list[tuple[int, list[int]]] = []
    wide: dict[int, tuple[list, list]] = {}
    free = abs(available)
    for frequency, signature, code in entries:
        if code == 0:
            units.append((frequency, [signature]))
            free -= 1
        else:
            wide.setdefault((code - 1) // 2, ([], []))[(code - 1) % 2].append((frequency, signature))
    for whole, without in wide.values():
        free -= 2 if whole else 1
        first = [s for _, s in whole]
        cost = sum(f for f, _ in whole)
        if whole:
            units.append((cost, first))
        units.append((cost + sum(f for f, _ in without), first + [s for _, s in without]))
    lacking = needed - free
    if lacking <= 0:
        return available < 0, set()
    searched: set[int] = set()
    for _, signatures in sorted(units)[:lacking]:
        searched.update(signatures)
    return True, searched


def _allocated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of every slot that may have partners; one slot's entries at a time are Python objects."""
    for batch in batches:
        nodes, needed, available = (batch.column(i).to_pylist() for i in range(3))
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        frequency, signature, code = (lists.values.field(f).to_numpy() for f in ("frequency", "signature", "code"))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for slot, node in enumerate(nodes):
            own = slice(ends[slot], ends[slot + 1])
            signatures = signature[own]
            lives, searched = allocate(
                needed[slot], available[slot], list(zip(frequency[own].tolist(), signatures.tolist(), code[own].tolist()))
            )
            if lives:
                once = np.unique(signatures)
                asked = np.isin(once, np.fromiter(searched, np.int64, len(searched)))
                out.append((once, np.full(len(once), node), asked))
        found = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["signature", "node", "searches"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in A.pieces(batches, 0):
        flat, firsts = shingle_sets(piece.column(0))
        nodes = set_keys(flat, firsts)
        _, one = np.unique(nodes, return_index=True)
        sizes = np.diff(firsts)[one]
        values = np.concatenate([flat[firsts[i] : firsts[i + 1]] for i in one]) if len(one) else flat
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64))
        )
        yield pa.RecordBatch.from_arrays([pa.array(nodes[one]), lists], names=["node", "shingles"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 80 * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    near = both.where(F.greatest(F.size("x"), F.size("y")) * 4 <= F.least(F.size("x"), F.size("y")) * 5)
    shared = near.select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.size(F.array_intersect("x", "y")).alias("common"))
    return shared.where(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * 80).select("a", "b")


def _least_partner(size: Column) -> Column:
    """Smallest size that a partner can have."""
    return F.ceil(size * 4 / 5).cast("long")


def _most_partner(size: Column, alone: Column) -> Column:
    """Largest size of a partner, for a set with ``alone`` shingles that no candidate has: the partner
    shares 4 / 9 of both sizes' sum or more, and the others are too few for more."""
    return F.least(F.floor(size * 5 / 4), F.floor((size * 5 - alone * 9) / 4)).cast("long")


def _alone(sets: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, size, alone): shingles of each set that no set of another component among ``nodes`` has;
    without ``nodes`` every set is a component."""
    if nodes is None:
        single = sets.select("no", F.explode("shingles").alias("shingle"))
        spread = single.groupBy("shingle").agg(F.min("no").alias("no"), F.max("no").alias("last"))
        alone = spread.where("no = last").select("no")
        sized = sets.select("no", "node", "size")
    else:
        own = sets.join(nodes, "node")
        single = own.select("no", "component", F.explode("shingles").alias("shingle"))
        spread = single.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        alone = spread.where("lo = hi").select("shingle").join(single.select("shingle", "no"), "shingle").select("no")
        sized = own.select("no", "node", "size")
    counts = alone.groupBy("no").agg(F.count("*").alias("alone"))
    return sized.join(counts, "no", "left").select("node", "size", F.coalesce("alone", F.lit(0)).alias("alone"))


def _live(entries: DataFrame) -> DataFrame:
    """Entries of signatures that have two components and an entry that searches, and in them the sets
    whose sizes of possible partners occur; the others are settled."""
    known = entries.groupBy("signature").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.max("searches").alias("any"),
        F.min("size").alias("small"),
        F.max("most").alias("wide"),
    )
    kept = entries.join(known.where("lo < hi AND any"), "signature").where("most >= small AND size <= wide")
    return kept.select("signature", "node", "component", "searches", "size", "most")


def _open(entries: DataFrame, alone: DataFrame) -> DataFrame:
    """Entries that may still hold a link between components, with size and ``most``, a partner's largest size."""
    sizes = alone.withColumn("most", _most_partner(F.col("size"), F.col("alone"))).where(_least_partner(F.col("size")) <= F.col("most"))
    entries = entries.select("signature", "node", "component", "searches")
    return staged(_live(entries.join(sizes.select("node", "size", "most"), "node")), "jaccard-open")


def _can_link(a: str, b: str) -> Column:
    return (F.col(f"{a}size") <= F.col(f"{b}most")) & (F.col(f"{b}size") <= F.col(f"{a}most")) & (F.col(f"{a}searches") | F.col(f"{b}searches"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _hub_pairs(entries: DataFrame, hubs: DataFrame) -> DataFrame:
    sides = entries.join(hubs, "signature").where((F.col("node") != F.col("h_node")) & (F.col("component") != F.col("h_component")))
    return sides.where(_can_link("", "h_")).select(*_pair("node", "h_node")).distinct()


def _few_pairs(entries: DataFrame) -> DataFrame:
    """All pairs between components, where signatures hold few of them."""
    a, b = (entries.select("signature", *[F.col(c).alias(f"{side}_{c}") for c in entries.columns if c != "signature"]) for side in "ab")
    both = a.join(b, "signature").where((F.col("a_component") < F.col("b_component")) & _can_link("a_", "b_"))
    return both.select(*_pair("a_node", "b_node")).distinct()


def _cross_pairs(entries: DataFrame) -> DataFrame:
    """All pairs between components, each from the smallest signature at which it is a candidate, so that
    sets with many signatures in common make one row."""
    own = entries.groupBy("node").agg(
        F.collect_list("signature").alias("all"), F.collect_list(F.when(F.col("searches"), F.col("signature"))).alias("asked")
    )
    rows = entries.join(own, "node")
    a = rows.select(*[F.col(c).alias(c if c == "signature" else f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(c if c == "signature" else f"b_{c}") for c in rows.columns])
    met = F.concat(F.array_intersect("a_asked", "b_all"), F.array_intersect("a_all", "b_asked"))
    both = a.join(b.withColumnRenamed("signature", "b_signature"), (F.col("signature") == F.col("b_signature")) & (F.col("a_component") < F.col("b_component")) & _can_link("a_", "b_") & (F.array_min(met) == F.col("signature")))
    return both.select(*_pair("a_node", "b_node"))


def _with_components(rows: DataFrame, known: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """The rows with the component of ``node``; a node that is in none is its own."""
    named = known.select(F.col("node").alias(node), F.col("component").alias("_known"))
    joined = rows.drop(component).join(named, node, "left")
    return joined.withColumn(component, F.coalesce("_known", node)).drop("_known")


def _joined(known: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, component) once the edges ``found`` are known, too; only they are joined anew."""
    if known is None:
        return staged(components(found).withColumnRenamed("id", "node"), "jaccard-known")
    between = _with_components(_with_components(found, known, "a", "ca"), known, "b", "cb")
    merged = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("_at"), F.col("component").alias("_to"))
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    nodes = known.unionByName(ends.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
    moved = nodes.join(merged, nodes["component"] == merged["_at"], "left")
    return staged(moved.select("node", F.coalesce("_to", "component").alias("component")), "jaccard-known")


def _links(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that verified links join, over whatever the entries connect.

    A hub is the set of a signature that meets the most sets over all its signatures, as the origin of a
    group of edited copies does. Rounds with hubs end when few pairs are left or a round links nothing.
    """
    spark, known = entries.sparkSession, None
    left = _open(entries.withColumn("component", F.col("node")), _alone(sets))
    for turn in range(MAX_HUB_ROUNDS):
        by_component = left.groupBy("signature", "component").agg(F.count("*").alias("n"))
        held = by_component.groupBy("signature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        held = staged(held, "jaccard-held")
        total = held.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs")).first()
        if not total.n:
            break
        few = total.pairs <= (MANY_PAIRS if turn else 2) * total.n
        last = few or turn == MAX_HUB_ROUNDS - 1 or (turn > 0 and not linked)
        if last:
            pairs = _few_pairs(left) if total.pairs <= 2 * total.n else _cross_pairs(left)
        else:
            meets = left.join(held.select("signature", "n"), "signature").groupBy("node").agg(F.sum("n").alias("meets"))
            best = F.max(F.struct("meets", "node", "component", "size", "most", "searches")).alias("hub")
            hubs = left.join(meets, "node").groupBy("signature").agg(best)
            hubs = hubs.select("signature", *[F.col(f"hub.{c}").alias(f"h_{c}") for c in ("node", "component", "size", "most", "searches")])
            hubs = staged(hubs, "jaccard-hubs")
            pairs = _hub_pairs(left, hubs)
        found = staged(_linked(pairs, sets), "jaccard-links")
        linked = found.count()
        if linked:
            known = _joined(known, found)
        if last:
            break
        rest = left.join(hubs.select("signature", "h_node"), "signature").where("node != h_node").drop("h_node")
        rest = staged(_live(rest if known is None else _with_components(rest, known)), "jaccard-live")
        left = _open(rest, _alone(sets, rest.select("node", "component").distinct()))
    return spark.createDataFrame([], "node bigint, component bigint") if known is None else known


def join(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_shingles (size of its set) and component_id (smallest id reachable by links)."""
    out = _classified(documents, key, text)
    return out.select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _classified(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, source (hash of the text), size, and where the set is not empty component and component_id."""
    spark: SparkSession = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = A.pick(documents, key, text).toDF("id", "text").select("id", F.xxhash64("text").alias("source"), "text")
    schema = _schema(rows.schema["id"].dataType.simpleString())
    dealt = A.map_arrow(rows, _first_pass(buckets), schema).repartition(buckets, "deal")
    seen = staged(A.map_arrow(dealt, _second_pass, schema).drop("packed", "deal"), "jaccard-seen")

    info = seen.where("kind = 0")
    # every signature that came through has several sets; copies of a set may repeat its rows
    shared = seen.where("kind = 3").select("node", "band", "signature", "code")
    frequent = shared.groupBy("signature").agg(F.count("*").alias("frequency"))
    per_slot = (
        shared.join(frequent, "signature")
        .groupBy("node", "band")
        .agg(F.collect_set(F.struct("frequency", "signature", "code")).alias("entries"))
    )
    slots = seen.where("kind = 1").groupBy("node", "band").agg(F.max("needed").alias("needed"), F.max("available").alias("available"))
    judged = A.map_arrow(
        per_slot.join(slots, ["node", "band"]).select("node", "needed", "available", "entries"),
        _allocated,
        "signature bigint, node bigint, searches boolean",
    )
    entries = staged(judged.groupBy("signature", "node").agg(F.max("searches").alias("searches")), "jaccard-entries")

    wanted = info.join(entries.select("node").distinct(), "node").groupBy("node").agg(F.min("source").alias("source"))
    wanted = staged(wanted.select("source").distinct(), "jaccard-wanted")
    if wanted.count() * 8 <= 32 << 20:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, "source", "left_semi").select("text")
    sets = A.map_arrow(texts, _sets, "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = sets.select("node", "shingles", F.size("shingles").cast("long").alias("size"), F.monotonically_increasing_id().alias("no"))
    sets = staged(sets, "jaccard-sets")
    found = _links(entries, sets)

    classes = info.where("size > 0").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = staged(classes, "jaccard-classes")
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "component").select("node", "component", "component_id")
    return info.join(named, "node", "left").select("id", "source", "size", "component", "component_id")


def _few(df: DataFrame) -> DataFrame:
    """The written table of rows of two numbers, with a broadcast hint if it has 32 MB at most."""
    return F.broadcast(df) if df.count() * 24 <= 32 << 20 else df


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it has: the one of smallest id, of equal ids the one of
    smallest text hash, of rows with equal id and text any one. A text without words is in no group, and a
    row without an id cannot be named as a member: both always stay."""
    rows = _classified(documents, key, text).where("id IS NOT NULL AND component IS NOT NULL").select("id", "source", "component")
    members = rows.groupBy("component", "id", "source").agg(F.count("*").alias("copies"))
    members = staged(members, "jaccard-members")
    first = members.groupBy("component").agg(F.min(F.struct("id", "source")).alias("first"))
    marked = members.join(first, "component").select("id", "source", "copies", (F.struct("id", "source") == F.col("first")).alias("stays"))
    marked = staged(marked.where("copies > 1 OR NOT stays").select("id", "source", "stays"), "jaccard-marked")
    place = [f"_{documents.columns.index(c)}" for c in (key, text)]
    keyed = A.by_place(documents).withColumns({"id": F.col(place[0]), "source": F.xxhash64(place[1])})
    gone, repeated = (staged(marked.where(c).select("id", "source"), "jaccard-gone") for c in ("NOT stays", "stays"))
    kept = keyed.join(_few(gone), ["id", "source"], "left_anti")
    if repeated.count():
        several = _few(repeated)
        once = kept.join(several, ["id", "source"], "left_semi").dropDuplicates(["id", "source"])
        kept = kept.join(several, ["id", "source"], "left_anti").unionByName(once)
    return kept.select(*A.by_place(documents).columns).toDF(*documents.columns)
