"""License scans: short notices found in whole texts with a bounded number of edits.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a text is searched as its words with one
space between them. A notice that may have k edits is split into k + 1 parts, one of which must stand
in the text as it is (pigeonhole). An Aho-Corasick automaton finds all parts of all notices in one walk;
around each hit the notice is compared, first as it is, then by the regex library's bounded-error
matching, which gives the edits and the span, and then again what lies before and behind the best match.
Words that tell notices apart (``DISTINCT``) must stand as they are, and no others of them between.
Windows are cut at words. A match begins and ends at word boundaries. Exact
matches always stay. Of overlapping inexact ones those with fewest edits stay, then the longest, unless
an exact match of that length is there.

A null or empty text has no words and no matches. Rows are independent; columns of other names are left
out. Places are words from 0 and bytes of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stormglass.llm import arrow as A

MAX_EDIT_SHARE = 10  # one edit per so many characters of a notice


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    base: bool = False

    @property
    def edits(self) -> int:
        return len(self.text) // MAX_EDIT_SHARE


#: The base phrases and their labels.
BASE = [
    Notice("gnu general public license", "gpl", True),
    Notice("apache license", "apache", True),
    Notice("cc by", "cc-by", True),
    Notice("mit license", "mit", True),
]

#: Notices with labels of the method, as words.
NOTICES = [
    *BASE,
    Notice("licensed under the apache license version 2 0", "apache"),
    Notice("released under the mit license", "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("licensed under the gnu general public license version 3", "gpl"),
    Notice("this program is free software you can redistribute it and or modify it", "gpl"),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("licensed under cc by 4 0", "cc-by"),
    Notice("licensed under cc by sa 4 0", "cc-by-sa"),
    Notice("licensed under cc by nc 4 0", "cc-by-nc"),
    Notice("licensed under cc by nd 4 0", "cc-by-nd"),
    Notice("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    Notice("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    Notice("creative commons attribution", "cc-by"),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd"),
    Notice("mozilla public license", "mpl"),
    Notice("free and unencumbered software released into the public domain", "public-domain"),
    Notice("all rights reserved", "proprietary"),
]


#: Words that tell one notice from another: an edit inside them makes another notice of it.
DISTINCT = frozenset(["mit", "cc", "by", "sa", "nc", "nd"])


def distinct_words(text: str) -> list[str]:
    return [word for word in text.split(" ") if word in DISTINCT]


def parts(notice: Notice) -> list[tuple[int, str]]:
    """Place and text of the k + 1 parts, as equal in length as can be."""
    pieces = notice.edits + 1
    cuts = [round(i * len(notice.text) / pieces) for i in range(pieces + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(4)
def _machine(notices: tuple[Notice, ...]):
    """Automaton of all parts, and the bounded-error pattern of each notice."""
    import ahocorasick
    import regex

    automaton, owners = ahocorasick.Automaton(), {}
    for n, notice in enumerate(notices):
        for place, part in parts(notice):
            owners.setdefault(part, []).append((n, place))
    for part, own in owners.items():
        automaton.add_word(part, (len(part), own))
    automaton.make_automaton()
    patterns = [
        regex.compile(rf"(?<![^ \n])(?:{regex.escape(x.text, literal_spaces=True)}){{e<={x.edits}}}(?![^ \n])", regex.BESTMATCH)
        for x in notices
    ]
    return automaton, patterns


@dataclass
class Words:
    """Texts as lower-case words with one space between them, and a line feed after each text."""

    joined: bytes
    begins: np.ndarray  # of each text in joined, and the end
    heads: np.ndarray  # of each word in joined
    starts: np.ndarray  # of each word in its original text
    stops: np.ndarray
    firsts: np.ndarray  # first word of each text, and the end


def words_of(column: pa.Array) -> Words:
    data, begins = A.spaced(column)
    data = A.LOWER[data]
    word = A.WORD[data]
    starts, stops = A.runs(word)
    kept = word.copy()
    kept[1:] |= word[:-1]
    out = np.where(word, data, 32).astype(np.uint8)
    ends = begins[1:] - 1
    kept[ends], out[ends] = True, 10
    places = np.concatenate([[0], np.cumsum(kept)])
    firsts = np.searchsorted(starts, begins)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(firsts))
    base = begins[:-1][owner]
    return Words(out[kept].tobytes(), places[begins], places[starts], starts - base, stops - base, firsts)


def _word_at(words: Words, text: int, place: int) -> int:
    """Number, within its text, of the word that begins at or after a place."""
    return int(np.searchsorted(words.heads, place)) - int(words.firsts[text])


def _all_best(pattern, part: str, least: int) -> list:
    """The best match, then the best before it and behind it, and so on in what is ``least`` long or longer."""
    out, spans = [], [(0, len(part))]
    while spans:
        lo, hi = spans.pop()
        m = pattern.search(part, lo, hi) if hi - lo >= least else None
        if m:
            out.append(m)
            spans += [(lo, m.start() - 1), (m.end(), hi)]
    return out


def find(words: Words, notices: Sequence[Notice]) -> list[tuple[int, int, int, int, int]]:
    """(text, notice, begin, end, edits) of all matches, places in the joined words."""
    automaton, patterns = _machine(tuple(notices))
    joined, exact, near = words.joined, set(), {}
    for end, (length, owners) in automaton.iter(joined.decode("latin-1")):
        for n, place in owners:
            at = end + 1 - length - place
            raw = notices[n].text.encode()
            after = at + len(raw)
            if at >= 0 and joined[at:after] == raw and joined[after : after + 1] in b" \n" and (at == 0 or joined[at - 1] in b" \n"):
                exact.add((n, at))
            elif notices[n].edits:
                near.setdefault(n, []).append(at)
    out = []
    for n, at in exact:
        text = int(np.searchsorted(words.begins, at, side="right")) - 1
        out.append((text, n, at, at + len(notices[n].text), 0))
    inexact = []
    for n, places in near.items():
        k, length = notices[n].edits, len(notices[n].text)
        windows: list[list[int]] = []
        for at in sorted(set(places)):
            text = int(np.searchsorted(words.begins, max(at, 0), side="right")) - 1
            lo = max(at - 4 * k - 1, int(words.begins[text]))
            hi = min(at + length + 8 * k + 1, int(words.begins[text + 1]))
            if lo > words.begins[text]:
                lo = joined.find(b" ", lo - 1, hi) + 1
            hi = max(joined.rfind(b" ", lo, hi), joined.rfind(b"\n", lo, hi))
            if (lo == 0 and at > 4 * k + 1) or hi < lo:
                continue  # inside one long word
            if windows and windows[-1][0] == text and lo <= windows[-1][2]:
                windows[-1][2] = max(hi, windows[-1][2])
            elif lo < hi:
                windows.append([text, lo, hi])
        for text, lo, hi in windows:
            part = joined[lo:hi].decode("utf-8", "surrogateescape")
            size = lambda x: len(x.encode("utf-8", "surrogateescape"))
            for m in _all_best(patterns[n], part, length - k):
                edits = sum(m.fuzzy_counts)
                if edits and distinct_words(m.group()) == distinct_words(notices[n].text):
                    begin = lo + size(part[: m.start()])
                    inexact.append((edits, -length, text, n, begin, begin + size(m.group())))
    exact_spans: dict[int, list[tuple[int, int]]] = {}
    for text, _, begin, end, _ in out:
        exact_spans.setdefault(text, []).append((begin, end))
    near_spans: dict[int, list[tuple[int, int]]] = {}
    for edits, _, text, n, begin, end in sorted(inexact):
        whole = [(a, b) for a, b in exact_spans.get(text, []) if b - a >= end - begin - edits]
        if all(end <= a or begin >= b for a, b in whole + near_spans.get(text, [])):
            near_spans.setdefault(text, []).append((begin, end))
            out.append((text, n, begin, end, edits))
    return sorted(out, key=lambda m: (m[0], m[2], m[3], m[1]))


MATCH = "struct<label:string,notice:string,base:boolean,first_word:bigint,n_words:bigint,start:bigint,stop:bigint,edits:int,similarity:double>"


def _scanner(notices: Sequence[Notice]):
    kind = pa.list_(
        pa.struct(
            [
                ("label", pa.string()),
                ("notice", pa.string()),
                ("base", pa.bool_()),
                ("first_word", pa.int64()),
                ("n_words", pa.int64()),
                ("start", pa.int64()),
                ("stop", pa.int64()),
                ("edits", pa.int32()),
                ("similarity", pa.float64()),
            ]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in A.pieces(batches, 1):
            words = words_of(piece.column(1))
            found: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            for text, n, begin, end, edits in find(words, notices):
                first, after = _word_at(words, text, begin), _word_at(words, text, end)
                own = words.firsts[text]
                found[text].append(
                    {
                        "label": notices[n].label,
                        "notice": notices[n].text,
                        "base": notices[n].base and not edits,
                        "first_word": first,
                        "n_words": after - first,
                        "start": int(words.starts[own + first]),
                        "stop": int(words.stops[own + after - 1]),
                        "edits": edits,
                        "similarity": 1.0 - edits / len(notices[n].text),
                    }
                )
            counts = pa.array(np.diff(words.firsts), pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), counts, pa.array(found, kind)], names=["id", "n_words", "matches"])

    return run


def scan(documents: DataFrame, notices: Sequence[Notice] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_words, and the matches in order of their place."""
    rows = A.pick(documents, key, text).toDF("id", "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, matches array<{MATCH}>"
    return A.map_arrow(rows, _scanner(notices), schema).withColumnRenamed("id", key)
