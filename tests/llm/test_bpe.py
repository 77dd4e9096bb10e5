import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stormglass.llm import arrow as A
from stormglass.llm import bpe
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def encoded(vocabulary, texts):
    data, begins = A.spaced(pa.array(texts, pa.string()))
    starts, ends = bpe.slices(data, begins)
    ids, counts = vocabulary.encode(data, starts, ends)
    at = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, begins)]
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_random_texts(vocabulary, reference):
    pick = random.Random(5)
    letters = "ab's 'tlremdv\n\t  1٢é'Ñ!#  　中\x1c\x85'LLR"
    rows = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(4000)]
    rows += ["", "''s", "'sabc", "a" * 500, "aé" * 300, " " * 300 + "x", "x" + "\n" * 300, "it's", " 's", "!'s", "'s's"]
    assert encoded(vocabulary, rows) == [reference.encode_ordinary(t) for t in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text(vocabulary, reference, rows):
    got = encoded(vocabulary, rows)
    assert got == [reference.encode_ordinary(t) for t in rows]
    for text, ids in zip(rows, got):
        assert vocabulary.decode(np.array(ids, dtype=np.int32))[0].tobytes().decode() == text


def test_scan_equals_stepping():
    pick = np.random.default_rng(1)
    symbols = pick.integers(0, 9, 5000).astype(np.uint8)
    state, begins = 0, []
    for x in symbols.tolist():
        state, starts = bpe._step(state, x)
        begins.append(starts)
    assert bpe.scan(symbols).tolist() == begins


def test_long_and_short_merges_agree(vocabulary):
    pick = random.Random(2)
    for n in (2, 5, 60, 199):
        piece = bytes(pick.choice(b"abcdeth ing") for _ in range(n))
        assert vocabulary._merge_long(piece) == vocabulary.merge(piece) or vocabulary.ranks.get(piece) is not None


def test_query(spark, reference):
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, H.SF).collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for doc_id, text in H.texts(spark):
        ids = reference.encode_ordinary(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert row.decoded_sha256 == sha((text or "").encode())


def test_offsets_and_edges(spark, vocabulary):
    for clash in (False, True):
        rows = bpe.decode(bpe.encode(H.edges(spark, clash), RANKS), RANKS).collect()
        assert len(rows) == len(H.EDGES)
        assert {(r.doc_id, bytes(r.decoded).decode()) for r in rows} == {(i, t or "") for i, t in H.EDGES}
    for r in rows:
        raw, begin = bytes(r.decoded), 0
        for token, end in zip(r.ids, r.ends):
            assert raw[begin:end] == vocabulary.decode(np.array([token]))[0].tobytes()
            begin = end
    assert bpe.decode(bpe.encode(H.nothing(spark), RANKS), RANKS).collect() == []


def test_unknown_id(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([10**6]))
