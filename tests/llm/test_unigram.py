import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers

from stormglass.llm import unigram as U
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def vocabulary():
    return U.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def tokenizer(vocabulary, fallback=True):
    out = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    out.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return out


def counted(vocabulary, texts):
    counts, scores = U.Counter(vocabulary).count_texts(pa.array(texts, pa.string()))
    return counts.tolist(), scores.tolist()


def test_random_texts(vocabulary):
    pick = random.Random(2)
    letters = "abcdeth  \n\té中ңx<s>0ing"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 30))) for _ in range(3000)] + ["", " ", "  a", "a  "]
    reference = tokenizer(vocabulary)
    assert counted(vocabulary, texts)[0] == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_and_unknown_characters(fallback):
    """Small whole scores make many paths equal; the tokenizer's own choice decides the count."""
    pick = random.Random(6)
    for seed in range(30):
        pieces = {"".join(pick.choice("abc") for _ in range(pick.randint(1, 4))) for _ in range(14)}
        vocabulary = [("<unk>", 0.0), ("▁", -1.0)] + [(p, float(-pick.randint(1, 3))) for p in sorted(pieces)]
        if fallback:
            vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
        texts = ["".join(pick.choice("abcd ") for _ in range(pick.randint(1, 14))) for _ in range(80)]
        reference = tokenizer(vocabulary, fallback)
        assert counted(vocabulary, texts)[0] == [len(reference.encode(t).ids) for t in texts], seed


def test_score_is_the_best_of_all_paths():
    vocabulary = [("▁", -1.5), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.25), ("aba", -4.0), ("▁a", -2.25)]
    scores = dict(vocabulary)

    def best(run):
        if not run:
            return 0.0
        return max(scores[run[:k]] + best(run[k:]) for k in range(1, len(run) + 1) if run[:k] in scores)

    texts = ["abab", "ba ab", "a", "aba bab a"]
    assert counted(vocabulary, texts)[1] == [best("▁" + t.replace(" ", "▁")) for t in texts]


def test_query(spark, vocabulary):
    reference = tokenizer(vocabulary)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op7_token_counts"](spark, H.SF).collect()}
    assert got == {i: len(reference.encode(t or "").ids) for i, t in H.texts(spark)}


def test_edges(spark, vocabulary):
    reference = tokenizer(vocabulary)
    expected = sorted((i or 0, len(reference.encode(t or "").ids)) for i, t in H.EDGES)
    for clash in (False, True):
        got = U.count_tokens(H.edges(spark, clash), vocabulary).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == expected
        assert all(r.score == 0.0 for r in got if r.doc_id in (1, 2))
    assert U.count_tokens(H.nothing(spark), vocabulary).collect() == []
    with pytest.raises(ValueError):
        U.Counter([("a▁b", -1.0)])
