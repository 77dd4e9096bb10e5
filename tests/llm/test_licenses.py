import pyarrow as pa

from stormglass.llm import licenses as L
from stormglass.llm.queries import QUERIES
from tests.llm import helpers as H


def places(text):
    words = H.plain_words(text)
    found = []
    for notice in L.BASE:
        phrase = notice.text.split()
        found += [(i, notice.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    return len(words), sorted(found)


def scanned(spark, rows):
    return {r.doc_id: r for r in L.scan(H.documents(spark, rows)).collect()}


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op1_license_scans"](spark, H.SF).collect()}
    rows = H.texts(spark)
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n, found = places(text)
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0.0 <= r.score <= 1.0


def test_edits_and_spans(spark):
    rows = [
        (1, "x: Licenced under the GNU  General-Public License, versoin 3."),
        (2, "all right reserved"),
        (3, "all rights unreserved forever"),
        (4, "MIT license,mit LICENSE; summit license; mit licenses"),
        (5, "É cc\n\nby É"),
    ]
    got = scanned(spark, rows)
    first = [(m.label, m.edits) for m in got[1].matches]
    assert ("gpl", 0) in first
    assert [(m.label, m.edits, m.first_word, m.n_words, m.start, m.stop) for m in got[2].matches] == [("proprietary", 1, 0, 3, 0, 18)]
    assert got[3].matches == []
    assert [m.first_word for m in got[4].matches if m.base] == [0, 2]
    assert [(m.first_word, m.start, m.stop) for m in got[5].matches] == [(1, 3, 9)]
    assert all(not m.base or m.edits == 0 for r in got.values() for m in r.matches)


def test_every_text_within_the_bound_is_found():
    import pyarrow as pa

    for n, notice in enumerate(L.NOTICES):
        for cut in range(0, len(notice.text), 3):
            if not notice.edits:
                continue
            edited = notice.text[:cut] + "q" + notice.text[cut + 1 :] if notice.text[cut] != " " else notice.text
            found = L.find(L.words_of(pa.array([f"before {edited} after"])), L.NOTICES)
            distinct = L.distinct_words(edited) == L.distinct_words(notice.text)
            assert any(m[1] == n or L.NOTICES[m[1]].label == notice.label for m in found) or not distinct, edited


def test_several_damaged_notices_in_a_row():
    import pyarrow as pa

    def found(text, label):
        words = L.words_of(pa.array([text]))
        matches = [m for m in L.find(words, L.NOTICES) if L.NOTICES[m[1]].label == label]
        return [(words.joined[a:b].decode(), edits) for _, _, a, b, edits in matches]

    assert found("the mit licence and mit license and mit licenze end", "mit") == [("mit licence", 1), ("mit license", 0), ("mit licenze", 1)]
    two = found("gnu generel publik license, gnu general public licence", "gpl")
    assert two == [("gnu generel publik license", 2), ("gnu general public licence", 1)]
    row = [f"all rights reserve{c}" for c in "qzxqzx"]
    assert found(", then ".join(row), "proprietary") == [(x, 1) for x in row]


def test_other_alphabets_before_a_notice():
    import pyarrow as pa

    for before in range(0, 12):
        for fill in ("é", "中", "𝄞"):
            text = f"{fill * 30} a{fill * before} {'x' * (before % 4)} gnu generel publik license {fill * 9} gnu general public licence"
            words = L.words_of(pa.array([text]))
            spans = [words.joined[m[2] : m[3]].decode() for m in L.find(words, L.NOTICES)]
            assert spans == ["gnu generel publik license", "gnu general public licence"], text
    assert [m for m in L.find(L.words_of(pa.array(["all rights reserved" + "x" * 500, "y" * 500 + "all rights reserved"])), L.NOTICES)] == []


def test_parts_cover_the_notice():
    for notice in L.NOTICES:
        assert "".join(p for _, p in L.parts(notice)) == notice.text
        assert len(L.parts(notice)) == notice.edits + 1


def test_edges(spark):
    for clash in (False, True):
        got = L.scan(H.edges(spark, clash)).collect()
        assert len(got) == len(H.EDGES)
        assert all(r.n_words == 0 and r.matches == [] for r in got if r.doc_id in (1, 2, 3))
    assert L.scan(H.nothing(spark)).collect() == []


def labels_of(text):
    return {L.NOTICES[n].label for _, n, _, _, _ in L.find(L.words_of(pa.array([text])), L.NOTICES)}


def test_no_notice_is_taken_for_another():
    for notice in L.NOTICES:
        inside = {x.label for x in L.NOTICES if f" {x.text} " in f" {notice.text} "}
        assert labels_of(notice.text) == inside, notice
        assert labels_of(f"a b {notice.text} c d") == inside, notice


def test_distinct_words_are_exact():
    assert labels_of("Licensed under CC BY-ND 4.0") == {"cc-by", "cc-by-nd"}
    assert labels_of("licensed under CC BY-NC-SA 4.0") == {"cc-by", "cc-by-nc-sa"}
    assert labels_of("licenced under CC BY-NC-ND 4.0") == {"cc-by", "cc-by-nc-nd"}
    assert labels_of("The Bit License") == set() and labels_of("a mit licence") == {"mit"}
    assert labels_of("gnu general publik license") == {"gpl"} and labels_of("gnu lesser general publik license") == {"lgpl"}
    assert labels_of("licensed under cc by xy 4 0") == {"cc-by"}
