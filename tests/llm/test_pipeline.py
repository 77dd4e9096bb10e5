import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from stormglass.llm import bpe, rules
from tests.llm import helpers as H
from tests.llm.test_decontaminate import Brute
from tests.llm.test_jaccard import brute as similar
from tests.llm.test_lines import stripped


def test_stages_against_brute_force(spark):
    docs = H.table(spark, "documents")
    learned = rules.learn(docs, H.table(spark, "labels"))
    rows = []
    for doc_id, text in H.texts(spark):
        counts = {k: v[:1] for k, v in rules.count_texts(pa.array([text])).items()}
        short = counts["n_words"][0] < 50 or 100 * counts["n_repeat_words"][0] > 50 * counts["n_words"][0]
        if not short and not learned.rejects(rules.features(counts))[0]:
            rows.append((doc_id, text))
    rows = stripped(rows, 10)
    groups = similar(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = Brute([(r.item_id, r.text) for r in H.table(spark, "benchmark").collect()])
    rows = [(i, t) for i, t in rows if not items.search(t)]
    with open(corpus_pipeline.RANKS, "rb") as file:
        ranks = bpe.Vocabulary(file.read()).ranks
    reference = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: (reference.encode_ordinary(t), t) for i, t in rows}
    got = {r.doc_id: (list(r.ids), r.text) for r in corpus_pipeline.run(spark, H.SF).collect()}
    assert got == expected


def test_stages_keep_the_columns(spark):
    docs = H.table(spark, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, H.SF)
        assert out.columns == docs.columns and out.count() <= docs.count()


def test_stages_take_text_ids_and_odd_columns(spark):
    docs = H.table(spark, "documents")
    odd = docs.selectExpr("*", "struct(doc_id AS `first name`, lang AS `a.b`) AS `odd column`", "1 AS `_0`", "2 AS source", "3 AS component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, H.SF)
        assert out.columns == odd.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in stage(spark, docs, H.SF).select("doc_id").collect()}
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = H.table(spark, "labels").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    learned = rules.learn(named, labels)
    assert learned.rules and rules.keep(named, learned).count() > 0
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        assert stage(spark, named, H.SF).count() == stage(spark, docs, H.SF).count()
