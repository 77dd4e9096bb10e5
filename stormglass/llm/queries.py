"""The numbered operators as queries over the whole tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.llm import bpe, chat, collocations, decontaminate, ftrl, jaccard, licenses, lines, rules, search, shards, unigram, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan(_table(spark, folder, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first_word"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("score"),
    )


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, folder, "documents"), ranks).select("doc_id", "ids")
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    learned = rules.learn(documents, _table(spark, folder, "labels"))
    judged = rules.judge(documents, learned)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"
    )


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_table(spark, folder, "documents"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    index = lines.LineIndex(spark, min_docs=10)
    index.insert(documents)
    kept = F.coalesce(F.col("_1"), F.lit("")).cast("binary")
    return index.strip(documents).select(
        F.col("_0").alias("doc_id"), "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256")
    )


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = unigram.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram.count_tokens(_table(spark, folder, "documents"), vocabulary)


#: Fixed rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    weights = ftrl.fit(documents, _table(spark, folder, "labels"), allowed=fold != 1)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return ftrl.score(documents, weights).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.shard(_table(spark, folder, "documents"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(_table(spark, folder, "documents"), least=100, top=2000)


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    index = search.build(_table(spark, folder, "documents"))
    return search.top_documents(index, _table(spark, folder, "benchmark"), k=10)


#: A conversation of the query's own whose texts hold control strings.
ODD_CHAT = """
SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)
"""


def op13_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat.format_chats(given.unionByName(spark.sql(ODD_CHAT)))
    turns = chats.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_byte_bpe,
        op3_quality_rules,
        op4_ngram_jaccard_join,
        op5_line_dedup,
        op6_benchmark_decontamination,
        op7_token_counts,
        op8_url_filters,
        op9_quality_classifier,
        op10_sharding,
        op11_phrase_collocations,
        op12_ranked_search,
        op13_chat_formatting,
    )
}
