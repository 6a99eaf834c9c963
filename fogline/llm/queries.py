"""Registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, lexical_search, line_dedup, mixing, periodic_runs, quality_classifier, quality_rules, sharding
from fogline.llm._scratch import Scratch
from fogline.llm.near_dedup import near_duplicates

#: A conversation that quotes control strings; op7 adds it to the table.
QUOTING = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(fold: int, of: int):
    """Rows that a fit must not see: crc32 of the id as text leaves ``fold`` when divided by ``of``."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_verdicts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(2, 4)))
    found = language_id.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "bits_per_symbol")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "shards")
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), store.path("store"))
    return sharded.select("doc_id", "n_chars", "shard", "shard_rows", "version")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(QUOTING).alias("text"))
    return chat_format.conversation_digests(chat_format.format_conversations(turns.unionByName(quoting)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(1, 3) & F.col("quality").isin(0, 1))
    scratch = Scratch(spark, "quality")
    seen = docs.where(~held_out(1, 3)).join(scratch.sized(labels), "doc_id").select("text", "quality")
    seen = scratch.write(seen, "seen")  # the passes of the fit read labelled texts alone
    model = quality_classifier.fit(seen)
    found = quality_classifier.classify(docs, model)
    return found.select("doc_id", held_out(1, 3).alias("held_out"), "score", "predicted")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def looped(doc_id: int | None, words: list) -> list:
    """What op13 makes of a document: where the checksum of the id ends in 0, words from a place on repeat the first of them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=looped).drop("text")
    # of runs in order of start and period, the first with the greatest length / period
    best = F.expr("aggregate(slice(runs, 2, size(runs)), get(runs, 0), (a, r) -> if(r.length * a.period > a.length * r.period, r, a))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    digest = F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
    best_of = found.withColumn("best", best)
    return best_of.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), digest.alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_mix_sources": op6_mix_sources,
    "op7_chat_format": op7_chat_format,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extract": op10_html_extract,
    "op11_lexical_search": op11_lexical_search,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op4_quality_rules": quality_rules.QUALITY_SQL, "op6_mix_sources": mixing.MIX_SQL, "op11_lexical_search": lexical_search.SEARCH_SQL, "op12_exact_dedup": exact_dedup.EXACT_SQL}
