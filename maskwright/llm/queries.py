"""The numbered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, crf, divergence, fingerprints, line_windows, mixing, oracles, ownership, periods, rules, suffixes, superminhash, surrogates, topk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(job: Query) -> Query:
        QUERIES[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = rules.fit(docs, labels)
    s = F.col("quality_rules")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(docs.select("doc_id", "text"), learned).select("doc_id", *(s[f].alias(f) for f in fields))


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("surrogates")
    return surrogates.replace(docs, key="corpus-key").select("doc_id", s["n_entities"].alias("n_entities"), s["text"].alias("text"))


@query("op3_line_windows", oracles.LINE_WINDOWS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("line_windows")
    return line_windows.remove_repeats(docs).select("doc_id", s["n_lines"].alias("n_lines"), s["n_removed"].alias("n_removed"), s["text"].alias("text"))


@query("op4_language_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.predict(docs, crf.learn(docs)).drop("runs")


@query("op5_source_mixing", oracles.MIXING)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_topk_search", oracles.TOPK)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op8_simhash_covering")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = fingerprints.groups(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", fingerprints.as_hex(F.col("f")).alias("fingerprint"), "component_id")


@query("op9_secret_ownership", oracles.OWNERSHIP)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.report(ownership.scan(table(spark, sf_dir, "documents")))


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


@query("op11_source_divergence", oracles.DIVERGENCE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_superminhash", oracles.NEAR_COPIES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.groups(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.collapse(periods.repeated_tail(table(spark, sf_dir, "documents"))))
