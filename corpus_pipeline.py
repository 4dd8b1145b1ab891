"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes the
result of each stage and reads it again, so that a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, fingerprints, line_windows, mixing, rules
from maskwright.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list or its base rule rejects go."""
    learned = rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.judge(docs, learned).where(F.col("quality_rules")["kept"]).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines of windows that stand earlier in the corpus; a text of which nothing is left goes."""
    s = F.col("line_windows")
    cut = line_windows.remove_repeats(docs)
    emptied = (s["n_removed"] > 0) & ~s["text"].rlike(r"[^\x20\x09-\x0D]")
    text = s["text"].alias("text")
    n_chars = F.when(s["n_removed"] > 0, F.length(s["text"]).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.where(~F.coalesce(emptied, F.lit(False))).select("doc_id", text, "lang", "source", n_chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return fingerprints.keep_one(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mix(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

# Learned rules and token merges have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
