"""Sinks. Nothing written here may contain scanned text or match values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = {"text", "value", "redacted", "matches", "body", "html"}


def metadata_log(scanned: DataFrame, keys: Sequence[str], at: str | Column, text: str = "text") -> DataFrame:
    """Log rows of a scan: provider, model, types, action, tokens, latency – never the text."""
    when = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    pick = lambda name, default: F.col(name) if name in scanned.columns else default
    return scanned.select(
        *keys,
        pick("provider", F.lit("direct")).alias("provider"),
        pick("model", F.lit(None).cast("string")).alias("model"),
        F.to_json("detected_types").alias("detected_types"),
        "action",
        F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4)).alias("prompt_tokens"),
        pick("latency_ms", F.lit(None).cast("long")).alias("latency_ms"),
        when.alias("timestamp"),
    )


def append_log(log: DataFrame, path: str) -> None:
    """Append to a Parquet log partitioned by day."""
    leaked = FORBIDDEN & set(log.columns)
    if leaked:
        raise ValueError(f"content columns in a metadata log: {sorted(leaked)}")
    log.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def write_lines(lines: DataFrame, path: str, line: str = "line") -> None:
    lines.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
