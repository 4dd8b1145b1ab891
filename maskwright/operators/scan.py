"""Corpus scan: matches, decision and redaction as narrow stages over a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import policy, spans, text as texts
from maskwright.functions.redaction import redact_sql


def scan(
    df: DataFrame,
    text: str = "text",
    types: Sequence[str] | None = None,
    pack: str = "server",
    terms: str | None = None,
    rules: str | None = None,
    mode: str = "tag",
    redact: bool = True,
    switches: str | None = None,
    many_terms: bool = False,
) -> DataFrame:
    """``df`` plus matches, detected_types, action, clean and (unless off) redacted.

    ``terms``, ``rules`` and ``switches`` (types on or off) name columns, so every row may carry its
    tenant's own policy. Matches
    are built-in spans merged with term spans; because merged spans may overlap, the redaction
    uses their resolved union. One stage, no shuffle. ``many_terms`` says that term lists may be long.
    """
    out = spans.with_matches(df, text, types, pack, terms, switches, many_terms)
    out = out.withColumn("detected_types", spans.types_of(F.col("matches")))
    verdict = policy.action_of(F.col("detected_types"), F.col(rules) if rules else None)
    out = out.withColumn("action", verdict).withColumn("clean", F.size("matches") == 0)
    if redact:
        safe = "matches"
        if terms is not None:
            out = out.withColumn("_safe", F.expr(spans.resolve_sql("matches")))
            safe = "_safe"
        out = out.withColumn("redacted", F.expr(redact_sql(text, safe, mode))).drop("_safe")
    return out


def scan_project(
    calls: DataFrame, keys: DataFrame, projects: DataFrame, request_rules: dict[str, str], request_terms: Sequence[str], at: str
) -> DataFrame:
    """Log rows of calls ``(key_id, text, …)`` under their projects' policy; no text in the result.

    A call whose key is unknown, revoked or without a project, or whose text is over-size, comes out
    with an error code instead of a decision. The project's rules go over the defaults and the request's
    over both; terms of project and request are looked for.
    """
    live = keys.filter("revoked_at IS NULL").select(F.col("id").alias("key_id"), "project_id")
    known = projects.select(
        F.col("id").alias("project_id"),
        "org_id",
        F.from_json("rules", "map<string,string>").alias("own_rules"),
        F.from_json("custom_terms", "array<string>").alias("own_terms"),
    )
    called = calls.join(live.join(known, "project_id"), "key_id", "left")
    error = F.when(F.col("project_id").isNull(), "INVALID_API_KEY").otherwise(texts.size_error(F.col("text")))
    called = called.withColumn("error_code", error)
    asked = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in request_rules.items())))
    rules = policy.effective_rules(F.col("own_rules"), asked)
    terms = policy.effective_terms(F.col("own_terms"), F.array(*map(F.lit, request_terms)))
    good = called.filter("error_code IS NULL").withColumn("rules", rules).withColumn("terms", terms)
    done = scan(good, terms="terms", rules="rules", redact=False, many_terms=True)
    n_chars = F.length(F.coalesce("text", F.lit("")))
    logged = done.select(
        *(c for c in called.columns if c not in ("text", "own_rules", "own_terms")),
        F.size("matches").cast("long").alias("n_matches"),
        F.to_json("detected_types").alias("detected_types"),
        "action",
        F.ceil(n_chars / F.lit(4)).alias("prompt_tokens"),
        F.lit(at).cast("timestamp_ntz").alias("timestamp"),
    )
    return logged.unionByName(called.filter("error_code IS NOT NULL").drop("text", "own_rules", "own_terms"), allowMissingColumns=True)


def redact_report(scanned: DataFrame, text: str = "text") -> DataFrame:
    return scanned.withColumn("original_length", F.length(F.coalesce(text, F.lit(""))).cast("long")).withColumn(
        "redacted_count", F.size("matches").cast("long")
    )


def file_scan_report(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Sizes and findings of a file; the text itself is dropped."""
    n = F.length(text).cast("long")
    return (
        scanned.withColumn("char_count", n)
        .withColumn("page_estimate", texts.page_estimate(n))
        .withColumn("match_count", F.size("matches").cast("long"))
        .drop(text)
    )


def check_policy(scanned: DataFrame) -> DataFrame:
    ok = F.col("action") != "BLOCK"
    reason = F.when(ok, "Text complies with policy").otherwise(
        F.concat(F.lit("Policy violation: "), F.array_join("detected_types", ", "), F.lit(" detected"))
    )
    return scanned.withColumn("allowed", ok).withColumn("reason", reason)


def is_safe() -> Column:
    return F.col("action") != "BLOCK"


def gate(scanned: DataFrame) -> DataFrame:
    """Adds ``route``, ``error_code`` and ``error``: blocked rows are held with an error record."""
    error = F.concat(F.lit("Request blocked: sensitive data detected ("), F.array_join("detected_types", ", "), F.lit(")"))
    held = F.col("action") == "BLOCK"
    return (
        scanned.withColumn("route", F.when(held, "held").otherwise("passed"))
        .withColumn("error_code", F.when(held, "CONTENT_BLOCK"))
        .withColumn("error", F.when(held, error))
    )


def gate_split(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, held). Store the gated rows once (partitioned by ``route``) if both are wanted;
    two separate actions on the result scan the texts twice."""
    gated = gate(scanned)
    return gated.filter("route = 'passed'"), gated.filter("route = 'held'")


def corpus_summary(scanned: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Totals per group and the gate flags for ``fail_on`` block / warn. Over-size texts are errors
    and nothing else: their decisions and matches do not count."""
    error = texts.size_error(F.col(text)).isNotNull()
    block, warn = F.col("action") == "BLOCK", F.col("action") == "WARN"
    slim = scanned.select(*by, F.when(~error, F.col("action")).alias("action"), error.alias("error"), F.when(error, 0).otherwise(F.size("matches")).alias("n"))
    return slim.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(block).alias("blocked"),
        F.count_if(warn).alias("warned"),
        F.count_if(F.col("action") == "ALLOW").alias("allowed"),
        F.count_if(F.col("error")).alias("errors"),
        F.sum(F.col("n").cast("long")).alias("matches"),
        F.bool_or(F.col("error") | block).alias("fail_block"),
        F.bool_or(F.col("error") | block | warn).alias("fail_warn"),
    )


def type_counts(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Matches and documents per type: each document is folded to (type, n) pairs first."""
    per_doc = F.transform(
        spans.types_of(F.col("matches")),
        lambda t: F.struct(t.alias("type"), F.size(F.filter("matches", lambda m: m["type"] == t)).alias("n")),
    )
    pairs = matched.select(*by, F.explode_outer(per_doc).alias("p")).filter("p IS NOT NULL").select(*by, "p.type", "p.n")
    return pairs.groupBy(*by, "type").agg(F.sum(F.col("n").cast("long")).alias("matches"), F.count("*").alias("documents"))


def summary_text() -> Column:
    n = F.size("matches")
    found = F.concat(
        F.when(F.col("action") == "BLOCK", "BLOCKED").otherwise("WARNING"),
        F.lit(": Found "),
        F.array_join("detected_types", ", "),
        F.lit(" ("),
        n.cast("string"),
        F.when(n != 1, " matches)").otherwise(" match)"),
    )
    return F.when(n == 0, "No PII detected. Text is safe to use.").otherwise(found)
