"""Decisions: folding detected types and a rule map to one action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.patterns import CUSTOM_TERM, DEFAULT_RULES

# Action vocabularies, presets, label tables, known hosts.
ACTIONS = ["ALLOW", "WARN", "BLOCK"]
EVENT_ACTIONS = ["WARN", "BLOCK"]
CONFIG_TYPES = ["EMAIL", "PHONE", "IBAN", "CREDIT_CARD", "ADDRESS", "PASSWORD"]
PRESETS = {
    "personal": ["WARN", "WARN", "WARN", "BLOCK", "WARN", "BLOCK"],
    "finance": ["WARN", "WARN", "BLOCK", "BLOCK", "WARN", "BLOCK"],
    "health": ["WARN", "BLOCK", "WARN", "BLOCK", "BLOCK", "BLOCK"],
    "workplace": ["WARN", "WARN", "BLOCK", "BLOCK", "WARN", "BLOCK"],
    "developer": ["ALLOW", "ALLOW", "WARN", "BLOCK", "ALLOW", "BLOCK"],
}
AI_DOMAINS = [
    "chat.openai.com",
    "chatgpt.com",
    "claude.ai",
    "gemini.google.com",
    "perplexity.ai",
    "copilot.microsoft.com",
    "chat.mistral.ai",
    "app.slack.com",
    "mail.google.com",
    "notion.so",
    "www.notion.so",
    "linear.app",
    "outlook.live.com",
    "outlook.office.com",
]
UPSTREAM_HOSTS = [
    "api.openai.com",
    "api.x.ai",
    "generativelanguage.googleapis.com",
    "api.mistral.ai",
    "api.groq.com",
    "api.together.xyz",
    "api.cohere.com",
    "api.perplexity.ai",
    "api.deepseek.com",
    "openrouter.ai",
]


def rule_map(rules: dict[str, str] | None = None) -> Column:
    rules = DEFAULT_RULES if rules is None else rules
    pairs = ", ".join(f"'{t}', '{a}'" for t, a in rules.items())
    return F.expr(f"map({pairs})" if rules else "CAST(map() AS MAP<STRING,STRING>)")


def action_of(types: Column, rules: Column | None = None) -> Column:
    """BLOCK if any type is blocked, else WARN if any is warned, else ALLOW. Unknown types count
    for nothing. A given rule map replaces the defaults as a whole."""
    rules = rule_map() if rules is None else rules
    verdicts = F.transform(types, lambda t: F.try_element_at(rules, t))
    return (
        F.when(F.array_contains(verdicts, "BLOCK"), "BLOCK").when(F.array_contains(verdicts, "WARN"), "WARN").otherwise("ALLOW")
    )


def action_client(types: Column, rules: Column, enable_block: bool = True, enable_warn: bool = True) -> Column:
    """Client-side fold: terms always warn, the two switches can mute a level; also says which
    types led to the action."""
    is_term = lambda t: t == CUSTOM_TERM
    blocked = F.filter(types, lambda t: ~is_term(t) & (F.try_element_at(rules, t) == "BLOCK"))
    warned = F.filter(types, lambda t: is_term(t) | (F.try_element_at(rules, t) == "WARN"))
    none = F.array().cast("array<string>")
    verdict = lambda a, t: F.struct(F.lit(a).alias("action"), t.alias("types"))
    return (
        F.when((F.size(blocked) > 0) & F.lit(enable_block), verdict("BLOCK", blocked))
        .when((F.size(warned) > 0) & F.lit(enable_warn), verdict("WARN", warned))
        .otherwise(verdict("ALLOW", none))
    )


def rule_triggers(hits: Column, rules: Column) -> Column:
    """First rule of ``array<struct<ord,id,triggers,action>>`` whose triggers meet the hits."""
    return F.get(F.filter(rules, lambda r: F.arrays_overlap(r["triggers"], hits)), F.lit(0))


def preset_table(spark: SparkSession) -> DataFrame:
    """Long form ``(preset, type, action)``: 5 presets × 6 types."""
    rows = [(p, t, a) for p, actions in PRESETS.items() for t, a in zip(CONFIG_TYPES, actions)]
    return spark.createDataFrame(rows, "preset string, type string, action string")


def preset_rules(preset: Column) -> Column:
    """Rule map of a preset column; unknown presets get the personal one."""
    out = None
    for name, actions in PRESETS.items():
        m = rule_map(dict(zip(CONFIG_TYPES, actions)))
        out = F.when(preset == name, m) if out is None else out.when(preset == name, m)
    return out.otherwise(rule_map(dict(zip(CONFIG_TYPES, PRESETS["personal"]))))


def tenant_rules(preset: Column) -> Column:
    """Rule map of a tenant's preset; a tenant without configuration (NULL) has the default rules."""
    rules = F.map_concat(preset_rules(preset), F.expr("map('CUSTOM_TERM', 'WARN')"))
    return F.when(preset.isNull(), rule_map()).otherwise(rules)


def stored_terms(terms: Column) -> Column:
    """All terms of a stored list (JSON) that are not blank; lists are cut only when they are saved."""
    listed = F.coalesce(F.from_json(terms, "array<string>"), F.array().cast("array<string>"))
    return F.filter(listed, lambda x: F.trim(x) != "")


def with_tenant_policy(texts: DataFrame, config: DataFrame) -> DataFrame:
    """``texts`` (org_id, …) with the columns ``rules`` and ``terms``; no text is lost for want of a configuration."""
    known = config.select("org_id", "preset", "custom_terms")
    joined = texts.join(known, "org_id", "left")
    return joined.withColumn("rules", tenant_rules(F.col("preset"))).withColumn("terms", stored_terms(F.col("custom_terms"))).drop("preset", "custom_terms")


def effective_rules(project: Column, request: Column | None = None) -> Column:
    """Defaults, overlaid by the project's rules, overlaid by the request's."""
    over = lambda low, high: F.map_zip_with(
        low, F.coalesce(high, F.expr("CAST(map() AS MAP<STRING,STRING>)")), lambda k, a, b: F.coalesce(b, a)
    )
    merged = over(rule_map(), project)
    return merged if request is None else over(merged, request)


def effective_terms(project: Column, request: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(project, none), F.coalesce(request, none))


def is_ai_domain(host: Column) -> Column:
    return F.coalesce(host.isin(*AI_DOMAINS), F.lit(False))


def upstream_check(url: Column) -> Column:
    """OK, or the code that tells an unusable URL from a foreign host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return (
        F.when(url.isNull() | (url == ""), "OK")
        .when(host.isNull(), "INVALID_UPSTREAM")
        .when(host.isin(*UPSTREAM_HOSTS), "OK")
        .otherwise("UPSTREAM_NOT_ALLOWED")
    )


def provider_of(url: Column) -> Column:
    """'openai' without an override, else the second label of the host."""
    host = F.try_parse_url(url, F.lit("HOST"))
    label = F.get(F.split(host, r"\."), F.lit(1))
    return F.when(url.isNull() | (url == ""), "openai").otherwise(
        F.coalesce(F.when(label != "", label), F.lit("custom"))
    )


def clean_terms(terms: Column) -> Column:
    """Non-blank terms, the first 50 of them, trimmed, then the first 100 characters of each."""
    kept = F.filter(terms, lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    return F.transform(F.slice(kept, 1, 50), lambda t: F.substring(F.trim(t), 1, 100))


def legal_action(value: Column, allowed: list[str] | None = None) -> Column:
    """The value if it is a legal action, else NULL (= field left as it is)."""
    return F.when(value.isin(*(allowed or ACTIONS)), value)
