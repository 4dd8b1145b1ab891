"""Scan results: overlap resolution, decision, redaction, reports per document and per corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskwright.functions import policy, spans
from maskwright.functions.patterns import DEFAULT_RULES
from maskwright.operators import scan as S
from maskwright.plans import detect_sql as D
from maskwright.plans.registry import query
from maskwright.sources import sinks
from maskwright.session import checkpoint_root
from maskwright.sources.files import key_of, read_files, spread, write_files
from maskwright.sources.golden import seeded
from maskwright.sources.views import AS_OF

TERMS = ["widget", "main st", "john@test"]
_TERMS_SQL = "['widget', 'main st', 'john@test']"
_TYPES = "list_distinct(list(type))"  # only as a set; ordered lists are aggregated by first start


def _docs(t, *cols):
    return seeded(t.documents).select("doc_id", "text", *cols)


def _with_terms(df):
    return df.withColumn("terms", F.array(*[F.lit(x) for x in TERMS]))


# --- shared CTEs -------------------------------------------------------------------------
_SP = D.raw_cte(D.SEEDED, "doc_id")
_KEPT = {**_SP, **D.fold("kept", "sp", "doc_id")}
_MERGED = {
    **_KEPT,
    **D.term_cte("doc_id", _TERMS_SQL),
    "mg": "SELECT * FROM kept UNION ALL SELECT doc_id, s, e, ord, type, country, v FROM cu",
}
_SAFE = {**_MERGED, **D.fold("safe", "mg", "doc_id")}


def per_doc(source: str) -> str:
    """CTE text: one row per document with its number of matches, ordered types and type set."""
    return (
        f"SELECT c.doc_id, c.source, length(c.text) AS n_chars, coalesce(n, 0) AS n, coalesce(types, '') AS types, coalesce(tl, []) AS tl FROM corpus c "
        f"LEFT JOIN (SELECT doc_id, sum(n) AS n, string_agg(type, ',' ORDER BY s, o) AS types, list(type) AS tl FROM "
        f"(SELECT doc_id, type, count(*) AS n, min(s) AS s, min(s * 100000 + ord) AS o FROM {source} GROUP BY doc_id, type) GROUP BY doc_id) x ON x.doc_id = c.doc_id"
    )


_DOC = {**_KEPT, "pd": per_doc("kept")}
_DOC_T = {**_SAFE, "pd": per_doc("mg")}
_ACT = D.action_sql("tl")


@query("resolve_overlaps", "SELECT doc_id, type, s AS start_at, e AS end_at, v AS value FROM kept", _KEPT)
def resolve_overlaps(t):
    m = spans.explode_matches(spans.with_matches(_docs(t)), ["doc_id"])
    return m.selectExpr("doc_id", "type", "CAST(start AS BIGINT) AS start_at", "CAST(end AS BIGINT) AS end_at", "value")


@query("merge_custom", "SELECT doc_id, type, s AS start_at, e AS end_at, v AS value, ord FROM mg", _MERGED)
def merge_custom(t):
    m = spans.explode_matches(spans.with_matches(_with_terms(_docs(t)), terms="terms"), ["doc_id"])
    return m.selectExpr(
        "doc_id", "type", "CAST(start AS BIGINT) AS start_at", "CAST(end AS BIGINT) AS end_at", "value", "CAST(ord AS BIGINT) AS ord"
    )


_SWITCHES = "CASE doc_id % 3 WHEN 0 THEN map('EMAIL', true, 'PHONE', false) WHEN 1 THEN NULL ELSE map('IBAN', false, 'EMAIL', false) END"
_SWITCHED = {
    **_SP,
    "lit": "SELECT * FROM sp WHERE NOT ((doc_id % 3 = 0 AND type = 'PHONE') OR (doc_id % 3 = 2 AND type IN ('IBAN', 'EMAIL')))",
    **D.fold("kept", "lit", "doc_id"),
}


@query("det_switched", "SELECT doc_id, type, s AS start_at, e AS end_at, v AS value FROM kept", _SWITCHED)
def det_switched(t):
    """Types switched on and off by each row's own map, before overlaps are resolved."""
    docs = _docs(t).withColumn("switches", F.expr(_SWITCHES))
    m = spans.explode_matches(spans.with_matches(docs, switches="switches"), ["doc_id"])
    return m.selectExpr("doc_id", "type", "CAST(start AS BIGINT) AS start_at", "CAST(end AS BIGINT) AS end_at", "value")


@query("action_of", f"SELECT doc_id, types, {_ACT} AS action FROM pd", _DOC)
def action_of(t):
    df = spans.with_matches(_docs(t)).withColumn("types", spans.types_of(F.col("matches")))
    return df.select("doc_id", F.array_join("types", ",").alias("types"), policy.action_of(F.col("types")).alias("action"))


_PRESET_ROWS = ", ".join(
    [f"('{p}', '{ty}', '{a}')" for p, acts in policy.PRESETS.items() for ty, a in zip(policy.CONFIG_TYPES, acts)]
    + [f"('default', '{ty}', '{a}')" for ty, a in DEFAULT_RULES.items() if ty != "CUSTOM_TERM"]
)
_CLIENT = {**D.raw_cte(D.SEEDED, "doc_id", None, "client")}
_CLIENT.update(D.fold("kept", "sp", "doc_id"))
_CLIENT.update(D.term_cte("doc_id", _TERMS_SQL))
_CLIENT["mg"] = "SELECT * FROM kept UNION ALL SELECT doc_id, s, e, ord, type, country, v FROM cu"
_CLIENT["tt"] = "SELECT doc_id, type, min(s * 100000 + ord) AS o FROM mg GROUP BY doc_id, type"
_CLIENT["presets"] = f"SELECT * FROM (VALUES {_PRESET_ROWS}) p(preset, type, action)"


@query(
    "action_client",
    """SELECT c.doc_id, CASE WHEN nb > 0 THEN 'BLOCK' WHEN nw > 0 THEN 'WARN' ELSE 'ALLOW' END AS action,
         CASE WHEN nb > 0 THEN bt WHEN nw > 0 THEN wt ELSE '' END AS types,
         CASE WHEN nw > 0 THEN 'WARN' ELSE 'ALLOW' END AS action_no_block
       FROM corpus c LEFT JOIN (
         SELECT tt.doc_id, count(*) FILTER (WHERE p.action = 'BLOCK') AS nb, string_agg(tt.type, ',' ORDER BY o) FILTER (WHERE p.action = 'BLOCK') AS bt,
           count(*) FILTER (WHERE tt.type = 'CUSTOM_TERM' OR p.action = 'WARN') AS nw, string_agg(tt.type, ',' ORDER BY o) FILTER (WHERE tt.type = 'CUSTOM_TERM' OR p.action = 'WARN') AS wt
         FROM tt LEFT JOIN org_config oc ON oc.org_id = tt.doc_id % 25 LEFT JOIN presets p ON p.preset = coalesce(oc.preset, 'default') AND p.type = tt.type GROUP BY tt.doc_id) x ON x.doc_id = c.doc_id""",
    _CLIENT,
)
def action_client(t):
    """Client fold under each tenant's preset, or the default rules without one; also with blocking off."""
    docs = _with_terms(_docs(t)).withColumn("org_id", F.col("doc_id") % 25).join(t.org_config.select("org_id", "preset"), "org_id", "left")
    df = spans.with_matches(docs, pack="client", terms="terms")
    df = df.withColumn("types", spans.types_of(F.col("matches"))).withColumn("rules", policy.tenant_rules(F.col("preset")))
    df = df.withColumn("v", policy.action_client(F.col("types"), F.col("rules")))
    muted = policy.action_client(F.col("types"), F.col("rules"), enable_block=False)
    return df.select(
        "doc_id", F.col("v.action"), F.array_join("v.types", ",").alias("types"), muted["action"].alias("action_no_block")
    )


RULES = [("R1", ["EMAIL", "PHONE", "IBAN"], "WARN"), ("R2", ["PASSWORD", "CREDIT_CARD"], "BLOCK"), ("R3", ["EMAIL"], "BLOCK")]


@query(
    "rule_triggers",
    """SELECT doc_id, CASE WHEN len(list_intersect(tl, ['EMAIL','PHONE','IBAN'])) > 0 THEN 'R1' WHEN len(list_intersect(tl, ['PASSWORD','CREDIT_CARD'])) > 0 THEN 'R2'
         WHEN list_contains(tl, 'EMAIL') THEN 'R3' END AS rule_id FROM pd""",
    _DOC,
)
def rule_triggers(t):
    rules = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(r).alias("id"), F.array(*map(F.lit, tr)).alias("triggers"), F.lit(a).alias("action"))
            for i, (r, tr, a) in enumerate(RULES)
        ]
    )
    df = spans.with_matches(_docs(t)).withColumn("types", spans.types_of(F.col("matches")))
    return df.select("doc_id", policy.rule_triggers(F.col("types"), rules)["id"].alias("rule_id"))


@query(
    "preset_rules",
    "SELECT oc.org_id, oc.preset, p.type, p.action FROM org_config oc JOIN presets p ON p.preset = oc.preset",
    {"presets": _CLIENT["presets"]},
)
def preset_rules(t):
    """Every tenant's preset spelled out per type (long form of the rule map)."""
    return t.org_config.select("org_id", "preset").join(policy.preset_table(t.spark), "preset").select("org_id", "preset", "type", "action")


def _redaction(name, mode):
    ctes = {**_SAFE, **D.redact_cte("red", "safe", "doc_id", mode)}

    @query(name, "SELECT doc_id, redacted FROM red", ctes)
    def job(t):
        return S.scan(_with_terms(_docs(t)), terms="terms", mode=mode).select("doc_id", "redacted")


_redaction("redact_tag", "tag")
_redaction("redact_blank", "blank")
_redaction("redact_hash", "hash")

_SCAN = {**_DOC_T, **D.redact_cte("red", "safe", "doc_id")}
_SCAN["ml"] = "SELECT doc_id, string_agg(type || ':' || s || '-' || e, ',' ORDER BY s, ord) AS matches FROM mg GROUP BY doc_id"


@query(
    "scan",
    f"""SELECT pd.doc_id, coalesce(ml.matches, '') AS matches, types AS detected_types, {_ACT} AS action, redacted, n = 0 AS clean
        FROM pd JOIN red USING (doc_id) LEFT JOIN ml USING (doc_id)""",
    _SCAN,
)
def scan(t):
    df = S.scan(_with_terms(_docs(t)), terms="terms")
    shown = F.transform(
        "matches", lambda m: F.concat(m["type"], F.lit(":"), m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))
    )
    return df.select(
        "doc_id",
        F.array_join(shown, ",").alias("matches"),
        F.array_join("detected_types", ",").alias("detected_types"),
        "action",
        "redacted",
        "clean",
    )


@query(
    "redact_report",
    "SELECT pd.doc_id, n_chars AS original_length, redacted, types AS detected_types, CAST(n AS BIGINT) AS redacted_count, n = 0 AS clean FROM pd JOIN red USING (doc_id)",
    _SCAN,
)
def redact_report(t):
    return S.redact_report(S.scan(_with_terms(_docs(t)), terms="terms")).select(
        "doc_id", "original_length", "redacted", F.array_join("detected_types", ",").alias("detected_types"), "redacted_count", "clean"
    )


_PG = D.raw_cte("SELECT page_id AS doc_id, url AS source, coalesce(html, '') AS text FROM pages", "doc_id")
_PG.update(D.fold("kept", "sp", "doc_id"))
_PG["pd"] = per_doc("kept")


@query(
    "file_scan_report",
    f"SELECT doc_id AS page_id, n_chars AS char_count, CAST(ceil(n_chars / 2000) AS BIGINT) AS page_estimate, types AS detected_types, {_ACT} AS action, CAST(n AS BIGINT) AS match_count FROM pd",
    _PG,
)
def file_scan_report(t):
    pages = spread(t.pages).select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    df = S.file_scan_report(S.scan(pages))
    return df.select(
        "page_id", "char_count", "page_estimate", F.array_join("detected_types", ",").alias("detected_types"), "action", "match_count"
    )


@query(
    "check_policy",
    f"""SELECT doc_id, action, action <> 'BLOCK' AS allowed, CASE WHEN action <> 'BLOCK' THEN 'Text complies with policy'
          ELSE 'Policy violation: ' || replace(types, ',', ', ') || ' detected' END AS reason FROM (SELECT doc_id, types, {_ACT} AS action FROM pd)""",
    _DOC,
)
def check_policy(t):
    return S.check_policy(S.scan(_docs(t))).select("doc_id", "action", "allowed", "reason")


@query("is_safe", f"SELECT doc_id, {_ACT} <> 'BLOCK' AS safe FROM pd", _DOC)
def is_safe(t):
    return S.scan(_docs(t), redact=False).select("doc_id", S.is_safe().alias("safe"))


@query(
    "scan_and_redact",
    f"SELECT pd.doc_id, {_ACT} AS action, n = 0 AS clean, types AS detected_types, CAST(n AS BIGINT) AS match_count, redacted, CAST(n AS BIGINT) AS redacted_count FROM pd JOIN red USING (doc_id)",
    _SCAN,
)
def scan_and_redact(t):
    """Both answers from one pass over the text."""
    df = S.scan(_with_terms(_docs(t)), terms="terms")
    n = F.size("matches").cast("long")
    return df.select(
        "doc_id", "action", "clean", F.array_join("detected_types", ",").alias("detected_types"), n.alias("match_count"), "redacted", n.alias("redacted_count")
    )


@query(
    "gate_split",
    f"""SELECT doc_id, action, CASE WHEN action = 'BLOCK' THEN 'held' ELSE 'passed' END AS route,
          CASE WHEN action = 'BLOCK' THEN 'Request blocked: sensitive data detected (' || replace(types, ',', ', ') || ')' END AS error
        FROM (SELECT doc_id, types, {_ACT} AS action FROM pd)""",
    _DOC,
)
def gate_split(t):
    """Both branches in one pass: the route is a column, the outputs are filters on it."""
    return S.gate(S.scan(_docs(t), redact=False)).select("doc_id", "action", "route", "error")


_SUMMARY = f"""SELECT source, count(*) AS total, count(*) FILTER (WHERE action = 'BLOCK') AS blocked, count(*) FILTER (WHERE action = 'WARN') AS warned,
   count(*) FILTER (WHERE action = 'ALLOW') AS allowed, count(*) FILTER (WHERE error IS NOT NULL) AS errors, CAST(sum(n) AS BIGINT) AS matches,
   bool_or(coalesce(action = 'BLOCK', true)) AS fail_block, bool_or(coalesce(action <> 'ALLOW', true)) AS fail_warn
   FROM (SELECT source, CASE WHEN n_chars > 500000 THEN 0 ELSE n END AS n, CASE WHEN n_chars <= 500000 THEN {_ACT} END AS action, CASE WHEN n_chars > 500000 THEN 'TEXT_TOO_LARGE' END AS error FROM pd) GROUP BY source"""


@query("corpus_summary", _SUMMARY, _DOC)
def corpus_summary(t):
    """Totals per source with the two gate flags (fail on block, fail on warn)."""
    return S.corpus_summary(S.scan(_docs(t, "source")), ["source"])


_FLAG = D.raw_cte(D.SEEDED, "doc_id", ["EMAIL", "CREDIT_CARD"])
_FLAG.update(D.fold("kept", "sp", "doc_id"))
_FLAG["pd"] = per_doc("kept")


@query("corpus_flagship", _SUMMARY, _FLAG)
def corpus_flagship(t):
    """Minimum slice: e-mail and card spans, overlaps, decision, summary by source."""
    return S.corpus_summary(S.scan(_docs(t, "source"), types=["EMAIL", "CREDIT_CARD"]), ["source"])


@query(
    "type_by_corpus",
    "SELECT source, type, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM kept JOIN corpus USING (doc_id) GROUP BY source, type",
    _KEPT,
)
def type_by_corpus(t):
    """Per document first (row-local map), so documents need no distinct count and the shuffle
    carries partial sums only."""
    return S.type_counts(spans.with_matches(_docs(t, "source")), ["source"])


@query(
    "effective_rules",
    """SELECT d.doc_id, string_agg(r.type || '=' || coalesce(q.action, p.action, r.action), ',' ORDER BY r.type) AS rules, any_value(len(coalesce(j.terms, [])) + 1) AS n_terms
       FROM documents d LEFT JOIN (SELECT id, from_json(custom_terms, '["VARCHAR"]') AS terms, rules FROM dev_projects) j ON j.id = d.doc_id % 12
       CROSS JOIN (VALUES """
    + ", ".join(f"('{a}', '{b}')" for a, b in DEFAULT_RULES.items())
    + """) r(type, action)
       LEFT JOIN (SELECT id, 'EMAIL' AS type, json_extract_string(rules, '$.EMAIL') AS action FROM dev_projects) p ON p.id = j.id AND p.type = r.type
       LEFT JOIN (VALUES ('PHONE', 'BLOCK'), ('IBAN', 'ALLOW')) q(type, action) ON q.type = r.type GROUP BY d.doc_id""",
)
def effective_rules(t):
    """Defaults, project rules and per-request overrides merged for each request, with or without a project."""
    j = t.dev_projects.select(
        F.col("id").alias("project_id"),
        F.from_json("rules", "map<string,string>").alias("project_rules"),
        F.from_json("custom_terms", "array<string>").alias("project_terms"),
    )
    df = t.documents.select("doc_id", (F.col("doc_id") % 12).alias("project_id")).join(j, "project_id", "left")
    merged = policy.effective_rules(F.col("project_rules"), policy.rule_map({"PHONE": "BLOCK", "IBAN": "ALLOW"}))
    pairs = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    terms = policy.effective_terms(F.col("project_terms"), F.array(F.lit("widget")))
    return df.select("doc_id", F.array_join(pairs, ",").alias("rules"), F.size(terms).cast("long").alias("n_terms"))


@query(
    "u_terms",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'widget|Project X|' ELSE '' END || 'widget|extra' AS terms FROM dev_projects""",
)
def u_terms(t):
    """Project terms followed by request terms, duplicates kept."""
    own = F.from_json("custom_terms", "array<string>")
    both = policy.effective_terms(own, F.array(F.lit("widget"), F.lit("extra")))
    return t.dev_projects.select("id", F.array_join(both, "|").alias("terms"))


_ORG = D.raw_cte(D.SEEDED, "doc_id")
_ORG.update(D.fold("kept", "sp", "doc_id"))
_ORG["owned"] = (
    "SELECT c.doc_id, c.text, c.doc_id % 25 AS org_id, coalesce(oc.preset, 'default') AS preset, list_filter(coalesce(from_json(oc.custom_terms, '[\"VARCHAR\"]'), []), lambda x: trim(x) <> '') AS org_terms "
    "FROM corpus c LEFT JOIN org_config oc ON oc.org_id = c.doc_id % 25"
)
_ORG.update(D.term_cte("doc_id", "org_terms", "owned"))
_ORG["mg"] = "SELECT * FROM kept UNION ALL SELECT doc_id, s, e, ord, type, country, v FROM cu"
_ORG["tt"] = "SELECT doc_id, type, count(*) AS n FROM mg GROUP BY doc_id, type"
_ORG["presets"] = _CLIENT["presets"]


@query(
    "j_org_rules",
    """SELECT o.doc_id, CAST(o.org_id AS BIGINT) AS org_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_matches,
         CASE WHEN count(*) FILTER (WHERE p.action = 'BLOCK') > 0 THEN 'BLOCK' WHEN count(*) FILTER (WHERE p.action = 'WARN' OR tt.type = 'CUSTOM_TERM') > 0 THEN 'WARN' ELSE 'ALLOW' END AS action
       FROM owned o LEFT JOIN tt ON tt.doc_id = o.doc_id LEFT JOIN presets p ON p.preset = o.preset AND p.type = tt.type GROUP BY o.doc_id, o.org_id""",
    _ORG,
)
def j_org_rules(t):
    """Each text scanned with its tenant's rules and all its stored terms, or with the defaults.

    No hint: the configuration side is broadcast while it is small, and beyond the threshold the
    join shuffles on org_id with skew splitting.
    """
    docs = _docs(t).withColumn("org_id", F.col("doc_id") % 25)
    owned = policy.with_tenant_policy(docs, t.org_config)
    df = S.scan(owned, terms="terms", rules="rules", redact=False, many_terms=True)
    return df.select("doc_id", "org_id", F.size("matches").cast("long").alias("n_matches"), "action")


# requests carry keys 0..299; some are unknown or revoked, and some keys' projects are missing
_KEY = "c.doc_id % 300"
_PROJ = D.raw_cte(D.SEEDED, "doc_id")
_PROJ.update(D.fold("kept", "sp", "doc_id"))
_PROJ["called"] = (
    f"SELECT c.doc_id, c.text, {_KEY} AS key_id, j.id AS project_id, j.org_id, j.rules, list_concat(coalesce(from_json(j.custom_terms, '[\"VARCHAR\"]'), []), ['widget']) AS all_terms, "
    "CASE WHEN j.id IS NULL THEN 'INVALID_API_KEY' WHEN length(c.text) > 500000 THEN 'TEXT_TOO_LARGE' END AS error_code "
    f"FROM corpus c LEFT JOIN api_keys k ON k.id = {_KEY} AND k.revoked_at IS NULL LEFT JOIN dev_projects j ON j.id = k.project_id"
)
_PROJ["good"] = "SELECT * FROM called WHERE error_code IS NULL"
_PROJ.update(D.term_cte("doc_id", "all_terms", "good"))
_PROJ["mg"] = "SELECT doc_id, s, ord, type FROM kept UNION ALL SELECT doc_id, s, ord, type FROM cu"
_PROJ["tt"] = (
    "SELECT g.doc_id, m.type, coalesce(CASE m.type WHEN 'PHONE' THEN 'ALLOW' WHEN 'EMAIL' THEN 'WARN' END, json_extract_string(g.rules, '$.' || m.type), d.action) AS action, count(*) AS n, min(m.s * 100000 + m.ord) AS o "
    "FROM good g JOIN mg m USING (doc_id) JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DEFAULT_RULES.items()) + ") d(type, action) ON d.type = m.type GROUP BY ALL"
)


@query(
    "scan_project",
    f"""SELECT c.doc_id, c.key_id, c.project_id, c.org_id, c.error_code, CAST(CASE WHEN c.error_code IS NULL THEN coalesce(sum(n), 0) END AS BIGINT) AS n_matches,
         CASE WHEN c.error_code IS NULL THEN '[' || coalesce(string_agg('"' || type || '"', ',' ORDER BY o), '') || ']' END AS detected_types,
         CASE WHEN c.error_code IS NOT NULL THEN NULL WHEN count(*) FILTER (WHERE action = 'BLOCK') > 0 THEN 'BLOCK' WHEN count(*) FILTER (WHERE action = 'WARN') > 0 THEN 'WARN' ELSE 'ALLOW' END AS action,
         CASE WHEN c.error_code IS NULL THEN CAST(ceil(length(any_value(c.text)) / 4) AS BIGINT) END AS prompt_tokens, CASE WHEN c.error_code IS NULL THEN TIMESTAMP '{AS_OF}' END AS timestamp
       FROM called c LEFT JOIN tt ON tt.doc_id = c.doc_id GROUP BY c.doc_id, c.key_id, c.project_id, c.org_id, c.error_code""",
    _PROJ,
)
def scan_project(t):
    """Each request under its key's project: merged rules and terms decide, and one log row comes out.

    The project's rules go over the defaults, and the request's over both.
    """
    calls = _docs(t).withColumn("key_id", F.col("doc_id") % 300)
    out = S.scan_project(calls, t.api_keys, t.dev_projects, {"PHONE": "ALLOW", "EMAIL": "WARN"}, ["widget"], AS_OF)
    return out.select("doc_id", "key_id", "project_id", "org_id", "error_code", "n_matches", "detected_types", "action", "prompt_tokens", "timestamp")


@query(
    "dir_scan",
    f"SELECT doc_id, n_chars + 1 AS char_count, types AS detected_types, {_ACT} AS action, CAST(n AS BIGINT) AS match_count FROM pd",
    _DOC,
)
def dir_scan(t):
    """A folder of text files, one a document, read back, scanned and reported file by file."""
    root = f"{checkpoint_root(t.spark)}/dir-scan-{uuid.uuid4().hex}"
    write_files(_docs(t), root, "doc_id")
    found = S.file_scan_report(S.scan(spread(read_files(t.spark, root)), redact=False))
    doc_id = key_of(F.col("path"), "doc_id").alias("doc_id")
    return found.select(doc_id, "char_count", F.array_join("detected_types", ",").alias("detected_types"), "action", "match_count")


@query(
    "sink_metadata_log",
    f"""SELECT doc_id, 'direct' AS provider, CAST(NULL AS VARCHAR) AS model, '[' || CASE WHEN types = '' THEN '' ELSE '"' || replace(types, ',', '","') || '"' END || ']' AS detected_types,
         {_ACT} AS action, CAST(ceil(n_chars / 4) AS BIGINT) AS prompt_tokens, TIMESTAMP '{AS_OF}' AS timestamp FROM pd""",
    _DOC,
)
def sink_metadata_log(t):
    """Log rows of a scan: decision and types, never the text."""
    return sinks.metadata_log(S.scan(_docs(t), redact=False), ["doc_id"], AS_OF).drop("latency_ms")


@query("scan_summary_text", f"""SELECT doc_id, CASE WHEN n = 0 THEN 'No PII detected. Text is safe to use.' ELSE CASE WHEN {_ACT} = 'BLOCK' THEN 'BLOCKED' ELSE 'WARNING' END
   || ': Found ' || replace(types, ',', ', ') || ' (' || CAST(CAST(n AS BIGINT) AS VARCHAR) || ' match' || CASE WHEN n <> 1 THEN 'es' ELSE '' END || ')' END AS summary FROM pd""", _DOC)
def scan_summary_text(t):
    return S.scan(_docs(t), redact=False).select("doc_id", S.summary_text().alias("summary"))


@query("match_position", "SELECT doc_id, type, s || '-' || e AS position FROM kept", _KEPT)
def match_position(t):
    m = spans.explode_matches(spans.with_matches(_docs(t)), ["doc_id"])
    return m.select("doc_id", "type", F.concat_ws("-", "start", "end").alias("position"))


@query("hash_prefix", "SELECT doc_id, type, s AS start_at, '[' || type || ':' || sha256(v)[:8] || ']' AS tag FROM kept", _KEPT)
def hash_prefix(t):
    m = spans.explode_matches(spans.with_matches(_docs(t)), ["doc_id"])
    tag = F.concat(F.lit("["), F.col("type"), F.lit(":"), F.substring(F.sha2("value", 256), 1, 8), F.lit("]"))
    return m.select("doc_id", "type", F.col("start").cast("long").alias("start_at"), tag.alias("tag"))


@query("token_estimate", f"SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(t):
    from maskwright.functions.text import token_estimate as est

    return t.documents.select("doc_id", est(F.length("text")).alias("tokens"))
