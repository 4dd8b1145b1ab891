"""Projections, filters and validation over the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import policy, spans  # noqa: F401
from maskwright.operators import logs as L
from maskwright.operators import mutate as M
from maskwright.plans.detect_sql import q
from maskwright.plans.registry import query
from maskwright.sources.views import AS_OF

_EV = "id, org_id, ai_domain, action, data_types"


@query("f_org", f"SELECT {_EV} FROM policy_events WHERE org_id = 7")
def f_org(t):
    return t.policy_events.filter("org_id = 7").select(*_EV.split(", "))


@query(
    "f_event_type",
    """SELECT id, data_types, CASE WHEN json_valid(data_types) THEN list_contains(from_json(data_types, '["VARCHAR"]'), 'EMAIL') ELSE false END AS typed
       FROM policy_events WHERE data_types ILIKE '%"EMAIL"%'""",
)
def f_event_type(t):
    """Pattern on the raw JSON text (% and _ in the wanted type stay wildcards), typed form beside."""
    typed = F.coalesce(F.array_contains(F.from_json("data_types", "array<string>"), "EMAIL"), F.lit(False))
    return t.policy_events.filter(F.col("data_types").ilike('%"EMAIL"%')).select("id", "data_types", typed.alias("typed"))


@query("f_event_domain", f"SELECT {_EV} FROM policy_events WHERE ai_domain = 'claude.ai'")
def f_event_domain(t):
    return t.policy_events.filter("ai_domain = 'claude.ai'").select(*_EV.split(", "))


@query("f_event_action", f"SELECT {_EV} FROM policy_events WHERE action = 'BLOCK'")
def f_event_action(t):
    return t.policy_events.filter("action = 'BLOCK'").select(*_EV.split(", "))


@query(
    "f_event_client",
    f"SELECT {_EV}, acknowledged FROM policy_events WHERE contains(ai_domain, 'ai') AND contains(data_types, 'EMAIL') AND NOT acknowledged",
)
def f_event_client(t):
    """Substring of the domain, substring of the types, status pending."""
    df = t.policy_events.filter(F.contains("ai_domain", F.lit("ai")) & F.contains("data_types", F.lit("EMAIL")) & ~F.col("acknowledged"))
    return df.select(*_EV.split(", "), "acknowledged")


@query(
    "f_log_range",
    """SELECT id, project_id, action, timestamp FROM proxy_logs WHERE project_id = 3 AND timestamp >= TIMESTAMP '2024-01-05 00:00:00'
       AND timestamp <= TIMESTAMP '2024-01-20 00:00:00' AND action = 'WARN'""",
)
def f_log_range(t):
    cond = L.log_filter(project=3, start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", action="warn")
    return t.proxy_logs.filter(cond).select("id", "project_id", "action", "timestamp")


@query(
    "f_period_between",
    "SELECT id, org_id, timestamp FROM policy_events WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'",
)
def f_period_between(t):
    cond = F.col("timestamp").between(L.at("2024-01-10 00:00:00"), L.at("2024-01-20 00:00:00"))
    return t.policy_events.filter(cond).select("id", "org_id", "timestamp")


@query(
    "f_since",
    f"""SELECT org_id, count(*) FILTER (WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS d7, count(*) FILTER (WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS d30,
        count(*) FILTER (WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS d90 FROM policy_events GROUP BY org_id""",
)
def f_since(t):
    aggs = [F.count_if(L.since("timestamp", AS_OF, d)).alias(f"d{d}") for d in (7, 30, 90)]
    return t.policy_events.groupBy("org_id").agg(*aggs)


@query("f_null_checks", "SELECT id, project_id, revoked_at IS NULL AS active, monthly_limit IS NOT NULL AS limited FROM api_keys WHERE revoked_at IS NULL OR monthly_limit IS NOT NULL")
def f_null_checks(t):
    k = t.api_keys.filter(F.col("revoked_at").isNull() | F.col("monthly_limit").isNotNull())
    return k.select("id", "project_id", F.col("revoked_at").isNull().alias("active"), F.col("monthly_limit").isNotNull().alias("limited"))


_HOSTS = ", ".join(q(h) for h in policy.AI_DOMAINS)


@query("f_ai_domain", f"SELECT id, ai_domain, ai_domain IN ({_HOSTS}) AS known FROM policy_events")
def f_ai_domain(t):
    """Exact host membership: sub-domains do not match."""
    return t.policy_events.select("id", "ai_domain", policy.is_ai_domain(F.col("ai_domain")).alias("known"))


# upstream URL of a log row: by provider, with unusable and foreign ones mixed in
_URL = (
    "CASE {k} WHEN 0 THEN NULL WHEN 1 THEN 'https://api.x.ai/v1' WHEN 2 THEN 'https://openrouter.ai/api' WHEN 3 THEN 'https://evil.example/v1' "
    "WHEN 4 THEN 'not a url' WHEN 5 THEN 'https://api.groq.com' WHEN 6 THEN 'https://localhost:8080/x' ELSE 'https://api.openai.com/v1/' END"
)
_UPSTREAMS = ", ".join(q(h) for h in policy.UPSTREAM_HOSTS)
_HOST_SQL = r"nullif(regexp_extract(url, '^[a-z]+://([^/:?#\s]+)', 1), '')"
_URLS = {"urls": f"SELECT id, {_URL.format(k='id % 8')} AS url FROM proxy_logs"}


@query(
    "f_upstream_allow",
    f"""SELECT id, url, CASE WHEN url IS NULL THEN 'OK' WHEN {_HOST_SQL} IS NULL THEN 'INVALID_UPSTREAM' WHEN {_HOST_SQL} IN ({_UPSTREAMS}) THEN 'OK' ELSE 'UPSTREAM_NOT_ALLOWED' END AS code FROM urls""",
    _URLS,
)
def f_upstream_allow(t):
    df = t.proxy_logs.select("id", F.expr(_URL.format(k="id % 8")).alias("url"))
    return df.select("id", "url", policy.upstream_check(F.col("url")).alias("code"))


@query(
    "provider_of",
    f"SELECT id, url, CASE WHEN url IS NULL THEN 'openai' ELSE coalesce(nullif(split_part({_HOST_SQL}, '.', 2), ''), 'custom') END AS provider FROM urls",
    _URLS,
)
def provider_of(t):
    df = t.proxy_logs.select("id", F.expr(_URL.format(k="id % 8")).alias("url"))
    return df.select("id", "url", policy.provider_of(F.col("url")).alias("provider"))


_LIST = """CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]') ELSE [data_types] END"""


@query(
    "p_event_view",
    f"""SELECT id, timestamp, user_id AS "userId", ai_domain AS "aiDomain", rule_id AS "ruleId", array_to_string({_LIST}, '|') AS "dataTypes", action,
        extension_version AS "extensionVersion", acknowledged FROM policy_events""",
)
def p_event_view(t):
    return M.event_view(t.policy_events).withColumn("dataTypes", F.array_join("dataTypes", "|"))


@query(
    "json_types",
    f"""SELECT id, array_to_string({_LIST}, '|') AS as_event, array_to_string(CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]')
        ELSE list_filter(list_transform(string_split(data_types, ','), lambda x: trim(x)), lambda x: x <> '') END, '|') AS as_counts,
        CASE WHEN json_valid(data_types) THEN array_to_string(from_json(data_types, '["VARCHAR"]'), '; ') ELSE data_types END AS as_report FROM policy_events""",
)
def json_types(t):
    """The three readings of the stored types: list or [raw], list or comma split, joined or raw."""
    raw = F.col("data_types")
    report = F.coalesce(F.array_join(F.from_json(raw, "array<string>"), "; "), raw)
    return t.policy_events.select(
        "id",
        F.array_join(L.types_array(raw), "|").alias("as_event"),
        F.array_join(L.types_split(raw), "|").alias("as_counts"),
        report.alias("as_report"),
    )


@query(
    "p_user_view",
    """SELECT id, email, role, extension_installed AS "extensionInstalled", last_seen_at AS "lastSeenAt", created_at AS "createdAt" FROM users""",
)
def p_user_view(t):
    return t.users.selectExpr(
        "id", "email", "role", "extension_installed AS extensionInstalled", "last_seen_at AS lastSeenAt", "created_at AS createdAt"
    )


_PRESETS = {
    "presets": "SELECT * FROM (VALUES "
    + ", ".join(f"('{p}', '{ty}', '{a}')" for p, acts in policy.PRESETS.items() for ty, a in zip(policy.CONFIG_TYPES, acts))
    + ") p(preset, type, action)"
}


@query(
    "p_config_view",
    """SELECT oc.org_id, 'rule' AS kind, p.type AS name, p.action AS setting FROM org_config oc JOIN presets p ON p.preset = oc.preset
       UNION ALL SELECT org_id, 'url', 'approved', approved_ai_url FROM org_config
       UNION ALL SELECT org_id, 'upload', 'warning', CASE WHEN file_upload_warning THEN 'on' ELSE 'off' END FROM org_config"""
    + "".join(f" UNION ALL SELECT org_id, 'platform', '{p}', CASE WHEN ai_{p} THEN 'on' ELSE 'off' END FROM org_config" for p in M.PLATFORMS),
    _PRESETS,
)
def p_config_view(t):
    """Wide configuration row as two maps, then both maps unfolded to long form."""
    view = M.config_view(M.wide_config(t.org_config))
    rules = view.select("org_id", F.lit("rule").alias("kind"), F.explode("rules").alias("name", "setting"))
    flags = view.select("org_id", F.lit("platform").alias("kind"), F.explode("platforms").alias("name", "on"))
    shown = lambda c: F.when(F.col(c), "on").otherwise("off").alias("setting")
    url = view.select("org_id", F.lit("url").alias("kind"), F.lit("approved").alias("name"), F.col("approved_ai_url").alias("setting"))
    upload = view.select("org_id", F.lit("upload").alias("kind"), F.lit("warning").alias("name"), shown("file_upload_warning"))
    return rules.unionByName(flags.select("org_id", "kind", "name", shown("on"))).unionByName(url).unionByName(upload)


_POST = """SELECT id, ts, user_id, CASE WHEN type = 'platform_visit' THEN CASE WHEN ai_domain IS NULL THEN 'quarantine' ELSE 'visit' END
    WHEN ai_domain IS NULL OR action IS NULL THEN 'quarantine' WHEN action NOT IN ('WARN','BLOCK') THEN 'quarantine' ELSE 'event' END AS route,
    CASE WHEN ai_domain IS NULL AND type = 'platform_visit' THEN 'DOMAIN_REQUIRED' WHEN type = 'platform_visit' THEN NULL WHEN ai_domain IS NULL OR action IS NULL THEN 'DOMAIN_AND_ACTION_REQUIRED'
    WHEN action NOT IN ('WARN','BLOCK') THEN 'ILLEGAL_ACTION' END AS reason, ai_domain, action, coalesce(rule_id, source, 'detection') AS rule_id, CASE WHEN json_valid(data_types) AND json_type(data_types) = 'ARRAY' THEN data_types ELSE '[]' END AS data_types, coalesce(nullif(extension_version, ''), '1.1.0') AS extension_version FROM raw_posts"""


@query("validate_events", _POST)
def validate_events(t):
    return M.route_posts(t.raw_posts).select(
        "id", "ts", "user_id", "route", "reason", "ai_domain", "action", "rule_id", "data_types", "extension_version"
    )


@query(
    "validate_config",
    """SELECT u.id, u.action AS wanted, CASE WHEN u.action IN ('WARN','BLOCK') THEN u.action END AS legacy, u.action IS NOT NULL AND u.action NOT IN ('WARN','BLOCK') AS legacy_rejected,
       CASE WHEN u.action IN ('ALLOW','WARN','BLOCK') THEN u.action END AS policy FROM raw_posts u""",
)
def validate_config(t):
    """Requested actions under both rules: the old route rejects, the new one ignores."""
    a = F.col("action")
    return t.raw_posts.select(
        "id",
        a.alias("wanted"),
        policy.legal_action(a, policy.EVENT_ACTIONS).alias("legacy"),
        (a.isNotNull() & ~F.coalesce(a.isin(*policy.EVENT_ACTIONS), F.lit(False))).alias("legacy_rejected"),
        policy.legal_action(a).alias("policy"),
    )


@query(
    "clean_terms",
    """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:50], lambda x: substr(trim(x), 1, 100)), '|') AS terms FROM documents""",
)
def clean_terms(t):
    """Lines of each document taken as a tenant's term list."""
    terms = policy.clean_terms(F.split("text", "\n", -1))
    return t.documents.select("doc_id", F.array_join(terms, "|").alias("terms"))
