"""Streaming jobs run to the end of their input; the final tables are compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.plans import detect_sql as D
from maskwright.plans.aggregates import LITERACY_SQL, TYPED
from maskwright.plans.filters import _POST
from maskwright.plans.registry import query
from maskwright.plans.scanning import _ACT, _DOC, _ORG
from maskwright.plans.windows import _CHAIN, _QUOTA
from maskwright.sources.golden import seeded
from maskwright.sources.views import AS_OF, VIEWS, shape
from maskwright.streaming import jobs
from maskwright.streaming import runtime as rt


def _events(t):
    return rt.file_stream(t.spark, t.sf_dir, "events")


def _posts(t):
    return shape(shape(_events(t), VIEWS["ev"]), VIEWS["raw_posts"])


def _policy_events(t):
    return shape(shape(_events(t), VIEWS["ev"]), VIEWS["policy_events"], t.customer)


def _logs(t):
    return shape(shape(_events(t), VIEWS["ev"]), VIEWS["proxy_logs"], t.customer)


def _texts(t):
    return seeded(rt.file_stream(t.spark, t.sf_dir, "documents")).select("doc_id", "text")


@query("st_ingest", f"SELECT id, user_id, route, reason, ai_domain, action, rule_id, data_types, extension_version FROM ({_POST})")
def st_ingest(t):
    out = rt.new_folder(t.spark, "ingest")
    jobs.ingest(_posts(t), out)
    return rt.table(t.spark, out, "posts").select(
        "id", "user_id", "route", "reason", "ai_domain", "action", "rule_id", "data_types", "extension_version"
    )


@query(
    "st_user_counters",
    f"""SELECT user_id, count(*) FILTER (WHERE route = 'event' AND action = 'BLOCK') AS block_count, count(*) FILTER (WHERE route = 'event' AND action = 'WARN') AS warn_count, max(ts) AS last_seen_at
        FROM ({_POST}) WHERE route <> 'quarantine' GROUP BY user_id""",
)
def st_user_counters(t):
    out = rt.new_folder(t.spark, "counters")
    jobs.user_counters(_posts(t), out)
    return rt.latest(t.spark, out, "counters", ["user_id"])


@query("st_rate_limit", _CHAIN, {"reqs": "SELECT id, client, at_s FROM requests"})
def st_rate_limit(t):
    out = rt.new_folder(t.spark, "limiter")
    req = shape(shape(_events(t), VIEWS["ev"]), VIEWS["requests"]).withColumnRenamed("at_s", "at")
    jobs.rate_limit(req, out)
    done = rt.table(t.spark, out, "decisions").filter("id IS NOT NULL")
    return done.select("id", "client", "window_start", "n", "limited", "remaining")


@query(
    "st_scan_gate",
    f"""SELECT doc_id, CASE WHEN action = 'BLOCK' THEN 'held' ELSE 'passed' END AS route, action, '[' || CASE WHEN types = '' THEN '' ELSE '"' || replace(types, ',', '","') || '"' END || ']' AS detected_types, prompt_tokens
        FROM (SELECT doc_id, types, {_ACT} AS action, CAST(ceil(n_chars / 4) AS BIGINT) AS prompt_tokens FROM pd)""",
    _DOC,
)
def st_scan_gate(t):
    out = rt.new_folder(t.spark, "gate")
    jobs.scan_gate(_texts(t), out, AS_OF)
    gate = rt.table(t.spark, out, "gate").select("doc_id", "route")
    log = rt.table(t.spark, out, "log").select("doc_id", "action", "detected_types", "prompt_tokens")
    return gate.join(log, "doc_id")


@query(
    "st_alerts",
    """SELECT l.id, l.project_id, webhook_url, ev_type AS event_type, '{"event":"' || ev_type || '","project_id":' || l.project_id || ',"org_id":' || p.org_id || ',"timestamp":"' || strftime(l.timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","data":{"action":"' || action || '","detected_types":' || detected_types || '}}' AS payload
       FROM (SELECT *, CASE WHEN action = 'BLOCK' THEN 'scan.blocked' ELSE 'scan.warned' END AS ev_type FROM proxy_logs WHERE action <> 'ALLOW') l JOIN dev_projects p ON p.id = l.project_id AND p.webhook_url IS NOT NULL""",
)
def st_alerts(t):
    out = rt.new_folder(t.spark, "alerts")
    jobs.alerts(_logs(t), t.dev_projects, out)
    return rt.table(t.spark, out, "outbox").select("id", "project_id", "webhook_url", "event_type", "payload")


@query("st_quota", _QUOTA.format(month=", date_trunc('month', timestamp)"))
def st_quota(t):
    out = rt.new_folder(t.spark, "quota")
    keys = t.api_keys.select(F.col("id").alias("key_id"), "monthly_limit")
    jobs.quota(_logs(t).select("id", "key_id", "timestamp"), keys, out)
    return rt.table(t.spark, out, "decisions").select("id", "key_id", "n", "status")


@query("st_literacy", LITERACY_SQL, TYPED)
def st_literacy(t):
    out = rt.new_folder(t.spark, "literacy")
    jobs.literacy(_policy_events(t), out)
    return rt.latest(t.spark, out, "literacy", ["user_id"])


@query(
    "st_activity_windows",
    """SELECT window_start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) - to_days(CAST(unnest(range(0, 7)) AS INT)) AS window_start FROM events) GROUP BY window_start, event_type""",
)
def st_activity_windows(t):
    out = rt.new_folder(t.spark, "windows")
    jobs.activity_windows(_events(t).select("ts", "event_type"), out)
    done = rt.latest(t.spark, out, "windows", ["window_start", "event_type"])
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "st_config_refresh",
    """SELECT o.doc_id, CAST(o.org_id AS BIGINT) AS org_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_matches,
         CASE WHEN count(*) FILTER (WHERE p.action = 'BLOCK') > 0 THEN 'BLOCK' WHEN count(*) FILTER (WHERE p.action = 'WARN' OR tt.type = 'CUSTOM_TERM') > 0 THEN 'WARN' ELSE 'ALLOW' END AS action
       FROM owned o LEFT JOIN tt ON tt.doc_id = o.doc_id LEFT JOIN presets p ON p.preset = o.preset AND p.type = tt.type GROUP BY o.doc_id, o.org_id""",
    _ORG,
)
def st_config_refresh(t):
    out = rt.new_folder(t.spark, "config")
    cache = jobs.ConfigCache(lambda: t.org_config)
    jobs.scan_with_config(_texts(t).withColumn("org_id", F.col("doc_id") % 25), cache, out)
    return rt.table(t.spark, out, "decisions").select("doc_id", "org_id", "n_matches", "action")
