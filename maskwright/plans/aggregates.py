"""Dashboard, compliance, usage and admin aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import policy
from maskwright.operators import logs as L
from maskwright.operators import mutate as M
from maskwright.operators import reports as R
from maskwright.plans.detect_sql import q
from maskwright.plans.filters import _PRESETS
from maskwright.plans.joins import INVENTORY_SQL
from maskwright.plans.registry import query
from maskwright.sources.views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
WEEK = f"timestamp >= {NOW} - INTERVAL 7 DAY"
START, END = "2023-11-02 00:00:00", AS_OF
_PCT = "CAST(floor({a} * 100.0 / {b} + 0.5) AS BIGINT)"


def _pct(a, b, none):
    return f"CASE WHEN {b} > 0 THEN CAST(floor(CAST({a} AS DOUBLE) / {b} * 100 + 0.5) AS BIGINT) ELSE {none} END"


@query(
    "week_actions",
    f"""SELECT org_id, count(*) FILTER (WHERE action = 'WARN' AND {WEEK}) AS week_warnings, count(*) FILTER (WHERE action = 'BLOCK' AND {WEEK}) AS week_blocks,
        count(*) FILTER (WHERE {WEEK}) AS week_total FROM policy_events GROUP BY org_id""",
)
def week_actions(t):
    return R.event_counts(t.policy_events, AS_OF).select("org_id", "week_warnings", "week_blocks", "week_total")


@query("events_total", "SELECT org_id, count(*) AS total_events FROM policy_events GROUP BY org_id")
def events_total(t):
    return R.event_counts(t.policy_events, AS_OF).select("org_id", "total_events")


_TEAM = f"""SELECT o.id AS org_id, coalesce(n, 0) AS total, coalesce(i, 0) AS installed, coalesce(tr, 0) AS trained, coalesce(o.seats, 10) AS seats,
   {_pct('coalesce(tr, 0)', 'coalesce(n, 0)', 0)} AS pct_trained FROM orgs o LEFT JOIN (SELECT org_id, count(*) AS n, count(*) FILTER (WHERE extension_installed) AS i,
   count(policy_acknowledged_at) AS tr FROM users GROUP BY org_id) u ON u.org_id = o.id"""


@query("team_counts", _TEAM)
def team_counts(t):
    return R.team_counts(t.orgs, t.users)


@query("seat_usage", f"SELECT org_id, total AS used, seats AS total, total >= seats AS limit_reached FROM ({_TEAM})")
def seat_usage(t):
    return R.seat_usage(t.orgs, t.users)


@query(
    "top_types",
    f"""SELECT org_id, type, count(*) AS n FROM (SELECT org_id, unnest(CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]')
        ELSE list_filter(list_transform(string_split(data_types, ','), lambda x: trim(x)), lambda x: x <> '') END) AS type FROM policy_events WHERE {WEEK}) GROUP BY org_id, type""",
)
def top_types(t):
    return R.top_types(t.policy_events, AS_OF).orderBy("org_id", F.desc("n"), "type")


@query(
    "top_platforms",
    f"""SELECT org_id, ai_domain, n FROM (SELECT org_id, ai_domain, count(*) AS n, row_number() OVER (PARTITION BY org_id ORDER BY count(*) DESC, ai_domain) AS r
        FROM policy_events WHERE {WEEK} GROUP BY org_id, ai_domain) WHERE r <= 10""",
)
def top_platforms(t):
    n = t.policy_events.filter(L.since("timestamp", AS_OF, 7)).groupBy("org_id", "ai_domain").agg(F.count("*").alias("n"))
    return L.top_per(n, ["org_id"], [F.desc("n"), F.col("ai_domain")], 10).drop("row_no")


@query("unacked_blocks", "SELECT org_id, count(*) FILTER (WHERE action = 'BLOCK' AND NOT acknowledged) AS pending_blocks FROM policy_events GROUP BY org_id")
def unacked_blocks(t):
    return R.event_counts(t.policy_events, AS_OF).select("org_id", "pending_blocks")


@query(
    "platform_discovery",
    f"SELECT org_id, ai_domain, count(DISTINCT user_id) AS users, count(*) AS visits FROM platform_visits WHERE visited_at >= {NOW} - INTERVAL 30 DAY GROUP BY org_id, ai_domain",
)
def platform_discovery(t):
    return R.visits_by_domain(t.platform_visits.filter(L.since("visited_at", AS_OF, 30))).drop("last_seen")


@query(
    "inventory_agg",
    "SELECT org_id, ai_domain, count(DISTINCT user_id) AS users, count(*) AS visits, max(visited_at) AS last_seen FROM platform_visits GROUP BY org_id, ai_domain",
)
def inventory_agg(t):
    return R.visits_by_domain(t.platform_visits)


_INC = f"""SELECT org_id, qb AS quarter_blocks, ab AS acknowledged_blocks, pb AS pending_blocks, {_pct('ab', 'qb', 100)} AS resolution_rate FROM (
   SELECT org_id, count(*) FILTER (WHERE action = 'BLOCK' AND timestamp >= {NOW} - INTERVAL 90 DAY) AS qb, count(*) FILTER (WHERE action = 'BLOCK' AND acknowledged AND timestamp >= {NOW} - INTERVAL 90 DAY) AS ab,
   count(*) FILTER (WHERE action = 'BLOCK' AND NOT acknowledged) AS pb FROM policy_events GROUP BY org_id)"""


@query("incident_stats", _INC)
def incident_stats(t):
    return R.incident_stats(t.policy_events, AS_OF)


_TOOLS = f"""SELECT org_id, approved, flagged, reviewed, tools, {_pct('reviewed', 'tools', 100)} AS pct_tools_reviewed FROM (SELECT org_id, count(*) FILTER (WHERE status = 'approved') AS approved,
   count(*) FILTER (WHERE status = 'flagged') AS flagged, count(*) FILTER (WHERE status <> 'discovered') AS reviewed, count(*) AS tools FROM ({INVENTORY_SQL}) GROUP BY org_id)"""


@query("tool_summary", _TOOLS)
def tool_summary(t):
    return R.tool_summary(R.inventory(t.platform_visits, t.ai_tools))


@query(
    "posture_score",
    f"""SELECT a.org_id, a.pct_trained, coalesce(b.resolution_rate, 100) AS resolution_rate, coalesce(c.pct_tools_reviewed, 100) AS pct_tools_reviewed,
        CAST(floor(CAST(0 AS DOUBLE) + CAST(a.pct_trained AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(coalesce(b.resolution_rate, 100) AS DOUBLE) * CAST(0.3 AS DOUBLE)
          + CAST(coalesce(c.pct_tools_reviewed, 100) AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS score
        FROM ({_TEAM}) a LEFT JOIN ({_INC}) b ON b.org_id = a.org_id LEFT JOIN ({_TOOLS}) c ON c.org_id = a.org_id""",
)
def posture_score(t):
    return R.posture(t.orgs, t.users, t.policy_events, t.platform_visits, t.ai_tools, AS_OF)


_LOGS = """SELECT {by}count(*) AS total_calls, count(*) FILTER (WHERE action = 'ALLOW') AS allowed, count(*) FILTER (WHERE action = 'WARN') AS warned,
   count(*) FILTER (WHERE action = 'BLOCK') AS blocked, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS total_tokens, CAST(floor(nullif(avg(latency_ms), 0) + 0.5) AS BIGINT) AS avg_latency_ms,
   printf('%.1f', round(CAST(count(*) FILTER (WHERE action = 'BLOCK') AS DOUBLE) / count(*) * 100, 1)) || '%' AS block_rate FROM proxy_logs"""


@query("log_stats", _LOGS.format(by="org_id, project_id, ") + " GROUP BY org_id, project_id")
def log_stats(t):
    return R.log_stats(t.proxy_logs, ["org_id", "project_id"])


@query(
    "project_usage",
    """SELECT p.id, p.org_id, json_extract_string(p.rules, '$.EMAIL') AS email_rule, CAST(coalesce(json_array_length(p.custom_terms), 0) AS BIGINT) AS n_terms, coalesce(k, 0) AS key_count, coalesce(a, 0) AS active_key_count,
       CAST(coalesce(c, 0) AS BIGINT) AS total_calls FROM dev_projects p LEFT JOIN (SELECT project_id, count(DISTINCT id) AS k, count(DISTINCT CASE WHEN revoked_at IS NULL THEN id END) AS a, sum(calls_total) AS c
       FROM api_keys GROUP BY project_id) u ON u.project_id = p.id""",
)
def project_usage(t):
    df = R.project_usage(t.dev_projects, t.api_keys)
    return df.select(
        "id",
        "org_id",
        F.get_json_object("rules", "$.EMAIL").alias("email_rule"),
        F.size(F.from_json("custom_terms", "array<string>")).cast("long").alias("n_terms"),
        "key_count",
        "active_key_count",
        "total_calls",
    )


@query(
    "platform_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE plan = 'trial') AS trialling, count(*) FILTER (WHERE plan = 'trial' AND trial_ends_at < {NOW}) AS trial_expired,
        count(*) FILTER (WHERE plan = 'active') AS active, count(*) FILTER (WHERE plan = 'cancelled') AS cancelled, count(*) FILTER (WHERE plan = 'super') AS super_plans,
        count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 7 DAY) AS last_7_days, count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 30 DAY) AS last_30_days,
        49 * count(*) FILTER (WHERE plan = 'active') AS mrr_estimate FROM orgs""",
)
def platform_stats(t):
    return R.platform_stats(t.orgs, AS_OF)


_USERC = """SELECT user_id, count(*) FILTER (WHERE action = 'BLOCK') AS block_count, count(*) FILTER (WHERE action = 'WARN') AS warn_count, max(timestamp) AS last_seen_at,
   true AS extension_installed FROM policy_events GROUP BY user_id"""


@query("user_counters", _USERC)
def user_counters(t):
    return R.user_counters(t.policy_events)


@query(
    "key_counters",
    f"""SELECT key_id, count(*) FILTER (WHERE date_trunc('month', timestamp) = date_trunc('month', {NOW})) AS calls_this_month, count(*) AS calls_total, max(timestamp) AS last_used_at FROM proxy_logs GROUP BY key_id""",
)
def key_counters(t):
    return R.key_counters(t.proxy_logs, AS_OF)


TOTALS_SQL = f"""SELECT coalesce(m.org_id, e.org_id) AS org_id, coalesce(members, 0) AS members, coalesce(trained, 0) AS trained, coalesce(events, 0) AS events, coalesce(blocks, 0) AS blocks,
   coalesce(blocks_reviewed, 0) AS blocks_reviewed, CAST(floor(CAST(coalesce(trained, 0) AS DOUBLE) / greatest(coalesce(members, 0), 1) * 100 + 0.5) AS BIGINT) AS pct_trained FROM
   (SELECT org_id, count(*) AS members, count(policy_acknowledged_at) AS trained FROM users GROUP BY org_id) m FULL JOIN
   (SELECT org_id, count(*) AS events, count(*) FILTER (WHERE action = 'BLOCK') AS blocks, count(*) FILTER (WHERE action = 'BLOCK' AND acknowledged) AS blocks_reviewed FROM policy_events
    WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY org_id) e ON e.org_id = m.org_id"""


@query("report_totals", TOTALS_SQL)
def report_totals(t):
    return R.report_totals(t.users, t.policy_events, START, END)


PRIMARY_SQL = """CASE WHEN list_contains(tl, 'CREDIT_CARD') THEN 'CREDIT_CARD' WHEN list_contains(tl, 'IBAN') THEN 'IBAN' WHEN list_contains(tl, 'PASSWORD') THEN 'PASSWORD'
   WHEN list_contains(tl, 'PHONE') THEN 'PHONE' WHEN list_contains(tl, 'EMAIL') THEN 'EMAIL' WHEN list_contains(tl, 'ADDRESS') THEN 'ADDRESS' WHEN list_contains(tl, 'CUSTOM_TERM') THEN 'CUSTOM_TERM' ELSE 'DEFAULT' END"""
TYPED = {
    "typed": f"""SELECT id, user_id, timestamp, {PRIMARY_SQL} AS p FROM (SELECT *, CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]') ELSE [data_types] END AS tl FROM policy_events)"""
}
LABEL_SQL = "CASE WHEN score >= 80 THEN 'Advanced' WHEN score >= 50 THEN 'Developing' WHEN score >= 20 THEN 'Learning' ELSE 'Getting started' END"
LITERACY_SQL = f"""SELECT *, {LABEL_SQL} AS label FROM (SELECT user_id, count(DISTINCT p) AS types, count(*) AS anonymised,
   least(100, least(count(DISTINCT p), 6) * 10 + least(count(*), 8) * 5) AS score FROM typed GROUP BY user_id)"""


@query("literacy_score", LITERACY_SQL, TYPED)
def literacy_score(t):
    """Every event counts as anonymised here."""
    return R.literacy_score(t.policy_events)


_LABELS = {
    **_PRESETS,
    "labels_t": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(k)}, {q(v)})" for i, (k, v) in enumerate(R.POLICY_LABELS.items())) + ") l(o, type, label)",
}


@query(
    "policy_labels",
    """SELECT oc.org_id, coalesce(string_agg(l.label, '; ' ORDER BY l.o) FILTER (WHERE p.action = 'BLOCK'), '') AS blocked, coalesce(string_agg(l.label, '; ' ORDER BY l.o) FILTER (WHERE p.action = 'WARN'), '') AS warned
       FROM org_config oc JOIN presets p ON p.preset = oc.preset JOIN labels_t l ON l.type = p.type GROUP BY oc.org_id""",
    _LABELS,
)
def policy_labels(t):
    return R.policy_labels(M.config_view(M.wide_config(t.org_config)))


_CONTROL = {"controls": "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {d})" for a, b, c, _, d in R.CONTROLS) + ") c(framework, control, name, section)"}


@query(
    "control_map",
    f"""SELECT t.org_id, c.framework, c.control, c.name, c.section, CASE c.section WHEN 1 THEN t.members WHEN 2 THEN t.events WHEN 3 THEN coalesce(i.n, 0) END AS evidence_rows
        FROM ({TOTALS_SQL}) t LEFT JOIN (SELECT org_id, count(*) AS n FROM ({INVENTORY_SQL}) GROUP BY org_id) i ON i.org_id = t.org_id, controls c""",
    _CONTROL,
)
def control_map(t):
    """The fixed control table against the number of evidence rows per tenant: each tenant's
    counts are unfolded to one row per section and joined on the section."""
    totals = R.report_totals(t.users, t.policy_events, START, END)
    tools = R.inventory(t.platform_visits, t.ai_tools).groupBy("org_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    none = F.lit(None).cast("long")
    sections = F.array(
        *[F.struct(F.lit(s).alias("section"), v.alias("evidence_rows")) for s, v in [(0, none), (1, F.col("members")), (2, F.col("events")), (3, n)]]
    )
    long = totals.join(tools, "org_id", "left").select("org_id", F.inline(sections))
    return long.join(R.control_map(t.spark).drop("implementation"), "section")
