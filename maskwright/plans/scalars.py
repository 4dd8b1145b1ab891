"""Scalar rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import logs as L
from maskwright.operators import reports as R
from maskwright.plans.aggregates import TYPED
from maskwright.plans.detect_sql import q
from maskwright.plans.registry import query
from maskwright.sources.views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


@query(
    "member_status",
    """SELECT id, CASE WHEN role = 'admin' THEN 'active' WHEN invite_status = 'invited' AND NOT extension_installed THEN 'invited' WHEN extension_installed AND last_seen_at IS NOT NULL THEN 'active'
       WHEN extension_installed THEN 'installed' ELSE 'pending' END AS status FROM users""",
)
def member_status(t):
    return t.users.select("id", R.member_status().alias("status"))


@query(
    "trial_state",
    f"""SELECT id, plan, CASE WHEN plan = 'trial' THEN greatest(0, CAST(ceil(date_diff('second', {NOW}, trial_ends_at) / 86400.0) AS BIGINT)) END AS days_left,
        plan = 'cancelled' OR (plan NOT IN ('super', 'active') AND trial_ends_at < {NOW}) AS locked FROM orgs""",
)
def trial_state(t):
    days = F.when(F.col("plan") == "trial", R.trial_days_left(F.col("trial_ends_at"), AS_OF))
    return t.orgs.select("id", "plan", days.alias("days_left"), R.trial_locked(F.col("plan"), F.col("trial_ends_at"), AS_OF).alias("locked"))


def _case(table, col):
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())


@query("plan_label", f"SELECT id, {_case(R.PLAN_LABELS, 'plan')} ELSE plan END AS label FROM orgs")
def plan_label(t):
    return t.orgs.select("id", R.plan_label(F.col("plan")).alias("label"))


@query(
    "type_label",
    f"SELECT id, p AS type, {_case(R.TYPE_NAMES, 'p')} ELSE p END AS label, {_case(R.TYPE_HINTS, 'p')} ELSE {q(R.TYPE_HINT_OTHER)} END AS hint FROM typed",
    TYPED,
)
def type_label(t):
    p = R.primary_type(L.types_array(F.col("data_types")))
    df = t.policy_events.select("id", p.alias("type"))
    return df.select("id", "type", R.type_label(F.col("type")).alias("label"), R.type_hint(F.col("type")).alias("hint"))


@query(
    "time_ago",
    f"""SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hours ago' WHEN s < 604800 THEN s // 86400 || ' days ago'
        ELSE strftime(timestamp, '%Y-%m-%d') END AS ago FROM (SELECT id, timestamp, date_sub('second', timestamp, {NOW}) AS s FROM policy_events)""",
)
def time_ago(t):
    return t.policy_events.select("id", R.time_ago(F.col("timestamp"), AS_OF).alias("ago"))


@query(
    "round_pct",
    """SELECT user_id, CAST(floor(CAST(b AS DOUBLE) / n * 100 + 0.5) AS BIGINT) AS pct, printf('%.1f', round(CAST(b AS DOUBLE) / n * 100, 1)) AS pct1 FROM
       (SELECT user_id, count(*) FILTER (WHERE action = 'BLOCK') AS b, count(*) AS n FROM policy_events GROUP BY user_id)""",
)
def round_pct(t):
    c = t.policy_events.groupBy("user_id").agg(F.count_if(F.col("action") == "BLOCK").alias("b"), F.count("*").alias("n"))
    return c.select("user_id", L.pct(F.col("b"), F.col("n"), 0).alias("pct"), R.one_decimal(F.col("b") / F.col("n") * 100).alias("pct1"))


@query("csv_quote", """SELECT org_id, domain, '"' || replace(coalesce(notes, ''), '"', '""') || '"' AS quoted FROM ai_tools""")
def csv_quote(t):
    return t.ai_tools.select("org_id", "domain", R.csv_quote(F.col("notes")).alias("quoted"))


@query("email_domain", "SELECT id, lower(split_part(upper(email), '@', 2)) AS domain FROM users WHERE email IS NOT NULL")
def email_domain(t):
    return t.users.filter("email IS NOT NULL").select("id", R.email_domain(F.upper("email")).alias("domain"))


@query("key_hash", "SELECT id, sha256(raw_key) AS hash, substr(raw_key, 1, 12) || '...' AS preview FROM api_keys")
def key_hash(t):
    return t.api_keys.select("id", R.key_hash(F.col("raw_key")).alias("hash"), R.key_preview(F.col("raw_key")).alias("preview"))


@query("key_preview", "SELECT id, project_id, substr(raw_key, 1, 12) || '...' AS preview FROM api_keys WHERE revoked_at IS NULL")
def key_preview(t):
    return t.api_keys.filter("revoked_at IS NULL").select("id", "project_id", R.key_preview(F.col("raw_key")).alias("preview"))


@query(
    "type_hint",
    f"""SELECT id, string_agg({_case(R.TYPE_HINTS, 'x')} ELSE {q(R.TYPE_HINT_OTHER)} END, ' ' ORDER BY i) AS hints FROM (SELECT id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM
        (SELECT id, CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]') ELSE [data_types] END AS l FROM policy_events)) GROUP BY id""",
)
def type_hint(t):
    """Hints for all types of an event, in order."""
    hints = F.transform(L.types_array(F.col("data_types")), R.type_hint)
    return t.policy_events.filter(F.size(L.types_array(F.col("data_types"))) > 0).select("id", F.array_join(hints, " ").alias("hints"))


@query("primary_type", "SELECT id, p AS primary_type FROM typed", TYPED)
def primary_type(t):
    return t.policy_events.select("id", R.primary_type(L.types_array(F.col("data_types"))).alias("primary_type"))
