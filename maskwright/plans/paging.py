"""Sorted pages. Every page is taken for all tenants at once; ids break ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import logs as L
from maskwright.operators import pages as P
from maskwright.operators import reports as R
from maskwright.plans.registry import query


def _page_sql(view, key, ts, cols, lo, hi, extra):
    return f"""SELECT {key}, {cols}, row_no, total, {extra} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts} DESC, id) AS row_no,
       count(*) OVER (PARTITION BY {key}) AS total FROM {view}) WHERE row_no > {lo} AND row_no <= {hi}"""


@query(
    "page_events",
    _page_sql("policy_events", "org_id", "timestamp", "id, timestamp, action", 20, 40, "2 AS page, CAST(ceil(total / 20) AS BIGINT) AS total_pages"),
)
def page_events(t):
    return P.page(t.policy_events, "org_id", "timestamp", page=2, limit=20).select(
        "org_id", "id", "timestamp", "action", "row_no", "total", "page", "total_pages"
    )


@query(
    "sink_event_pages",
    f"""SELECT org_id, '{{"events":[' || string_agg('{{"id":' || id || ',"aiDomain":"' || ai_domain || '","action":"' || action || '"}}', ',' ORDER BY row_no)
          || '],"pagination":{{"page":1,"limit":20,"total":' || total || ',"totalPages":' || total_pages || '}}}}' AS json
        FROM ({_page_sql("policy_events", "org_id", "timestamp", "id, ai_domain, action", 0, 20, "1 AS page, CAST(ceil(total / 20) AS BIGINT) AS total_pages")}) GROUP BY org_id, total, total_pages""",
)
def sink_event_pages(t):
    """First page of every tenant's events as the JSON envelope of the event list."""
    cut = P.page(t.policy_events, "org_id", "timestamp", page=1, limit=20).withColumnRenamed("ai_domain", "aiDomain")
    return P.page_envelopes(cut, "org_id", "events", ["id", "aiDomain", "action"], 20)


@query(
    "page_users",
    _page_sql("users", "org_id", "created_at", "id, email, created_at", 0, 50, "1 AS page, CAST(ceil(total / 50) AS BIGINT) AS total_pages"),
)
def page_users(t):
    return P.page(t.users, "org_id", "created_at", page=0, limit=None).select(
        "org_id", "id", "email", "created_at", "row_no", "total", "page", "total_pages"
    )


@query(
    "page_logs",
    _page_sql("proxy_logs", "org_id", "timestamp", "id, project_id, action, timestamp", 30, 80, "80 < total AS has_more"),
)
def page_logs(t):
    return P.offset_page(t.proxy_logs, "org_id", "timestamp", limit=50, offset=30).select(
        "org_id", "id", "project_id", "action", "timestamp", "row_no", "total", "has_more"
    )


@query(
    "recent_events",
    """SELECT e.org_id, e.id, e.timestamp, e.ai_domain, e.action, u.email AS user_email FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY timestamp DESC, id) AS r FROM policy_events) e
       LEFT JOIN users u ON u.id = e.user_id WHERE r <= 5""",
)
def recent_events(t):
    """Cut to five per tenant before the e-mail is looked up."""
    top = L.top_per(t.policy_events, ["org_id"], [F.desc("timestamp"), F.col("id")], 5)
    return R.with_user_email(top, t.users).select("org_id", "id", "timestamp", "ai_domain", "action", "user_email")


@query(
    "recent_deliveries",
    "SELECT project_id, id, event_type, response_status, delivered_at, failed_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS r FROM webhook_deliveries) WHERE r <= 20",
)
def recent_deliveries(t):
    top = L.top_per(t.webhook_deliveries, ["project_id"], [F.desc("created_at"), F.col("id")], 20)
    return top.select("project_id", "id", "event_type", "response_status", "delivered_at", "failed_at")


@query(
    "recent_signups",
    """SELECT o.domain, o.plan, coalesce(u.n, 0) AS members, coalesce(e.n, 0) AS events, o.trial_ends_at, o.created_at FROM (SELECT * FROM orgs ORDER BY created_at DESC, id LIMIT 10) o
       LEFT JOIN (SELECT org_id, count(*) AS n FROM users GROUP BY org_id) u ON u.org_id = o.id LEFT JOIN (SELECT org_id, count(*) AS n FROM policy_events GROUP BY org_id) e ON e.org_id = o.id""",
)
def recent_signups(t):
    newest = t.orgs.orderBy(F.desc("created_at"), "id").limit(10)
    return R.org_rollup(newest, t.users, t.policy_events).select("domain", "plan", "members", "events", "trial_ends_at", "created_at")


@query("members_order", "SELECT id, org_id, role, email FROM users ORDER BY org_id, role DESC, email ASC NULLS FIRST, id")
def members_order(t):
    return P.members_in_order(t.users).select("id", "org_id", "role", "email")


@query("team_order", "SELECT id, org_id, role, created_at FROM users ORDER BY org_id, role DESC, created_at, id")
def team_order(t):
    return P.members_in_order(t.users, by="created_at").select("id", "org_id", "role", "created_at")


@query(
    "keys_order",
    """SELECT project_id, id, substr(raw_key, 1, 12) || '...' AS key_preview, monthly_limit, revoked_at, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS row_no FROM api_keys""",
)
def keys_order(t):
    """Keys of a project, newest first (ids are given in order of creation)."""
    newest = P.numbered(t.api_keys, ["project_id"], "id", descending=True)
    return newest.select("project_id", "id", R.key_preview(F.col("raw_key")).alias("key_preview"), "monthly_limit", "revoked_at", "row_no")
