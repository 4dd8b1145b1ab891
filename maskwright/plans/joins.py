"""Joins between logs, tenants, users, projects and keys. Strategies are left to Catalyst/AQE."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import logs as L
from maskwright.operators import reports as R
from maskwright.plans.registry import query
from maskwright.sources.views import AS_OF


@query(
    "j_event_user",
    """SELECT e.id, e.timestamp, e.org_id, e.user_id, u.email AS user_email, coalesce(u.email, 'anonymous') AS shown_as, e.action
       FROM policy_events e LEFT JOIN users u ON u.id = e.user_id""",
)
def j_event_user(t):
    return R.with_user_email(t.policy_events, t.users).select(
        "id", "timestamp", "org_id", "user_id", "user_email", F.coalesce("user_email", F.lit("anonymous")).alias("shown_as"), "action"
    )


@query(
    "j_log_project",
    """SELECT l.id, l.project_id, p.name AS project_name, l.provider, l.model, l.detected_types, l.action, l.prompt_tokens, l.latency_ms, l.timestamp
       FROM proxy_logs l LEFT JOIN dev_projects p ON p.id = l.project_id""",
)
def j_log_project(t):
    return R.with_project_name(t.proxy_logs, t.dev_projects).select(
        "id", "project_id", "project_name", "provider", "model", "detected_types", "action", "prompt_tokens", "latency_ms", "timestamp"
    )


@query(
    "j_key_project",
    """SELECT r.id AS request_id, k.id AS key_id, p.id AS project_id, p.name AS project_name FROM (SELECT id, sha256('key_live_' || key_id) AS h FROM proxy_logs) r
       JOIN api_keys k ON k.key_hash = r.h AND k.revoked_at IS NULL JOIN dev_projects p ON p.id = k.project_id""",
)
def j_key_project(t):
    """Requests carry a raw key; only its hash is stored, and revoked keys do not match."""
    sent = t.proxy_logs.select(
        F.col("id").alias("request_id"), F.sha2(F.concat(F.lit("key_live_"), F.col("key_id").cast("string")), 256).alias("key_hash")
    )
    keys = t.api_keys.filter("revoked_at IS NULL").select(F.col("id").alias("key_id"), "project_id", "key_hash")
    projects = t.dev_projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    live = keys.join(projects, "project_id")
    return sent.join(live, "key_hash").select("request_id", "key_id", "project_id", "project_name")


INVENTORY_SQL = """SELECT coalesce(d.org_id, t.org_id) AS org_id, coalesce(d.ai_domain, t.domain) AS domain, coalesce(users, 0) AS users, coalesce(visits, 0) AS visits, last_seen,
    coalesce(t.status, 'discovered') AS status, coalesce(t.risk_level, 'limited') AS risk_level, t.notes FROM
    (SELECT org_id, ai_domain, count(DISTINCT user_id) AS users, count(*) AS visits, max(visited_at) AS last_seen FROM platform_visits GROUP BY org_id, ai_domain) d
    FULL JOIN ai_tools t ON t.org_id = d.org_id AND t.domain = d.ai_domain"""


@query("j_inventory_full", INVENTORY_SQL)
def j_inventory_full(t):
    return R.inventory(t.platform_visits, t.ai_tools)


@query(
    "j_report_inventory",
    """SELECT d.org_id, d.ai_domain AS domain, users, visits, last_seen, coalesce(t.status, 'discovered') AS status, coalesce(t.risk_level, 'limited') AS risk_level, coalesce(t.notes, '') AS notes FROM
       (SELECT org_id, ai_domain, count(DISTINCT user_id) AS users, count(*) AS visits, max(visited_at) AS last_seen FROM platform_visits
        WHERE visited_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY org_id, ai_domain) d
       LEFT JOIN ai_tools t ON t.org_id = d.org_id AND t.domain = d.ai_domain""",
)
def j_report_inventory(t):
    return R.report_inventory(t.platform_visits, t.ai_tools, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


ROLLUP_SQL = """SELECT o.id, o.domain, o.name, o.plan, o.trial_ends_at, o.paddle_customer_id IS NOT NULL AS has_billing, o.created_at,
    coalesce(u.n, 0) AS members, coalesce(e.n, 0) AS events, e.last_at AS last_event_at FROM orgs o
    LEFT JOIN (SELECT org_id, count(*) AS n FROM users GROUP BY org_id) u ON u.org_id = o.id
    LEFT JOIN (SELECT org_id, count(*) AS n, max(timestamp) AS last_at FROM policy_events GROUP BY org_id) e ON e.org_id = o.id"""


@query(
    "j_org_rollup",
    """SELECT o.id, o.domain, count(DISTINCT u.id) AS members, count(DISTINCT e.id) AS events, max(e.timestamp) AS last_event_at
       FROM orgs o LEFT JOIN users u ON u.org_id = o.id LEFT JOIN policy_events e ON e.org_id = o.id GROUP BY o.id, o.domain""",
)
def j_org_rollup(t):
    """Both sides are counted before joining: same result as the fan-out, without the fan-out."""
    return R.org_rollup(t.orgs, t.users, t.policy_events).select("id", "domain", "members", "events", "last_event_at")


@query("org_stats", ROLLUP_SQL)
def org_stats(t):
    return R.org_rollup(t.orgs, t.users, t.policy_events)


@query(
    "j_project_keys",
    """SELECT p.id, p.name, count(DISTINCT k.id) AS key_count, count(DISTINCT CASE WHEN k.revoked_at IS NULL THEN k.id END) AS active_key_count,
       CAST(coalesce(sum(k.calls_total), 0) AS BIGINT) AS total_calls FROM dev_projects p LEFT JOIN api_keys k ON k.project_id = p.id GROUP BY p.id, p.name""",
)
def j_project_keys(t):
    return R.project_usage(t.dev_projects, t.api_keys).select("id", "name", "key_count", "active_key_count", "total_calls")


@query(
    "j_org_match",
    """SELECT b.id, CASE WHEN o.id IS NOT NULL THEN o.id ELSE a.org_id END AS matched_org FROM (SELECT id, customer_id, 'U' || (id % 150) || '@nation' || (id % 25) || '.example' AS email FROM billing_events) b
       LEFT JOIN (SELECT paddle_customer_id, min(id) AS id FROM orgs WHERE paddle_customer_id IS NOT NULL GROUP BY 1) o ON o.paddle_customer_id = b.customer_id
       LEFT JOIN (SELECT email, min(org_id) AS org_id FROM users WHERE role = 'admin' AND email IS NOT NULL GROUP BY email) a ON a.email = lower(b.email)""",
)
def j_org_match(t):
    """Billing event to tenant: by customer id, else by the lower-cased e-mail of an admin."""
    email = F.concat(F.lit("U"), (F.col("id") % 150).cast("string"), F.lit("@nation"), (F.col("id") % 25).cast("string"), F.lit(".example"))
    events = t.billing_events.select("id", "customer_id", F.lower(email).alias("email"))
    return R.match_org(events, t.orgs, t.users).select("id", F.col("org_id").alias("matched_org"))


@query(
    "j_missing_users",
    """SELECT DISTINCT c_nationkey AS org_id, 'h' || e.user_id AS hashed_id, 'employee' AS role FROM ev e JOIN customer ON c_custkey = e.user_id
       WHERE NOT EXISTS (SELECT 1 FROM known_users u WHERE u.org_id = c_nationkey AND u.id = e.user_id)""",
)
def j_missing_users(t):
    """Identities seen in visits and events that have no user row become employees. The identities
    are made distinct (map-side combined) before the anti join."""
    seen = t.ev.join(t.customer.select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("org_id"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("hashed_id")
    )
    known = t.known_users.select("org_id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("hashed_id"))
    return R.missing_users(seen, known)


@query("j_sessions_valid", f"SELECT u.id, u.org_id FROM users u WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.user_id = u.id AND s.expires_at > TIMESTAMP '{AS_OF}')")
def j_sessions_valid(t):
    live = t.sessions.filter(F.col("expires_at") > L.at(AS_OF)).select(F.col("user_id").alias("id"))
    return t.users.select("id", "org_id").join(live, "id", "left_semi")


@query(
    "j_cascade",
    """SELECT 'users' AS child, id FROM users WHERE org_id NOT IN (SELECT id FROM orgs WHERE plan = 'cancelled')
       UNION ALL SELECT 'events', id FROM policy_events WHERE org_id NOT IN (SELECT id FROM orgs WHERE plan = 'cancelled')
       UNION ALL SELECT 'keys', id FROM api_keys WHERE project_id NOT IN (SELECT id FROM dev_projects WHERE org_id IN (SELECT id FROM orgs WHERE plan = 'cancelled'))""",
)
def j_cascade(t):
    """Deleting tenants drops their users, events, projects and those projects' keys."""
    gone = t.orgs.filter("plan = 'cancelled'").select(F.col("id").alias("org_id"))
    gone_projects = t.dev_projects.join(gone, "org_id", "left_semi").select(F.col("id").alias("project_id"))
    users = R.drop_children(t.users, gone, "org_id").select(F.lit("users").alias("child"), "id")
    events = R.drop_children(t.policy_events, gone, "org_id").select(F.lit("events").alias("child"), "id")
    keys = R.drop_children(t.api_keys, gone_projects, "project_id").select(F.lit("keys").alias("child"), "id")
    return users.unionByName(events).unionByName(keys)


@query(
    "u_tools_without_visits",
    "SELECT org_id, domain, status, risk_level FROM ai_tools t WHERE NOT EXISTS (SELECT 1 FROM platform_visits v WHERE v.org_id = t.org_id AND v.ai_domain = t.domain)",
)
def u_tools_without_visits(t):
    # one row a pair: an anti join's right side is not split, however hot a pair is
    seen = t.platform_visits.select("org_id", F.col("ai_domain").alias("domain")).distinct()
    return t.ai_tools.join(seen, ["org_id", "domain"], "left_anti").select("org_id", "domain", "status", "risk_level")
