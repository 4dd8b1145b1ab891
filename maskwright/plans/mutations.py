"""Table mutations: table plus change set gives the new table."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import policy, validators
from maskwright.operators import members
from maskwright.operators import mutate as M
from maskwright.plans.filters import _PRESETS
from maskwright.plans.registry import query
from maskwright.sources.views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


@query(
    "ack_events",
    f"""SELECT e.id, e.org_id, e.acknowledged OR a.id IS NOT NULL AS acknowledged, CASE WHEN a.id IS NOT NULL THEN a.acknowledged_by ELSE e.acknowledged_by END AS acknowledged_by,
          CASE WHEN a.id IS NOT NULL THEN {NOW} ELSE e.acknowledged_at END AS acknowledged_at, CASE WHEN a.id IS NOT NULL THEN a.note ELSE e.acknowledged_note END AS acknowledged_note, CAST(NULL AS VARCHAR) AS reason
        FROM policy_events e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, acting_org_id ORDER BY ts DESC, acknowledged_by DESC) AS r FROM event_acks) WHERE r = 1) a ON a.id = e.id AND a.acting_org_id = e.org_id
        UNION ALL SELECT a.id, a.acting_org_id, NULL, NULL, NULL, NULL, CASE WHEN e.id IS NULL THEN 'NOT_FOUND' ELSE 'FORBIDDEN' END FROM event_acks a LEFT JOIN policy_events e ON e.id = a.id WHERE e.id IS NULL OR e.org_id <> a.acting_org_id""",
)
def ack_events(t):
    settled = M.settle_acks(t.policy_events, t.event_acks, AS_OF)
    return settled.select("id", "org_id", "acknowledged", "acknowledged_by", "acknowledged_at", "acknowledged_note", "reason")


@query(
    "upsert_tools",
    """SELECT coalesce(t.org_id, r.org_id) AS org_id, coalesce(t.domain, r.domain) AS domain, coalesce(r.status, t.status) AS status, CASE WHEN r.org_id IS NOT NULL THEN coalesce(r.risk_level, 'limited') ELSE t.risk_level END AS risk_level,
       CASE WHEN r.org_id IS NULL THEN t.notes ELSE nullif(r.notes, '') END AS notes, CASE WHEN r.org_id IS NULL THEN t.reviewed_by ELSE r.reviewed_by END AS reviewed_by,
       CASE WHEN r.org_id IS NULL THEN t.reviewed_at ELSE r.ts END AS reviewed_at, coalesce(t.first_seen_at, r.ts) AS first_seen_at FROM ai_tools t FULL JOIN
       (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, domain ORDER BY ts DESC, id DESC) AS n FROM tool_reviews WHERE status <> 'bogus') WHERE n = 1) r ON r.org_id = t.org_id AND r.domain = t.domain""",
)
def upsert_tools(t):
    return M.upsert_tools(t.ai_tools, t.tool_reviews)


_PATCH = {
    **_PRESETS,
    "wide": "SELECT oc.org_id, oc.preset, "
    + ", ".join(f"max(p.action) FILTER (WHERE p.type = '{ty}') AS action_{ty.lower()}" for ty in policy.CONFIG_TYPES)
    + " FROM org_config oc JOIN presets p ON p.preset = oc.preset GROUP BY oc.org_id, oc.preset",
    "last_patch": "SELECT org_id, max_by(action, id) FILTER (WHERE action IS NOT NULL) AS act, max_by(rule_id, id) FILTER (WHERE rule_id IS NOT NULL) AS pre FROM (SELECT *, user_id % 30 AS org_id FROM raw_posts) GROUP BY org_id",
}


@query(
    "patch_config",
    """SELECT w.org_id, coalesce(l.pre, w.preset) AS preset, CASE WHEN l.act IN ('ALLOW','WARN','BLOCK') THEN l.act ELSE w.action_email END AS action_email, w.action_phone FROM wide w LEFT JOIN last_patch l ON l.org_id = w.org_id""",
    _PATCH,
)
def patch_config(t):
    """Last supplied value per tenant and field, laid over the stored configuration."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id")))
    changes = t.raw_posts.withColumn("org_id", F.col("user_id") % 30).groupBy("org_id").agg(
        last("action").alias("action_email"), last("rule_id").alias("preset")
    )
    fields = {"action_email": policy.ACTIONS, "preset": None}
    return M.patch_fields(M.wide_config(t.org_config), changes, "org_id", fields).select("org_id", "preset", "action_email", "action_phone")


_PP = {
    "patches": """SELECT id, CASE id % 4 WHEN 0 THEN ['name'] WHEN 1 THEN ['name','webhook_url'] WHEN 2 THEN ['webhook_url'] ELSE [] END AS present,
     CASE WHEN id % 3 = 0 THEN NULL ELSE 'new ' || id END AS name, CASE WHEN id % 5 = 0 THEN 'https://n.example' END AS webhook_url FROM dev_projects WHERE id % 7 <> 0"""
}


@query(
    "patch_project",
    """SELECT p.id, CASE WHEN list_contains(q.present, 'name') THEN coalesce(q.name, p.name) ELSE p.name END AS name,
       CASE WHEN list_contains(q.present, 'webhook_url') THEN q.webhook_url ELSE p.webhook_url END AS webhook_url FROM dev_projects p LEFT JOIN patches q ON q.id = p.id""",
    _PP,
)
def patch_project(t):
    patches = t.dev_projects.filter("id % 7 <> 0").selectExpr(
        "id",
        "CASE id % 4 WHEN 0 THEN array('name') WHEN 1 THEN array('name','webhook_url') WHEN 2 THEN array('webhook_url') ELSE CAST(array() AS ARRAY<STRING>) END AS present",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE 'new ' || id END AS name",
        "CASE WHEN id % 5 = 0 THEN 'https://n.example' END AS webhook_url",
    )
    return M.patch_project(t.dev_projects, patches).select("id", "name", "webhook_url")


@query(
    "revoke_keys",
    f"SELECT k.id, CASE WHEN k.revoked_at IS NOT NULL THEN k.revoked_at WHEN k.id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) THEN {NOW} END AS revoked_at FROM api_keys k",
)
def revoke_keys(t):
    ids = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    return M.revoke_keys(t.api_keys, ids, AS_OF).select("id", "revoked_at")


_BILL = """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS n, event_type = 'subscription.created' AS st, event_type = 'subscription.cancelled' AS sp,
      CASE price_id WHEN 'price_team' THEN 25 WHEN 'price_business' THEN 100 ELSE 25 END AS seats FROM billing_events WHERE event_type <> 'subscription.updated' OR price_id IS NOT NULL),
   a AS (SELECT subscription_id, min(n) AS f, max(n) AS l, arg_max(org_id, n) AS org_id, (SELECT x.customer_id FROM e x WHERE x.subscription_id = e.subscription_id AND x.st ORDER BY x.n DESC LIMIT 1) AS own FROM e WHERE st GROUP BY subscription_id)
   SELECT a.subscription_id, a.org_id, (SELECT CASE WHEN x.sp THEN 'cancelled' ELSE 'active' END FROM e x WHERE x.subscription_id = a.subscription_id AND x.n >= a.f ORDER BY x.n DESC LIMIT 1) AS plan,
     (SELECT x.seats FROM e x WHERE x.subscription_id = a.subscription_id AND x.n >= a.f AND NOT x.sp ORDER BY x.n DESC LIMIT 1)::BIGINT AS seats,
     coalesce(a.own, (SELECT x.customer_id FROM e x WHERE x.subscription_id = a.subscription_id AND x.n > a.l AND NOT x.sp AND x.customer_id IS NOT NULL ORDER BY x.n LIMIT 1)) AS customer_id FROM a"""


@query("apply_billing", _BILL)
def apply_billing(t):
    return M.billing_state(t.billing_events)


@query(
    "ack_policy",
    "SELECT u.id, coalesce(e.at, u.policy_acknowledged_at) AS policy_acknowledged_at FROM users u LEFT JOIN (SELECT user_id, max(ts) AS at FROM ev WHERE event_type = 'signup' GROUP BY user_id) e ON e.user_id = u.id",
)
def ack_policy(t):
    acks = t.ev.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("at"))
    return members.ack_policy(t.users, acks).select("id", "policy_acknowledged_at")


_SETP = {
    "wanted": """SELECT domain, max_by(plan, id) AS plan FROM (SELECT event_id AS id, CASE WHEN k % 9 = 0 THEN 'nowhere.example' ELSE (SELECT lower(n_name) || '.example' FROM nation WHERE n_nationkey = k % 25) END AS domain,
      CASE k % 6 WHEN 0 THEN 'trial' WHEN 1 THEN 'active' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'super' ELSE 'gold' END AS plan FROM ev) WHERE plan <> 'gold' GROUP BY domain"""
}


@query(
    "set_plan",
    "SELECT coalesce(o.domain, w.domain) AS domain, coalesce(w.plan, o.plan) AS plan, o.id IS NULL AS unknown FROM orgs o FULL JOIN wanted w ON w.domain = o.domain",
    _SETP,
)
def set_plan(t):
    """Last legal plan wanted per domain; domains without a tenant are reported."""
    names = t.orgs.select(F.col("id").alias("_o"), "domain")
    asked = t.ev.withColumn("_o", (F.col("k") % 25).cast("long")).join(names, "_o").selectExpr(
        "event_id AS id",
        "IF(k % 9 = 0, 'nowhere.example', domain) AS domain",
        "CASE k % 6 WHEN 0 THEN 'trial' WHEN 1 THEN 'active' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'super' ELSE 'gold' END AS plan",
    )
    return members.set_plan(t.orgs, asked)


_INV = {
    "inv": "SELECT id, CASE WHEN id % 3 = 0 THEN org_id ELSE (org_id + 1) % 25 END AS org_id, coalesce(email, 'no mail') AS email FROM users",
    "org_free": "SELECT o.id AS org_id, greatest(coalesce(o.seats, 10) * 4 - coalesce(u.n, 0), 0) AS free FROM orgs o LEFT JOIN (SELECT org_id, count(*) AS n FROM users GROUP BY org_id) u ON u.org_id = o.id",
    "valid_inv": r"""SELECT i.*, EXISTS (SELECT 1 FROM users u WHERE u.org_id = i.org_id AND u.email = i.email) OR row_number() OVER (PARTITION BY i.org_id, i.email ORDER BY i.id) > 1 AS known FROM inv i WHERE regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')""",
}


@query(
    "invite_users",
    """SELECT i.id, i.org_id, CASE WHEN v.id IS NULL THEN 'INVALID_REQUEST' WHEN v.before >= f.free THEN 'SEAT_LIMIT' WHEN v.known THEN 'CONFLICT' ELSE 'INVITED' END AS outcome FROM inv i LEFT JOIN
       (SELECT *, coalesce(sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY org_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM valid_inv) v ON v.id = i.id
       JOIN org_free f ON f.org_id = i.org_id""",
    _INV,
)
def invite_users(t):
    orgs = t.orgs.withColumn("seats", F.coalesce("seats", F.lit(10)) * 4)
    asked = t.users.selectExpr("id", "IF(id % 3 = 0, org_id, (org_id + 1) % 25) AS org_id", "coalesce(email, 'no mail') AS email")
    return members.invite(asked, orgs, t.users).select("id", "org_id", "outcome")


_SIGN = {
    "signups": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey || '@nation' || c_nationkey || '.example' WHEN 1 THEN 'a' || c_custkey || '@Kenya.example'
      WHEN 2 THEN 'x' || c_custkey || '@Firm' || (c_custkey % 50) || '.example' ELSE 'no-at' END AS email FROM customer"""
}


@query(
    "new_org_defaults",
    rf"""SELECT domain, min_by(email, id) AS admin_email, min(id) AS signup_id, 'workplace' AS preset, 'trial' AS plan, {NOW} + INTERVAL 14 DAY AS trial_ends_at FROM
        (SELECT id, email, lower(split_part(email, '@', 2)) AS domain FROM signups WHERE regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')) s
        WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.email = s.email) AND NOT EXISTS (SELECT 1 FROM orgs o WHERE o.domain = s.domain) GROUP BY domain""",
    _SIGN,
)
def new_org_defaults(t):
    signups = t.customer.selectExpr(
        "c_custkey AS id",
        "CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey || '@nation' || c_nationkey || '.example' WHEN 1 THEN 'a' || c_custkey || '@Kenya.example' "
        "WHEN 2 THEN 'x' || c_custkey || '@Firm' || (c_custkey % 50) || '.example' ELSE 'no-at' END AS email",
    )
    return members.new_orgs(signups.filter(validators.column("email_format", "email")), t.orgs, t.users, AS_OF)
