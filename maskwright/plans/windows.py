"""Running computations: lesson levels, counters, quotas, rate windows, literacy over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import limits, running
from maskwright.operators import logs as L
from maskwright.plans.aggregates import LABEL_SQL, TYPED
from maskwright.plans.registry import query


@query(
    "lesson_level",
    "SELECT id, user_id, p AS primary_type, n, CASE WHEN n <= 1 THEN 0 WHEN n <= 3 THEN 1 ELSE 2 END AS level FROM (SELECT *, row_number() OVER (PARTITION BY user_id, p ORDER BY timestamp, id) AS n FROM typed)",
    TYPED,
)
def lesson_level(t):
    return running.lesson_level(t.policy_events).select("id", "user_id", "primary_type", "n", "level")


@query(
    "running_counters",
    """SELECT id, user_id, CAST(sum(CASE WHEN action = 'BLOCK' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block_count, CAST(sum(CASE WHEN action = 'WARN' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS warn_count
       FROM policy_events WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)""",
)
def running_counters(t):
    return running.running_counters(t.policy_events).select("id", "user_id", "block_count", "warn_count")


_QUOTA = """SELECT l.id, l.key_id, CASE WHEN k.id IS NOT NULL THEN n END AS n, CASE WHEN k.id IS NULL THEN 401 WHEN coalesce(k.monthly_limit, 0) > 0 AND n > k.monthly_limit THEN 429 ELSE 200 END AS status FROM
   (SELECT id, key_id, row_number() OVER (PARTITION BY key_id{month} ORDER BY timestamp, id) AS n FROM proxy_logs) l LEFT JOIN api_keys k ON k.id = l.key_id"""


def _calls(t):
    return t.proxy_logs.select("id", "key_id", "timestamp"), t.api_keys.select(F.col("id").alias("key_id"), "monthly_limit")


@query("monthly_quota", _QUOTA.format(month=", date_trunc('month', timestamp)"))
def monthly_quota(t):
    return limits.keyed_quota(*_calls(t)).select("id", "key_id", "n", "status")


@query("monthly_quota_no_reset", _QUOTA.format(month=""))
def monthly_quota_no_reset(t):
    """The counter is never reset at a month's end."""
    return limits.keyed_quota(*_calls(t), reset=False).select("id", "key_id", "n", "status")


@query(
    "latest_per_key",
    "SELECT org_id, domain, id, status, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY org_id, domain ORDER BY ts DESC, id DESC) AS r FROM tool_reviews) WHERE r = 1",
)
def latest_per_key(t):
    return L.latest_per(t.tool_reviews, ["org_id", "domain"], ["ts", "id"], ["id", "status", "risk_level"])


@query(
    "literacy_running",
    f"""SELECT *, {LABEL_SQL} AS label FROM (SELECT id, user_id, least(100, least(sum(f) OVER w, 6) * 10 + least(count(*) OVER w, 8) * 5)::BIGINT AS score FROM
        (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, p ORDER BY timestamp, id) = 1 THEN 1 ELSE 0 END AS f FROM typed)
        WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING))""",
    TYPED,
)
def literacy_running(t):
    return running.literacy_running(t.policy_events).select("id", "user_id", "score", "label")


_CHAIN = """WITH RECURSIVE starts(client, s) AS (
     SELECT client, min(at_s) FROM reqs GROUP BY client
     UNION ALL SELECT client, nxt FROM (SELECT st.client, (SELECT min(r.at_s) FROM reqs r WHERE r.client = st.client AND r.at_s >= st.s + 60) AS nxt FROM starts st) WHERE nxt IS NOT NULL)
   SELECT id, client, window_start, n, n > 10 AS limited, greatest(10 - n, 0) AS remaining FROM (SELECT r.id, r.client, x.s AS window_start, row_number() OVER (PARTITION BY r.client, x.s ORDER BY r.at_s, r.id) AS n
     FROM reqs r ASOF JOIN starts x ON x.client = r.client AND r.at_s >= x.s)"""


@query("rate_limit", _CHAIN, {"reqs": "SELECT id, client, at_s FROM requests"})
def rate_limit(t):
    return limits.rate_limit(t.requests.withColumnRenamed("at_s", "at")).select("id", "client", "window_start", "n", "limited", "remaining")


@query(
    "rate_limit_by_user",
    _CHAIN.replace("60", "3600").replace("10", "5"),
    {"reqs": "SELECT event_id AS id, user_id AS client, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s FROM events"},
)
def rate_limit_by_user(t):
    """The same limiter per user over real event times: 5 per hour."""
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    req = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), at.alias("at"))
    return limits.rate_limit(req, limit=5, window=3600, slot=21600).select("id", "client", "window_start", "n", "limited", "remaining")
