"""Adapter views: the test tables seen as the tenant, user, log and configuration tables.

One definition serves both engines: ``frame`` builds the Spark DataFrame with ``selectExpr``,
``cte`` the DuckDB text. Only the tokens in braces differ. Timestamps are zone-less UTC.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

_SPARK = {
    "{STR}": "STRING",
    "{TS}": "TIMESTAMP_NTZ",
    "{K}": "get_json_object(props, '$.k')",
    "{SHA}": "sha2(concat('key_live_', CAST(p_partkey AS STRING)), 256)",
}
_DUCK = {
    "{STR}": "VARCHAR",
    "{TS}": "TIMESTAMP",
    "{K}": "json_extract_string(props, '$.k')",
    "{SHA}": "sha256('key_live_' || CAST(p_partkey AS VARCHAR))",
}


@dataclass(frozen=True)
class View:
    source: str
    columns: list[str]
    where: str | None = None
    with_customer: bool = False  # join customer ON c_custkey = user_id
    plus: str | None = None  # name of a view whose rows are appended


_DOMAIN = (
    "CASE k % 7 WHEN 0 THEN 'chatgpt.com' WHEN 1 THEN 'claude.ai' WHEN 2 THEN 'gemini.google.com' "
    "WHEN 3 THEN 'perplexity.ai' WHEN 4 THEN 'copilot.microsoft.com' WHEN 5 THEN 'sub.claude.ai' ELSE 'notion.so' END"
)

VIEWS = {
    "ev": View("events", ["event_id", "ts", "user_id", "event_type", "value", "CAST({K} AS INT) AS k"]),
    "orgs": View(
        "nation",
        [
            "n_nationkey AS id",
            "lower(n_name) || '.example' AS domain",
            "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name",
            "CASE n_nationkey % 4 WHEN 0 THEN 'trial' WHEN 1 THEN 'active' WHEN 2 THEN 'cancelled' ELSE 'super' END AS plan",
            "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 5 + n_nationkey END AS seats",
            "CAST(DATE '2024-02-10' - CAST(n_nationkey AS INT) AS {TS}) AS trial_ends_at",
            "CASE WHEN n_nationkey % 4 = 1 THEN 'ctm_' || CAST(n_nationkey AS {STR}) ELSE NULL END AS paddle_customer_id",
            "CAST(DATE '2024-01-31' - CAST(2 * n_nationkey AS INT) AS {TS}) AS created_at",
        ],
    ),
    "users": View(
        "customer",
        [
            "c_custkey AS id",
            "c_nationkey AS org_id",
            "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'u' || CAST(c_custkey AS {STR}) || '@nation' || CAST(c_nationkey AS {STR}) || '.example' END AS email",
            "CASE WHEN c_custkey % 20 = 1 THEN 'admin' ELSE 'employee' END AS role",
            "c_custkey % 3 <> 0 AS extension_installed",
            "CASE WHEN c_custkey % 4 = 0 THEN 'invited' ELSE 'active' END AS invite_status",
            "CASE WHEN c_custkey % 3 = 1 THEN CAST(DATE '2024-01-31' - CAST(c_custkey % 40 AS INT) AS {TS}) ELSE NULL END AS last_seen_at",
            "CASE WHEN c_custkey % 2 = 0 THEN CAST(DATE '2024-01-15' AS {TS}) ELSE NULL END AS policy_acknowledged_at",
            "CAST(DATE '2023-12-01' + CAST(c_custkey % 50 AS INT) AS {TS}) AS created_at",
        ],
    ),
    "known_users": View("users", ["id", "org_id"], "id % 10 <> 9"),  # some identities have no user row yet
    "policy_events": View(
        "ev",
        [
            "event_id AS id",
            "c_nationkey AS org_id",
            "user_id",
            "ts AS timestamp",
            f"{_DOMAIN} AS ai_domain",
            "CASE WHEN k % 2 = 0 THEN 'paste' ELSE 'submit' END AS rule_id",
            """CASE k % 6 WHEN 0 THEN '["EMAIL"]' WHEN 1 THEN '["EMAIL","PHONE"]' WHEN 2 THEN '["IBAN"]' WHEN 3 THEN '["CREDIT_CARD","PASSWORD"]' WHEN 4 THEN 'EMAIL, ADDRESS' ELSE '[]' END AS data_types""",
            "CASE WHEN event_type = 'error' THEN 'BLOCK' ELSE 'WARN' END AS action",
            "'1.' || CAST(k % 3 AS {STR}) || '.0' AS extension_version",
            "value > 10 AS acknowledged",
            "CASE WHEN value > 10 THEN user_id + 1 ELSE NULL END AS acknowledged_by",
            "CASE WHEN value > 10 THEN ts ELSE NULL END AS acknowledged_at",
            "CASE WHEN value > 10 AND k % 3 = 0 THEN 'seen, \"ok\"' ELSE NULL END AS acknowledged_note",
        ],
        "event_type IN ('error','click')",
        True,
    ),
    "platform_visits": View(
        "ev",
        ["event_id AS id", "c_nationkey AS org_id", "user_id", f"{_DOMAIN} AS ai_domain", "ts AS visited_at"],
        "event_type = 'view'",
        True,
    ),
    "proxy_logs": View(
        "ev",
        [
            "event_id AS id",
            "c_nationkey AS org_id",
            "user_id % 12 AS project_id",
            "user_id AS key_id",
            "CASE k % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'direct' END AS provider",
            "CASE WHEN k % 3 = 2 THEN NULL ELSE 'model-' || CAST(k % 4 AS {STR}) END AS model",
            """CASE event_type WHEN 'error' THEN '["IBAN"]' WHEN 'purchase' THEN '["EMAIL"]' ELSE '[]' END AS detected_types""",
            "CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'purchase' THEN 'WARN' ELSE 'ALLOW' END AS action",
            "3 * k AS prompt_tokens",
            "CASE WHEN k % 3 = 2 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS latency_ms",
            "ts AS timestamp",
        ],
        None,
        True,
    ),
    "dev_projects": View(
        "supplier",
        [
            "s_suppkey AS id",
            "s_nationkey AS org_id",
            "s_name AS name",
            """CASE WHEN s_suppkey % 2 = 0 THEN '{"EMAIL":"BLOCK"}' ELSE '{}' END AS rules""",
            """CASE WHEN s_suppkey % 3 = 0 THEN '["widget","Project X"]' ELSE '[]' END AS custom_terms""",
            "CASE WHEN s_suppkey % 2 = 1 THEN 'https://hook.example/' || CAST(s_suppkey AS {STR}) ELSE NULL END AS webhook_url",
            "CAST(DATE '2024-01-01' + CAST(s_suppkey % 20 AS INT) AS {TS}) AS created_at",
        ],
    ),
    "api_keys": View(
        "part",
        [
            "p_partkey AS id",
            "p_partkey % 12 AS project_id",
            "'key_live_' || CAST(p_partkey AS {STR}) AS raw_key",
            "{SHA} AS key_hash",
            "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS monthly_limit",
            "p_size AS calls_total",
            "CASE WHEN p_partkey % 7 = 0 THEN CAST(DATE '2024-01-20' AS {TS}) ELSE NULL END AS revoked_at",
        ],
        "p_partkey % 11 <> 10",  # some calls come with an unknown key
    ),
    "ai_tools_unused": View(
        "nation",
        [
            "n_nationkey AS org_id",
            "'unused.example' AS domain",
            "'approved' AS status",
            "'limited' AS risk_level",
            "CAST(NULL AS {STR}) AS notes",
            "CAST(NULL AS BIGINT) AS reviewed_by",
            "CAST(NULL AS {TS}) AS reviewed_at",
            "CAST(DATE '2023-12-15' AS {TS}) AS first_seen_at",
        ],
        "n_nationkey % 2 = 0",
    ),
    "ai_tools": View(
        "nation",
        [
            "n_nationkey AS org_id",
            "'claude.ai' AS domain",
            "CASE n_nationkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'flagged' ELSE 'discovered' END AS status",
            "CASE n_nationkey % 2 WHEN 0 THEN 'minimal' ELSE 'high' END AS risk_level",
            "CASE WHEN n_nationkey % 4 = 0 THEN 'note, \"q\"' ELSE NULL END AS notes",
            "CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 100 ELSE NULL END AS reviewed_by",
            "CASE WHEN n_nationkey % 4 = 0 THEN CAST(DATE '2024-01-02' AS {TS}) ELSE NULL END AS reviewed_at",
            "CAST(DATE '2023-12-01' + CAST(n_nationkey AS INT) AS {TS}) AS first_seen_at",
        ],
        plus="ai_tools_unused",
    ),
    "org_config": View(
        "nation",
        [
            "n_nationkey AS org_id",
            "CASE n_nationkey % 5 WHEN 0 THEN 'personal' WHEN 1 THEN 'finance' WHEN 2 THEN 'health' WHEN 3 THEN 'workplace' ELSE 'developer' END AS preset",
            "n_nationkey % 2 = 0 AS ai_chatgpt",
            "n_nationkey % 3 = 0 AS ai_claude",
            "n_nationkey % 4 = 0 AS ai_gemini",
            "n_nationkey % 5 = 0 AS ai_perplexity",
            "n_nationkey % 6 = 0 AS ai_copilot",
            "n_nationkey % 7 = 0 AS ai_mistral",
            "n_nationkey % 8 = 0 AS ai_slack",
            "n_nationkey % 9 = 0 AS ai_gmail",
            "n_nationkey % 10 = 0 AS ai_notion",
            "n_nationkey % 11 = 0 AS ai_linear",
            "n_nationkey % 12 = 0 AS ai_outlook",
            "n_nationkey % 13 = 0 AS ai_other",
            "CASE WHEN n_nationkey % 2 = 0 THEN 'https://ai.example/' || CAST(n_nationkey AS {STR}) ELSE NULL END AS approved_ai_url",
            "n_nationkey % 3 = 0 AS file_upload_warning",
            """CASE n_nationkey % 3 WHEN 0 THEN '["Project X"," ",""]' WHEN 1 THEN '["the"]' ELSE '[]' END AS custom_terms""",
        ],
        "n_nationkey % 8 <> 7",  # some tenants have no configuration
    ),
    "webhook_deliveries": View(
        "ev",
        [
            "event_id AS id",
            "user_id % 12 AS project_id",
            "CASE WHEN event_type = 'error' THEN 'scan.blocked' ELSE 'scan.warned' END AS event_type",
            "CASE WHEN value > 5 THEN 200 ELSE NULL END AS response_status",
            "CASE WHEN value > 5 THEN ts ELSE NULL END AS delivered_at",
            "CASE WHEN value > 5 THEN NULL ELSE ts END AS failed_at",
            "ts AS created_at",
        ],
        "event_type IN ('error','purchase')",
    ),
    "sessions": View(
        "ev",
        ["event_id AS id", "user_id", "CAST(CAST(ts AS DATE) + 7 AS {TS}) AS expires_at"],
        "event_type = 'signup'",
    ),
    "billing_events": View(
        "ev",
        [
            "event_id AS id",
            "ts",
            "k % 25 AS org_id",
            "'sub_' || CAST(k % 25 AS {STR}) AS subscription_id",
            "CASE WHEN k % 4 = 0 THEN NULL ELSE 'ctm_' || CAST(k % 25 AS {STR}) END AS customer_id",
            "CASE k % 3 WHEN 0 THEN 'price_team' WHEN 1 THEN 'price_business' ELSE NULL END AS price_id",
            "CASE event_type WHEN 'signup' THEN 'subscription.created' WHEN 'purchase' THEN 'subscription.updated' ELSE 'subscription.cancelled' END AS event_type",
        ],
        "event_type IN ('signup','purchase') OR (event_type = 'error' AND k < 10)",
    ),
    "tool_reviews": View(
        "ev",
        [
            "event_id AS id",
            "ts",
            "k % 25 AS org_id",
            "CASE WHEN k % 2 = 0 THEN 'claude.ai' ELSE 'notion.so' END AS domain",
            "CASE k % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'flagged' WHEN 2 THEN 'discovered' ELSE 'bogus' END AS status",
            "CASE WHEN k % 3 = 0 THEN NULL ELSE 'high' END AS risk_level",
            "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'review ' || CAST(k AS {STR}) END AS notes",
            "user_id AS reviewed_by",
        ],
        "event_type = 'signup'",
    ),
    "event_acks_again": View(
        "ev",
        [
            "event_id AS id",
            "c_nationkey AS acting_org_id",
            "user_id + 7 AS acknowledged_by",
            "'again' AS note",
            "CASE WHEN k % 4 = 0 THEN ts + INTERVAL '1' DAY ELSE ts - INTERVAL '1' DAY END AS ts",
        ],
        "k < 20",
        True,
    ),
    "event_acks": View(
        "ev",
        [
            "event_id AS id",
            "c_nationkey + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS acting_org_id",
            "user_id AS acknowledged_by",
            "CASE WHEN k % 2 = 0 THEN 'ok' ELSE NULL END AS note",
            "ts",
        ],
        "k < 40",
        True,
        plus="event_acks_again",
    ),
    "requests": View("ev", ["event_id AS id", "event_id % 5 AS client", "event_id AS at_s"]),
    "chat_bodies": View(
        "users",
        [
            "id",
            """CASE id % 5 WHEN 0 THEN '{"model":"m","messages":[{"role":"user","content":"write to ' || coalesce(email,'nobody') || '"}]}'
  WHEN 1 THEN '{"messages":[{"role":"user","content":[{"type":"text","text":"mail ' || coalesce(email,'nobody') || '"},{"type":"image_url"}]}]}'
  WHEN 2 THEN '{"prompt":["a","' || coalesce(email,'nobody') || '"]}' WHEN 3 THEN '{"input":"' || coalesce(email,'nobody') || '"}'
  ELSE '{"system":"be brief","messages":[{"role":"user","content":"' || coalesce(email,'nobody') || '"}]}' END AS body""",
        ],
    ),
    "raw_posts": View(
        "ev",
        [
            "event_id AS id",
            "ts",
            "user_id",
            "CASE WHEN event_type = 'view' THEN 'platform_visit' ELSE NULL END AS type",
            "CASE WHEN k % 20 = 0 THEN NULL ELSE 'chatgpt.com' END AS ai_domain",
            "CASE k % 5 WHEN 0 THEN 'WARN' WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'ALLOW' WHEN 3 THEN NULL ELSE 'BLOCK' END AS action",
            "CASE WHEN k % 3 = 0 THEN NULL ELSE 'R1' END AS rule_id",
            "CASE WHEN k % 2 = 0 THEN 'paste' ELSE NULL END AS source",
            """CASE k % 4 WHEN 0 THEN '["EMAIL"]' WHEN 1 THEN 'IBAN' WHEN 2 THEN NULL ELSE '["IBAN","PHONE"]' END AS data_types""",
            "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '2.' || CAST(k AS {STR}) || '.0' ELSE '' END AS extension_version",
        ],
    ),
}


def _say(text: str, words: dict[str, str]) -> str:
    for token, word in words.items():
        text = text.replace(token, word)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shape(base: DataFrame, view: View, customer: DataFrame | None = None) -> DataFrame:
    """Apply a view's join, filter and projection to ``base`` (batch or stream)."""
    df = base
    if view.where:
        df = df.filter(view.where)
    if view.with_customer:
        owner = customer.select("c_custkey", "c_nationkey")
        df = df.join(owner, df.user_id == owner.c_custkey)
    return df.selectExpr(*[_say(c, _SPARK) for c in view.columns])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of an adapter view, or of a plain test table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    view = VIEWS[name]
    owner = table(spark, sf_dir, "customer") if view.with_customer else None
    df = shape(frame(spark, sf_dir, view.source), view, owner)
    return df.unionByName(frame(spark, sf_dir, view.plus)) if view.plus else df


def _select(view: View) -> str:
    join = " JOIN customer ON c_custkey = user_id" if view.with_customer else ""
    where = f" WHERE {view.where}" if view.where else ""
    own = f"SELECT {', '.join(_say(c, _DUCK) for c in view.columns)} FROM {view.source}{join}{where}"
    return f"{own} UNION ALL SELECT * FROM {view.plus}" if view.plus else own


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the CTEs that ``sql`` mentions (directly or through another view) in front of it."""
    known = {**{n: _select(v) for n, v in VIEWS.items()}, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(?<![\w.'\"]){name}(?![\w'\"])", text):
                need(known[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS ({known[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
