"""Views of stored rows, ingest routing, and table mutations as batch rewrites.

A mutation takes the table and a change set and returns the new table; changes are reduced to one
row per key before they are joined, so the join never fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import policy
from maskwright.operators import logs as L

# Defaults of ingested events, platform flags, plans, seats per price.
DEFAULT_RULE_ID = "detection"
DEFAULT_VERSION = "1.1.0"
PLATFORMS = "chatgpt claude gemini perplexity copilot mistral slack gmail notion linear outlook other".split()
PLANS = ["trial", "active", "cancelled", "super"]
DEFAULT_SEATS = 10
SEATS = {"price_team": 25, "price_business": 100}
SEATS_OTHER = 25
TRIAL_DAYS = 14
TOOL_STATUSES = ["approved", "flagged", "discovered"]
DEFAULT_RISK = "limited"


def event_view(events: DataFrame) -> DataFrame:
    return events.select(
        "id",
        "timestamp",
        F.col("user_id").alias("userId"),
        F.col("ai_domain").alias("aiDomain"),
        F.col("rule_id").alias("ruleId"),
        L.types_array(F.col("data_types")).alias("dataTypes"),
        "action",
        F.col("extension_version").alias("extensionVersion"),
        F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"),
    )


def wide_config(config: DataFrame) -> DataFrame:
    """Configuration with one ``action_*`` column per type, taken from the preset."""
    rules = policy.preset_rules(F.col("preset"))
    return config.withColumn("_r", rules).withColumns(
        {f"action_{t.lower()}": F.element_at("_r", F.lit(t)) for t in policy.CONFIG_TYPES}
    ).drop("_r")


def config_view(config: DataFrame) -> DataFrame:
    rules = F.create_map(*[x for t in policy.CONFIG_TYPES for x in (F.lit(t), F.col(f"action_{t.lower()}"))])
    flags = F.create_map(*[x for p in PLATFORMS for x in (F.lit(p), F.col(f"ai_{p}"))])
    return config.select(
        "org_id",
        "preset",
        rules.alias("rules"),
        flags.alias("platforms"),
        F.from_json("custom_terms", "array<string>").alias("terms"),
        "approved_ai_url",
        "file_upload_warning",
    )


def route_posts(posts: DataFrame) -> DataFrame:
    """Where each posted record goes (visit, event, quarantine), why not, and its defaults."""
    visit = F.coalesce(F.col("type") == "platform_visit", F.lit(False))
    no_domain = F.coalesce("ai_domain", F.lit("")) == ""
    no_action = F.coalesce("action", F.lit("")) == ""
    reason = (
        F.when(visit & no_domain, "DOMAIN_REQUIRED")
        .when(visit, F.lit(None).cast("string"))
        .when(no_domain | no_action, "DOMAIN_AND_ACTION_REQUIRED")
        .when(~F.col("action").isin(*policy.EVENT_ACTIONS), "ILLEGAL_ACTION")
    )
    return (
        posts.withColumn("reason", reason)
        .withColumn("route", F.when(F.col("reason").isNotNull(), "quarantine").when(visit, "visit").otherwise("event"))
        .withColumn("rule_id", F.coalesce("rule_id", "source", F.lit(DEFAULT_RULE_ID)))
        .withColumn("data_types", F.when(F.json_array_length("data_types").isNotNull(), F.col("data_types")).otherwise("[]"))
        .withColumn("extension_version", F.coalesce(F.nullif("extension_version", F.lit("")), F.lit(DEFAULT_VERSION)))
    )


def settle_acks(events: DataFrame, acks: DataFrame, at: str) -> DataFrame:
    """Every event as it stands after the acks, and every rejected ack with its ``reason``.

    An ack counts only for an event of the acting tenant; of several, the last by time and user. What an
    event already holds stays where no ack meets it. A rejected ack is a row of its id, the acting tenant
    (as ``org_id``) and the reason; one without a tenant is FORBIDDEN. Events and acks, of these one row for
    each id and tenant, meet in one shuffle by id; neither is read twice.
    """
    last = F.max_by(F.struct("acknowledged_by", "note"), F.struct("ts", "acknowledged_by")).alias("_ack")
    asked = acks.groupBy("id", F.col("acting_org_id").alias("org_id")).agg(last, F.count(F.lit(1)).alias("_times"))
    rows = events.withColumn("_event", F.lit(True)).unionByName(asked.withColumn("_event", F.lit(False)), allowMissingColumns=True)
    same_id, same_owner = Window.partitionBy("id"), Window.partitionBy("id", "org_id")
    named = F.col("id").isNotNull()
    owned = named & F.col("org_id").isNotNull()
    met = rows.withColumns(
        {
            "_known": named & F.max("_event").over(same_id),
            "_mine": owned & F.max("_event").over(same_owner),
            "_ack": F.when(owned, F.max("_ack").over(same_owner)),
        }
    ).filter("_event OR NOT _mine")
    event, hit = F.col("_event"), F.col("_event") & F.col("_ack").isNotNull()
    return (
        met.withColumn("reason", F.when(~event, F.when(F.col("_known"), "FORBIDDEN").otherwise("NOT_FOUND")))
        .withColumn("acknowledged", F.when(event, F.coalesce("acknowledged", F.lit(False)) | hit))
        .withColumn("acknowledged_by", F.when(hit, F.col("_ack.acknowledged_by")).otherwise(F.col("acknowledged_by")))
        .withColumn("acknowledged_at", F.when(hit, L.at(at)).otherwise(F.col("acknowledged_at")))
        .withColumn("acknowledged_note", F.when(hit, F.col("_ack.note")).otherwise(F.col("acknowledged_note")))
        .select(*events.columns, "reason", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)).cast("int"))))
        .drop("col")
    )


def ack_events(events: DataFrame, acks: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(new events, rejected acks): the two parts of ``settle_acks``."""
    settled = settle_acks(events, acks, at)
    rejected = settled.filter("reason IS NOT NULL").select("id", F.col("org_id").alias("acting_org_id"), "reason")
    return settled.filter("reason IS NULL").select(*events.columns), rejected


def upsert_tools(tools: DataFrame, reviews: DataFrame) -> DataFrame:
    """Last legal review per (tenant, domain) over the existing rows."""
    legal = reviews.filter(F.col("status").isin(*TOOL_STATUSES))
    last = L.latest_per(legal, ["org_id", "domain"], ["ts", "id"], ["status", "risk_level", "ts", "notes", "reviewed_by"]).select(
        "org_id",
        "domain",
        F.col("status").alias("_s"),
        F.coalesce("risk_level", F.lit(DEFAULT_RISK)).alias("_r"),
        F.col("ts").alias("_at"),
        F.nullif("notes", F.lit("")).alias("_notes"),
        F.col("reviewed_by").alias("_by"),
    )
    j = tools.join(last, ["org_id", "domain"], "full")
    new = F.col("_at").isNotNull()
    kept = lambda mine, theirs: F.when(new, F.col(mine)).otherwise(F.col(theirs)).alias(theirs)
    return j.select(
        "org_id",
        "domain",
        F.coalesce("_s", "status").alias("status"),
        F.coalesce("_r", "risk_level").alias("risk_level"),
        kept("_notes", "notes"),
        kept("_by", "reviewed_by"),
        kept("_at", "reviewed_at"),
        F.coalesce("first_seen_at", "_at").alias("first_seen_at"),
    )


def patch_fields(table: DataFrame, patches: DataFrame, key: str, fields: dict[str, list[str] | None]) -> DataFrame:
    """Overlay supplied, legal values; a NULL or illegal value leaves the field as it is."""
    p = patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = table.join(p, key, "left")
    for f, legal in fields.items():
        new = F.col(f"_{f}") if legal is None else policy.legal_action(F.col(f"_{f}"), legal)
        j = j.withColumn(f, F.coalesce(new, F.col(f)))
    return j.select(*table.columns)


def patch_project(projects: DataFrame, patches: DataFrame) -> DataFrame:
    """``present`` lists the fields a patch carries: a present NULL clears the webhook but keeps the
    name; an absent field keeps its value."""
    p = patches.select("id", "present", F.col("name").alias("_name"), F.col("webhook_url").alias("_url"))
    j = projects.join(p, "id", "left")
    has = lambda f: F.coalesce(F.array_contains("present", f), F.lit(False))
    return (
        j.withColumn("name", F.when(has("name"), F.coalesce("_name", "name")).otherwise(F.col("name")))
        .withColumn("webhook_url", F.when(has("webhook_url"), F.col("_url")).otherwise(F.col("webhook_url")))
        .select(*projects.columns)
    )


def revoke_keys(keys: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Set once; a second revocation changes nothing."""
    j = keys.join(ids.select("id", F.lit(True).alias("_hit")).dropDuplicates(["id"]), "id", "left")
    now = F.when(F.col("_hit"), L.at(at))
    return j.withColumn("revoked_at", F.coalesce("revoked_at", now)).drop("_hit").select(*keys.columns)


def billing_state(events: DataFrame) -> DataFrame:
    """Fold of a subscription's events, as two rounds of mergeable aggregates.

    Only events from the first activation on count. Plan follows the last effective event (an
    update without a price is ignored), seats the last event that set them, the customer the last
    activation, else the first later one that names a customer.
    """
    start = F.col("event_type").isin("subscription.created", "subscription.activated")
    stop = F.col("event_type").isin("subscription.cancelled", "subscription.paused")
    change = (F.col("event_type") == "subscription.updated") & F.col("price_id").isNotNull()
    when = F.struct("ts", "id")
    seats = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in SEATS.items() for x in kv]), F.col("price_id")), F.lit(SEATS_OTHER)
    )
    key = "subscription_id"
    slim = events.filter(start | stop | change).withColumns(
        {"_when": when, "_start": start, "_stop": stop, "_seats": seats}
    )
    acts = slim.filter("_start").groupBy(key).agg(
        F.min("_when").alias("first_at"),
        F.max("_when").alias("last_at"),
        F.max_by("customer_id", "_when").alias("_own"),
        F.max_by("org_id", "_when").alias("org_id"),
    )
    live = slim.drop("org_id").join(acts, key).filter("_when >= first_at")
    later = ~F.col("_start") & ~F.col("_stop") & (F.col("_when") > F.col("last_at")) & F.col("customer_id").isNotNull()
    fold = live.groupBy(key).agg(
        F.max_by(F.when(F.col("_stop"), "cancelled").otherwise("active"), "_when").alias("plan"),
        F.max_by(F.when(~F.col("_stop"), F.col("_seats")), F.when(~F.col("_stop"), F.col("_when"))).alias("seats"),
        F.min_by(F.when(later, F.col("customer_id")), F.when(later, F.col("_when"))).alias("_later"),
        F.max("org_id").alias("org_id"),
        F.max("_own").alias("_own"),
    )
    return fold.select(key, "org_id", "plan", F.col("seats").cast("long").alias("seats"), F.coalesce("_own", "_later").alias("customer_id"))
