"""Report building blocks. Every report runs for all tenants at once, keyed by ``org_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import logs as L
from maskwright.operators.mutate import DEFAULT_RISK, DEFAULT_SEATS

# Weights of the posture score, price of an active plan, labels, control table.
POSTURE_WEIGHTS = {"pct_trained": 0.4, "resolution_rate": 0.3, "pct_tools_reviewed": 0.3}
PRICE_PER_ACTIVE = 49
PLAN_LABELS = {"trial": "Free Trial", "active": "Active", "super": "Internal", "cancelled": "Cancelled"}
POLICY_LABELS = {
    "EMAIL": "Email addresses",
    "PHONE": "Phone numbers",
    "IBAN": "Bank account numbers (IBAN)",
    "CREDIT_CARD": "Credit and debit card numbers",
    "ADDRESS": "Physical addresses",
    "PASSWORD": "Passwords, API keys, and credentials",
    "NATIONAL_ID": "National identity numbers and passport numbers",
    "VAT": "VAT and tax identification numbers",
    "IP_ADDRESS": "Internal IP addresses",
    "DATE_OF_BIRTH": "Dates of birth",
}
TYPE_NAMES = {
    "EMAIL": "Email Address",
    "PHONE": "Phone Number",
    "IBAN": "Bank Account (IBAN)",
    "CREDIT_CARD": "Credit Card Number",
    "ADDRESS": "Physical Address",
    "PASSWORD": "Password/API Key/Secret",
}
TYPE_HINTS = {
    "EMAIL": "Remove or redact the email address before pasting.",
    "PHONE": "Remove or redact the phone number before pasting.",
    "IBAN": "Remove or redact the bank account number before pasting.",
    "CREDIT_CARD": "Never share credit card numbers with AI assistants.",
    "ADDRESS": "Consider removing or generalizing the address.",
    "PASSWORD": "Never share passwords, API keys, or secrets with AI assistants.",
}
TYPE_HINT_OTHER = "Remove sensitive information before pasting."
TYPE_PRIORITY = ["CREDIT_CARD", "IBAN", "PASSWORD", "PHONE", "EMAIL", "ADDRESS", "CUSTOM_TERM"]
# framework, control, name, implementation, evidence section (0 = outside the report)
CONTROLS = [
    ("EU AI Act", "Art. 4", "AI Literacy", "Policy acknowledgement tracking per team member", 1),
    ("EU AI Act", "Art. 10", "Data Governance", "AI tool inventory with approval status and risk rating", 3),
    ("EU AI Act", "Art. 12", "Record Keeping", "Immutable event log of all AI interactions with data types", 2),
    ("EU AI Act", "Art. 14", "Human Oversight", "Block event review workflow with acknowledgement and notes", 2),
    ("ISO 27001", "A.5.1", "Policies for Information Security", "Generated AI Use Policy document available in dashboard", 0),
    ("ISO 27001", "A.5.9", "Inventory of Assets", "Automatic discovery and classification of AI tools used", 3),
    ("ISO 27001", "A.5.10", "Acceptable Use", "Configurable allow/warn/block policy per data type", 0),
    ("ISO 27001", "A.6.3", "Awareness & Training", "Team training completion rate and policy acknowledgement", 1),
    ("ISO 27001", "A.8.16", "Monitoring Activities", "Real-time detection and logging of sensitive data in prompts", 2),
    ("ISO 27001", "A.8.22", "Filtering of Web Services", "Browser extension blocks/warns on AI platforms per policy", 2),
    ("SOC 2", "CC1.4", "Competence", "AI literacy training completion tracked per employee", 1),
    ("SOC 2", "CC6.1", "Logical Access Controls", "Role-based admin access; install code required to join org", 0),
    ("SOC 2", "CC6.3", "Access to Data", "Policy-enforced restrictions on data types sent to AI", 0),
    ("SOC 2", "CC6.7", "Data Transmission Controls", "Prevents transmission of PII to external AI services", 2),
    ("SOC 2", "CC7.2", "System Monitoring", "Event log captures all AI interactions in the audit period", 2),
]


def map_lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


# --- joins ---------------------------------------------------------------------------------


def with_user_email(events: DataFrame, users: DataFrame) -> DataFrame:
    return events.join(users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), "user_id", "left")


def with_project_name(logs: DataFrame, projects: DataFrame) -> DataFrame:
    return logs.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")


def visits_by_domain(visits: DataFrame) -> DataFrame:
    """Visits and distinct visitors per tenant and host.

    First one row per (tenant, host, user), which combines map-side and spreads a hot host over
    its users; then a plain count over those rows.
    """
    per_user = visits.groupBy("org_id", "ai_domain", "user_id").agg(
        F.count("*").alias("n"), F.max("visited_at").alias("last")
    )
    return per_user.groupBy("org_id", "ai_domain").agg(
        F.count("user_id").alias("users"), F.sum("n").alias("visits"), F.max("last").alias("last_seen")
    )


def inventory(visits: DataFrame, tools: DataFrame) -> DataFrame:
    """Everything seen or reviewed: defaults for unreviewed hosts, zeros for unvisited tools."""
    seen = visits_by_domain(visits).withColumnRenamed("ai_domain", "domain")
    both = seen.join(tools, ["org_id", "domain"], "full")
    return both.select(
        "org_id",
        "domain",
        F.coalesce("users", F.lit(0)).alias("users"),
        F.coalesce("visits", F.lit(0)).alias("visits"),
        "last_seen",
        F.coalesce("status", F.lit("discovered")).alias("status"),
        F.coalesce("risk_level", F.lit(DEFAULT_RISK)).alias("risk_level"),
        "notes",
    )


def report_inventory(visits: DataFrame, tools: DataFrame, start: str, end: str) -> DataFrame:
    window = visits.filter(F.col("visited_at").between(L.at(start), L.at(end)))
    seen = visits_by_domain(window).withColumnRenamed("ai_domain", "domain")
    return seen.join(tools, ["org_id", "domain"], "left").select(
        "org_id",
        "domain",
        "users",
        "visits",
        "last_seen",
        F.coalesce("status", F.lit("discovered")).alias("status"),
        F.coalesce("risk_level", F.lit(DEFAULT_RISK)).alias("risk_level"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def org_rollup(orgs: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    u = users.groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("_m"))
    e = events.groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("_e"), F.max("timestamp").alias("last_event_at"))
    return (
        orgs.join(u, "id", "left")
        .join(e, "id", "left")
        .select(
            "id",
            "domain",
            "name",
            "plan",
            "trial_ends_at",
            F.col("paddle_customer_id").isNotNull().alias("has_billing"),
            "created_at",
            F.coalesce("_m", F.lit(0)).alias("members"),
            F.coalesce("_e", F.lit(0)).alias("events"),
            "last_event_at",
        )
    )


def project_usage(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """Key ids are unique, so counting keys per project before the join needs no DISTINCT."""
    used = keys.groupBy("project_id").agg(
        F.count("*").alias("_k"), F.count_if(F.col("revoked_at").isNull()).alias("_a"), F.sum("calls_total").alias("_c")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        projects.join(used, projects.id == used.project_id, "left")
        .withColumn("key_count", zero("_k"))
        .withColumn("active_key_count", zero("_a"))
        .withColumn("total_calls", zero("_c"))
    )


def match_org(events: DataFrame, orgs: DataFrame, users: DataFrame) -> DataFrame:
    by_customer = (
        orgs.filter("paddle_customer_id IS NOT NULL").groupBy(F.col("paddle_customer_id").alias("customer_id")).agg(F.min("id").alias("_c"))
    )
    by_admin = users.filter("role = 'admin' AND email IS NOT NULL").groupBy("email").agg(F.min("org_id").alias("_a"))
    j = events.join(by_customer, "customer_id", "left").join(by_admin, "email", "left")
    return j.withColumn("org_id", F.coalesce("_c", "_a")).drop("_c", "_a")


def missing_users(seen: DataFrame, known: DataFrame) -> DataFrame:
    new = seen.distinct().join(known, ["org_id", "hashed_id"], "left_anti")
    return new.withColumn("role", F.lit("employee"))


def drop_children(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone, key, "left_anti")


# --- aggregates ----------------------------------------------------------------------------


def event_counts(events: DataFrame, as_of: str) -> DataFrame:
    """All the event counters of the dashboard in one pass per tenant."""
    week, quarter = L.since("timestamp", as_of, 7), L.since("timestamp", as_of, 90)
    warn, block, done = F.col("action") == "WARN", F.col("action") == "BLOCK", F.col("acknowledged")
    return events.groupBy("org_id").agg(
        F.count_if(warn & week).alias("week_warnings"),
        F.count_if(block & week).alias("week_blocks"),
        F.count_if((warn | block) & week).alias("week_total"),
        F.count("*").alias("total_events"),
        F.count_if(block & ~done).alias("pending_blocks"),
        F.count_if(block & quarter).alias("quarter_blocks"),
        F.count_if(block & quarter & done).alias("acknowledged_blocks"),
    )


def incident_stats(events: DataFrame, as_of: str) -> DataFrame:
    """A tenant without blocks in the quarter has resolved everything: 100."""
    c = event_counts(events, as_of)
    return c.select(
        "org_id",
        "quarter_blocks",
        "acknowledged_blocks",
        "pending_blocks",
        L.pct(F.col("acknowledged_blocks"), F.col("quarter_blocks"), 100).alias("resolution_rate"),
    )


def team_counts(orgs: DataFrame, users: DataFrame) -> DataFrame:
    per = users.groupBy(F.col("org_id").alias("id")).agg(
        F.count("*").alias("total"),
        F.count_if("extension_installed").alias("installed"),
        F.count_if(F.col("policy_acknowledged_at").isNotNull()).alias("trained"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = orgs.join(per, "id", "left").select(
        F.col("id").alias("org_id"), zero("total"), zero("installed"), zero("trained"), F.coalesce("seats", F.lit(DEFAULT_SEATS)).alias("seats")
    )
    return j.withColumn("pct_trained", L.pct(F.col("trained"), F.col("total"), 0))


def top_types(events: DataFrame, as_of: str) -> DataFrame:
    week = events.filter(L.since("timestamp", as_of, 7))
    return (
        week.select("org_id", F.explode(L.types_split(F.col("data_types"))).alias("type")).groupBy("org_id", "type").agg(F.count("*").alias("n"))
    )


def tool_summary(inv: DataFrame) -> DataFrame:
    c = inv.groupBy("org_id").agg(
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
        F.count_if(F.col("status") != "discovered").alias("reviewed"),
        F.count("*").alias("tools"),
    )
    return c.withColumn("pct_tools_reviewed", L.pct(F.col("reviewed"), F.col("tools"), 100))


def posture(orgs: DataFrame, users: DataFrame, events: DataFrame, visits: DataFrame, tools: DataFrame, as_of: str) -> DataFrame:
    """Weighted score of training, resolved incidents and reviewed tools. Tenants without events or
    tools count as fully resolved / reviewed."""
    trained = team_counts(orgs, users).select("org_id", "pct_trained")
    incidents = incident_stats(events, as_of).select("org_id", "resolution_rate")
    reviewed = tool_summary(inventory(visits, tools)).select("org_id", "pct_tools_reviewed")
    j = trained.join(incidents, "org_id", "left").join(reviewed, "org_id", "left")
    j = j.withColumn("resolution_rate", F.coalesce("resolution_rate", F.lit(100))).withColumn(
        "pct_tools_reviewed", F.coalesce("pct_tools_reviewed", F.lit(100))
    )
    score = sum((F.col(c).cast("double") * F.lit(w) for c, w in POSTURE_WEIGHTS.items()), F.lit(0.0))
    return j.withColumn("score", L.js_round(score))


def log_stats(logs: DataFrame, by: list[str]) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    c = logs.groupBy(*by).agg(
        F.count("*").alias("total_calls"),
        n("ALLOW").alias("allowed"),
        n("WARN").alias("warned"),
        n("BLOCK").alias("blocked"),
        F.coalesce(F.sum(F.col("prompt_tokens").cast("long")), F.lit(0)).alias("total_tokens"),
        L.js_round(F.nullif(F.avg("latency_ms"), F.lit(0.0))).alias("avg_latency_ms"),
    )
    rate = F.col("blocked") / F.col("total_calls") * 100
    return c.withColumn("block_rate", F.concat(one_decimal(rate), F.lit("%")))


def one_decimal(x: Column) -> Column:
    """One decimal, halves up on the stored double."""
    return F.round(x, 1).cast("decimal(18,1)").cast("string")


def platform_stats(orgs: DataFrame, as_of: str) -> DataFrame:
    plan = lambda p: F.col("plan") == p
    young = lambda d: F.col("created_at") > F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL '{d}' DAY")
    return orgs.agg(
        F.count("*").alias("total"),
        F.count_if(plan("trial")).alias("trialling"),
        F.count_if(plan("trial") & (F.col("trial_ends_at") < L.at(as_of))).alias("trial_expired"),
        F.count_if(plan("active")).alias("active"),
        F.count_if(plan("cancelled")).alias("cancelled"),
        F.count_if(plan("super")).alias("super_plans"),
        F.count_if(young(7)).alias("last_7_days"),
        F.count_if(young(30)).alias("last_30_days"),
        (F.count_if(plan("active")) * PRICE_PER_ACTIVE).alias("mrr_estimate"),
    )


def seat_usage(orgs: DataFrame, users: DataFrame) -> DataFrame:
    c = team_counts(orgs, users)
    return c.select("org_id", F.col("total").alias("used"), F.col("seats").alias("total"), (F.col("total") >= F.col("seats")).alias("limit_reached"))


def user_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count_if(F.col("action") == "BLOCK").alias("block_count"),
        F.count_if(F.col("action") == "WARN").alias("warn_count"),
        F.max("timestamp").alias("last_seen_at"),
    ).withColumn("extension_installed", F.lit(True))


def key_counters(logs: DataFrame, as_of: str) -> DataFrame:
    month = F.date_trunc("month", F.col("timestamp")) == F.date_trunc("month", L.at(as_of))
    return logs.groupBy("key_id").agg(
        F.count_if(month).alias("calls_this_month"), F.count("*").alias("calls_total"), F.max("timestamp").alias("last_used_at")
    )


def primary_type(types: Column) -> Column:
    order = F.array(*[F.lit(t) for t in TYPE_PRIORITY])
    return F.coalesce(F.get(F.filter(order, lambda p: F.array_contains(types, p)), F.lit(0)), F.lit("DEFAULT"))


def literacy_points(distinct_types: Column, anonymised: Column) -> Column:
    return F.least(F.lit(100), F.least(distinct_types, F.lit(6)) * 10 + F.least(anonymised, F.lit(8)) * 5)


def literacy_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "Advanced").when(score >= 50, "Developing").when(score >= 20, "Learning").otherwise("Getting started")
    )


def literacy_score(events: DataFrame) -> DataFrame:
    """Per user; one row per (user, primary type) first, so a busy user is a handful of rows."""
    typed = events.select("user_id", primary_type(L.types_array(F.col("data_types"))).alias("p"))
    per = typed.groupBy("user_id", "p").agg(F.count("*").alias("n"))
    c = per.groupBy("user_id").agg(F.count("*").alias("types"), F.sum("n").alias("anonymised"))
    scored = c.withColumn("score", literacy_points(F.col("types"), F.col("anonymised")))
    return scored.withColumn("label", literacy_label(F.col("score")))


def policy_labels(config: DataFrame) -> DataFrame:
    """Labels of blocked and warned types, in catalogue order; at most one entry per type."""
    pick = lambda a: F.array_join(
        F.transform(
            F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("l")) for t, x in POLICY_LABELS.items()]), lambda e: F.try_element_at("rules", e["t"]) == a),
            lambda e: e["l"],
        ),
        "; ",
    )
    return config.select("org_id", pick("BLOCK").alias("blocked"), pick("WARN").alias("warned"))


def report_totals(users: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    members = users.groupBy("org_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("policy_acknowledged_at").isNotNull()).alias("trained")
    )
    block = F.col("action") == "BLOCK"
    inside = events.filter(F.col("timestamp").between(L.at(start), L.at(end)))
    logged = inside.groupBy("org_id").agg(
        F.count("*").alias("events"), F.count_if(block).alias("blocks"), F.count_if(block & F.col("acknowledged")).alias("blocks_reviewed")
    )
    j = members.join(logged, "org_id", "full")
    j = j.select("org_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "trained", "events", "blocks", "blocks_reviewed")])
    return j.withColumn("pct_trained", L.pct(F.col("trained"), F.greatest("members", F.lit(1)), 0))


def control_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTROLS, "framework string, control string, name string, implementation string, section int")


# --- small scalar rules --------------------------------------------------------------------


def key_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def key_preview(prefix: Column) -> Column:
    return F.concat(F.substring(prefix, 1, 12), F.lit("..."))


def member_status() -> Column:
    return (
        F.when(F.col("role") == "admin", "active")
        .when((F.col("invite_status") == "invited") & ~F.col("extension_installed"), "invited")
        .when(F.col("extension_installed") & F.col("last_seen_at").isNotNull(), "active")
        .when(F.col("extension_installed"), "installed")
        .otherwise("pending")
    )


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def trial_days_left(ends: Column, as_of: str) -> Column:
    return F.greatest(F.lit(0), F.ceil(seconds_between(L.at(as_of), ends) / 86400))


def trial_locked(plan: Column, ends: Column, as_of: str) -> Column:
    """Cancelled, or neither super nor active with the trial over."""
    over = ~plan.isin("super", "active") & F.coalesce(ends < L.at(as_of), F.lit(False))
    return (plan == "cancelled") | over


def plan_label(plan: Column) -> Column:
    return F.coalesce(map_lookup(PLAN_LABELS, plan), plan, F.lit("Free Trial"))


def time_ago(at: Column, as_of: str) -> Column:
    s = seconds_between(at, L.at(as_of))
    n = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(at.isNull(), F.lit(None).cast("string"))
        .when(s < 60, "just now")
        .when(s < 3600, F.concat(n(60), F.lit(" min ago")))
        .when(s < 86400, F.concat(n(3600), F.lit(" hours ago")))
        .when(s < 604800, F.concat(n(86400), F.lit(" days ago")))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def csv_quote(v: Column) -> Column:
    text = F.coalesce(v.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def email_domain(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2)))


def type_label(t: Column) -> Column:
    return F.coalesce(map_lookup(TYPE_NAMES, t), t)


def type_hint(t: Column) -> Column:
    return F.coalesce(map_lookup(TYPE_HINTS, t), F.lit(TYPE_HINT_OTHER))
