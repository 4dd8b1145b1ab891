"""Tenant and member mutations: acknowledgement, plans, invitations, sign-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import validators
from maskwright.operators import logs as L
from maskwright.operators.mutate import DEFAULT_SEATS, PLANS, TRIAL_DAYS
from maskwright.operators.pages import ID_RANGE
from maskwright.operators.reports import email_domain


def ack_policy(users: DataFrame, acks: DataFrame) -> DataFrame:
    j = users.join(acks.select(F.col("user_id").alias("id"), "at"), "id", "left")
    return j.withColumn("policy_acknowledged_at", F.coalesce("at", "policy_acknowledged_at")).drop("at")


def set_plan(orgs: DataFrame, asked: DataFrame) -> DataFrame:
    """Last legal request per domain; ``unknown`` marks domains without a tenant."""
    last = asked.filter(F.col("plan").isin(*PLANS)).groupBy("domain").agg(F.max_by("plan", "id").alias("_plan"))
    j = orgs.select("id", "domain", "plan").join(last, "domain", "full")
    return j.select("domain", F.coalesce("_plan", "plan").alias("plan"), F.col("id").isNull().alias("unknown"))


def invite(asked: DataFrame, orgs: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome of every invitation, in id order: malformed address, seats used up, already a
    member (or invited before), or invited. Seats taken so far are a running count over id ranges."""
    members = users.groupBy("org_id").agg(F.count("*").alias("_n"))
    free = orgs.select(F.col("id").alias("org_id"), F.coalesce("seats", F.lit(DEFAULT_SEATS)).alias("_s")).join(members, "org_id", "left")
    free = free.select("org_id", F.greatest(F.col("_s") - F.coalesce("_n", F.lit(0)), F.lit(0)).alias("_free"))
    existing = users.filter("email IS NOT NULL").select("org_id", "email").distinct().withColumn("_member", F.lit(True))
    first = asked.groupBy("org_id", "email").agg(F.min("id").alias("_first"))
    j = asked.join(existing, ["org_id", "email"], "left").join(first, ["org_id", "email"]).join(free, "org_id")
    valid = validators.column("email_format", "email")
    known = F.coalesce("_member", F.lit(False)) | (F.col("id") > F.col("_first"))
    j = j.withColumns({"_valid": valid, "_known": known})
    takes = F.when(F.col("_valid") & ~F.col("_known"), 1).otherwise(0)
    run = L.running_sums(j, ["org_id"], ["id"], F.floor(F.col("id") / ID_RANGE), {"_upto": takes})
    before = F.col("_upto") - takes
    outcome = (
        F.when(~F.col("_valid"), "INVALID_REQUEST")
        .when(before >= F.col("_free"), "SEAT_LIMIT")
        .when(F.col("_known"), "CONFLICT")
        .otherwise("INVITED")
    )
    return run.withColumn("outcome", outcome)


def new_orgs(signups: DataFrame, orgs: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """First sign-up of every new domain becomes a tenant with defaults and an admin."""
    taken = users.filter("email IS NOT NULL").select("email")
    fresh = (
        signups.join(taken, "email", "left_anti")
        .withColumn("domain", email_domain(F.col("email")))
        .join(orgs.select("domain"), "domain", "left_anti")
    )
    first = fresh.groupBy("domain").agg(F.min(F.struct("id", "email")).alias("f"))
    return first.select(
        "domain",
        F.col("f.email").alias("admin_email"),
        F.col("f.id").alias("signup_id"),
        F.lit("workplace").alias("preset"),
        F.lit("trial").alias("plan"),
        F.expr(f"TIMESTAMP_NTZ'{as_of}' + INTERVAL '{TRIAL_DAYS}' DAY").alias("trial_ends_at"),
    )
