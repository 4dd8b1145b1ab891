"""Running sums, limits, billing and paging against plain Python, with a hot key."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from maskwright.operators import limits, members, mutate, pages, running
from maskwright.operators import logs as L
from maskwright.operators import reports as R

T0 = dt.datetime(2024, 1, 1)


def skewed_events(n=3000, seed=5):
    """A third of all rows belong to user 0; some share a timestamp."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rng.randint(1, 20)
        ts = T0 + dt.timedelta(seconds=rng.randint(0, 40000) // 7 * 7)
        types = rng.choice(['["EMAIL"]', '["IBAN","EMAIL"]', "EMAIL, ADDRESS", "[]", '["PHONE"]'])
        rows.append((i, user, ts, types, rng.choice(["WARN", "BLOCK"])))
    return rows


SCHEMA = "id long, user_id long, timestamp timestamp_ntz, data_types string, action string"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(skewed_events(), SCHEMA)


def test_running_counters(events):
    want, state = {}, defaultdict(lambda: [0, 0])
    for i, user, ts, _, action in sorted(skewed_events(), key=lambda r: (r[2], r[0])):
        state[user][action == "WARN"] += 1
        want[i] = tuple(state[user])
    got = {r.id: (r.block_count, r.warn_count) for r in running.running_counters(events).collect()}
    assert got == want
    # the last row of each user equals the batch counters
    last = {u: tuple(v) for u, v in state.items()}
    assert {r.user_id: (r.block_count, r.warn_count) for r in R.user_counters(events).collect()} == last


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_null_keys_form_a_group(spark, threshold):
    """Under a shuffled and under a broadcast join."""
    rows = [(i, None if i % 2 else 1, T0 + dt.timedelta(minutes=15 * i) if i < 18 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.id: r.n for r in L.running_sums(df, ["k"], ["ts", "id"], L.time_slot("ts"), {"n": F.lit(1)}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {18: 1, 19: 1, **{i: i // 2 + 2 for i in range(18)}}  # missing times come first
    assert got == want


def test_a_dense_slot_is_cut_into_blocks(spark, monkeypatch):
    """All rows of a key in ten minutes, many at the same time; missing keys and times are places like others."""
    monkeypatch.setattr(L, "DENSE_SLOT", 200)
    monkeypatch.setattr(L, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, None]), T0 + dt.timedelta(seconds=rng.randint(0, 90)) if i % 11 else None, rng.randint(-3, 9)) for i in range(4000)]
    rows += [(i, 7, T0 + dt.timedelta(minutes=i % 50), 1) for i in range(4000, 4200)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v int").repartition(7)
    want, state = {}, defaultdict(int)
    for i, k, ts, v in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[0])):
        state[k] += v
        want[i] = state[k]
    got = {r.id: r.s for r in L.running_sums(df, ["k"], ["ts", "id"], L.time_slot("ts"), {"s": F.col("v")}).collect()}
    assert got == want
    at = df.withColumn("_at", F.struct("k", L.time_slot("ts").alias("_slot")))
    blocks = L._cut(at, at.filter("k = 0 AND ts IS NOT NULL").select("_at").distinct(), ["ts", "id"])
    sizes = sorted(r["count"] for r in blocks.filter("k = 0 AND ts IS NOT NULL").groupBy("_block").count().collect())
    assert len(sizes) > 20 and sizes[-1] < sum(sizes) / 8  # more tasks than cores, none with a large share


def test_acks_against_a_loop(spark):
    events = [(i, i % 3, i % 5 == 0 or None, 9 if i % 5 == 0 else None, None, None) for i in range(12)] + [(50, None, None, None, None, None), (None, 1, None, None, None, None)]
    acks = [(0, 0, 1, "a", 5), (0, 0, 2, "b", 5), (0, 0, 3, "c", 4), (1, 2, 4, None, 1), (1, 2, 5, None, 2), (1, 1, 6, None, 1), (99, 1, 7, "x", 1), (2, None, 8, "x", 1), (50, None, 9, "x", 1), (None, 1, 9, "x", 1)]
    e = spark.createDataFrame(events, "id long, org_id long, acknowledged boolean, acknowledged_by long, acknowledged_at timestamp_ntz, acknowledged_note string")
    a = spark.createDataFrame(acks, "id long, acting_org_id long, acknowledged_by long, note string, ts long")
    new, rejected = mutate.ack_events(e, a, "2024-01-31 00:00:00")
    got = {(r.id, r.org_id): (r.acknowledged, r.acknowledged_by, r.acknowledged_note, r.acknowledged_at is not None) for r in new.collect()}
    want = {(i, o): (bool(k), by, None, False) for i, o, k, by, _, _ in events}
    want[(0, 0)], want[(1, 1)] = (True, 2, "b", True), (True, 6, None, True)
    assert got == want and new.columns == e.columns
    refused = sorted(((r.id, r.acting_org_id, r.reason) for r in rejected.collect()), key=str)
    want = [(1, 2, "FORBIDDEN")] * 2 + [(2, None, "FORBIDDEN"), (50, None, "FORBIDDEN"), (99, 1, "NOT_FOUND"), (None, 1, "NOT_FOUND")]
    assert refused == sorted(want, key=str)
    empty = mutate.settle_acks(e, a.filter("false"), "2024-01-31 00:00:00")
    assert empty.count() == len(events) and empty.filter("reason IS NOT NULL").isEmpty()


def test_literacy_running_ends_at_the_score(events):
    run = running.literacy_running(events)
    last = {r.user_id: r.s for r in run.groupBy("user_id").agg(F.max_by("score", F.struct("timestamp", "id")).alias("s")).collect()}
    assert last == {r.user_id: r.score for r in R.literacy_score(events).collect()}


@pytest.mark.parametrize("seed,slot", [(1, 60), (2, 600), (3, 97)])
def test_rate_limit_against_a_loop(spark, seed, slot, monkeypatch):
    rng = random.Random(seed)
    rows, t = [], defaultdict(int)
    for i in range(2500):
        c = 0 if i % 3 == 0 else rng.randint(1, 6)
        t[c] += rng.choice([0, 0, 1, 3, 20, 59, 60, 61, 500]) if rng.random() < 0.5 else rng.randint(0, 9)
        rows.append((i, c, t[c]))
    state, want = {}, {}
    for i, c, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if c not in state or state[c][0] + 60 <= at:
            state[c] = [at, 0]
        state[c][1] += 1
        want[i] = (state[c][0], state[c][1] > 10)
    df = spark.createDataFrame(rows, "id long, client long, at long")
    got = {r.id: (r.window_start, r.limited) for r in limits.rate_limit(df, slot=slot).collect()}
    monkeypatch.setattr(limits, "BLOCK", 3)
    assert got == {r.id: (r.window_start, r.limited) for r in limits.rate_limit(df, slot=slot).collect()}
    assert got == want


def test_quota_zero_and_null_are_unlimited(spark):
    rows = [(i, i % 3, T0 + dt.timedelta(hours=i), [None, 0, 2][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, key_id long, timestamp timestamp_ntz, monthly_limit long")
    bad = limits.monthly_quota(df).filter("status = 429").groupBy("key_id").count().collect()
    assert [(r.key_id, r["count"]) for r in bad] == [(2, 8)]


def test_billing_fold_against_a_loop(spark):
    rng = random.Random(9)
    kinds = ["subscription.created", "subscription.updated", "subscription.cancelled", "subscription.paused", "subscription.activated"]
    rows = []
    for i in range(400):
        k = rng.randint(0, 15)
        rows.append((i, T0 + dt.timedelta(minutes=rng.randint(0, 99)), k, f"sub_{k}", rng.choice([None, f"c{k}", f"d{k}"]), rng.choice(["price_team", "price_business", None, "odd"]), rng.choice(kinds)))
    state = {}
    for i, ts, org, sub, cust, price, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        seats = {"price_team": 25, "price_business": 100}.get(price, 25)
        if kind in ("subscription.created", "subscription.activated"):
            state[sub] = ["active", seats, cust]
        elif sub in state and kind == "subscription.updated" and price:
            state[sub] = ["active", seats, state[sub][2] or cust]
        elif sub in state and kind in ("subscription.cancelled", "subscription.paused"):
            state[sub][0] = "cancelled"
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, org_id long, subscription_id string, customer_id string, price_id string, event_type string")
    got = {r.subscription_id: [r.plan, r.seats, r.customer_id] for r in mutate.billing_state(df).collect()}
    assert got == state


def test_invitations_against_a_loop(spark):
    rng = random.Random(4)
    users = [(i, i % 4, f"u{i}@x.co") for i in range(20)]
    orgs = [(o, 8 + o) for o in range(4)]
    asked = [(i, rng.randint(0, 3), rng.choice([f"u{rng.randint(0, 40)}@x.co", "bad"])) for i in range(120)]
    have = defaultdict(set)
    for _, o, e in users:
        have[o].add(e)
    want = {}
    for i, o, e in asked:
        if e == "bad":
            want[i] = "INVALID_REQUEST"
        elif len(have[o]) >= 8 + o:
            want[i] = "SEAT_LIMIT"
        elif e in have[o]:
            want[i] = "CONFLICT"
        else:
            have[o].add(e)
            want[i] = "INVITED"
    got = members.invite(
        spark.createDataFrame(asked, "id long, org_id long, email string"),
        spark.createDataFrame(orgs, "id long, seats long"),
        spark.createDataFrame(users, "id long, org_id long, email string"),
    )
    assert {r.id: r.outcome for r in got.collect()} == want


def test_members_come_in_report_order(spark):
    rows = [(1, 1, "employee", None), (2, 1, "admin", "z"), (3, 1, "employee", "b"), (4, 1, "employee", "a"), (5, 0, "admin", None)]
    df = spark.createDataFrame(rows, "id long, org_id long, role string, email string")
    assert [r.id for r in pages.members_in_order(df).collect()] == [5, 1, 4, 3, 2]


def test_pages_limit_before_the_shuffle(events):
    plan = pages.page(events.withColumnRenamed("user_id", "org_id"), "org_id", "timestamp", 2, 20)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_page_bounds(events):
    df = events.withColumnRenamed("user_id", "org_id")
    first = pages.page(df, "org_id", "timestamp", page=-3, limit=1000)
    assert first.groupBy("org_id").count().agg(F.max("count")).first()[0] == 100
    assert pages.offset_page(df, "org_id", "timestamp", limit=-1).groupBy("org_id").count().agg(F.max("count")).first()[0] == 1


def test_zero_denominators(spark):
    orgs = spark.createDataFrame([(1, None)], "id long, seats long")
    users = spark.createDataFrame([], "org_id long, extension_installed boolean, policy_acknowledged_at timestamp_ntz")
    r = R.team_counts(orgs, users).first()
    assert (r.total, r.seats, r.pct_trained) == (0, 10, 0)
    ev = spark.createDataFrame([(1, T0, "WARN", False)], "org_id long, timestamp timestamp_ntz, action string, acknowledged boolean")
    assert R.incident_stats(ev, "2024-01-31 00:00:00").first().resolution_rate == 100


def test_absent_and_null_patches_differ(spark):
    p = spark.createDataFrame([(1, "a", "u"), (2, "b", "u"), (3, "c", "u")], "id long, name string, webhook_url string")
    patch = spark.createDataFrame([(1, ["name", "webhook_url"], None, None), (2, [], "x", "y")], "id long, present array<string>, name string, webhook_url string")
    got = {r.id: (r.name, r.webhook_url) for r in mutate.patch_project(p, patch).collect()}
    assert got == {1: ("a", None), 2: ("b", "u"), 3: ("c", "u")}


def test_latest_per_prefers_order_then_id(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c")], "k int, ts int, id int, v string")
    assert L.latest_per(df, ["k"], ["ts", "id"], ["v"]).first().v == "b"
