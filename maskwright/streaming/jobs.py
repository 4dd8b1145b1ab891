"""Ingest, counters, limits, scanning and alerts as micro-batch jobs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import policy
from maskwright.operators import limits, mutate, scan as S
from maskwright.operators import logs as L
from maskwright.operators import reports as R
from maskwright.operators.running import with_primary_type
from maskwright.sources import sinks
from maskwright.streaming import runtime as rt

# Age after which the configuration is read again.
CONFIG_TTL_SECONDS = 300
# days by which a call may be late and still count in a month that has ended
LATE_DAYS = 7
# seconds by which a request may be late and still count in the window it belongs to
LATENESS_SECONDS = 600
ALERT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def ingest(posts: DataFrame, out: str) -> None:
    """Route posts to visits, events and quarantine: one pass, one folder per route."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rt.save(mutate.route_posts(batch), out, "posts", batch_id, ["route"])

    rt.run(posts, out, write)


def user_counters(posts: DataFrame, out: str) -> None:
    """Block / warn counters and last activity per user, updated as posts arrive."""
    routed = mutate.route_posts(posts).filter("route <> 'quarantine'")
    is_event = F.col("route") == "event"
    counts = routed.groupBy("user_id").agg(
        F.count_if(is_event & (F.col("action") == "BLOCK")).alias("block_count"),
        F.count_if(is_event & (F.col("action") == "WARN")).alias("warn_count"),
        F.max("ts").alias("last_seen_at"),
    )
    rt.run(counts, out, lambda b, i: rt.save_version(b, out, "counters", i, ["user_id"]), mode="update")


def literacy(events: DataFrame, out: str) -> None:
    """Literacy per user; the set of types met has at most eight members."""
    state = with_primary_type(events).groupBy("user_id").agg(
        F.size(F.collect_set("primary_type")).cast("long").alias("types"), F.count("*").alias("anonymised")
    )
    scored = state.withColumn("score", R.literacy_points(F.col("types"), F.col("anonymised")))
    scored = scored.withColumn("label", R.literacy_label(F.col("score")))
    rt.run(scored, out, lambda b, i: rt.save_version(b, out, "literacy", i, ["user_id"]), mode="update")


def activity_windows(events: DataFrame, out: str, late: str = "2 days") -> None:
    """Seven-day activity counts every day; rows later than the watermark are dropped."""
    counts = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "7 days", "1 day"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n")
    )
    rt.run(counts, out, lambda b, i: rt.save_version(b, out, "windows", i, ["window_start", "event_type"]), mode="update")


def _previous(spark: SparkSession, out: str, batch_id: int, schema: str) -> DataFrame:
    """State as the previous batch left it; empty before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(rt.batch_folder(out, "state", batch_id - 1))


def rate_limit(requests: DataFrame, out: str, limit: int = limits.MAX_REQUESTS, window: int = limits.WINDOW_SECONDS, slot: int = 600, lateness: int = LATENESS_SECONDS) -> None:
    """Limiter over a stream: ``(client, id, at)``.

    State is the last window of each client. It enters the next batch as one weighted request at the
    window's start, so the batch operator continues the chain as if it had seen everything; hot
    clients are spread over time slots exactly as in batch. A request that comes late, from before its
    client's last window, counts in that window at its start: decisions already given stay. A window
    stays in the state until ``lateness`` seconds have passed since its end, by the newest request of
    any client; a request that comes later than that, and whose client has had none since, opens a window.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = batch.schema["client"].dataType.simpleString()
        state = _previous(spark, out, batch_id, f"client {key}, start long, used long, newest long")
        carried = state.select("client", F.lit(None).cast("long").alias("id"), F.col("start").alias("at"), F.col("used").alias("weight"))
        asked = batch.join(state.select("client", "start"), "client", "left")
        at = F.greatest(F.col("at").cast("long"), F.coalesce("start", F.col("at").cast("long")))
        now = asked.select("client", F.col("id").cast("long"), at.alias("at"), F.lit(1).cast("long").alias("weight"))
        # the rows that carry state are no requests, and have no id
        done = limits.rate_limit(now.unionByName(carried), limit, window, slot).filter("id IS NOT NULL")
        path = rt.save(done, out, "decisions", batch_id)
        stored = spark.read.parquet(path)
        counted = stored.select("client", "window_start", "n")
        held = state.select("client", F.col("start").alias("window_start"), F.col("used").alias("n"))
        last = counted.unionByName(held).groupBy("client").agg(F.max(F.struct("window_start", "n")).alias("m"))
        seen = stored.agg(F.max("at").alias("a")).first()["a"]
        before = state.agg(F.max("newest").alias("a")).first()["a"]
        newest = max(x for x in (seen, before, 0) if x is not None)
        open_ = last.select("client", F.col("m.window_start").alias("start"), F.col("m.n").alias("used"), F.lit(newest).cast("long").alias("newest"))
        rt.save(open_.filter(F.col("start") + window + lateness > newest), out, "state", batch_id)

    rt.run(requests, out, write)


QUOTA_KEYS = ["key_id", "month"]


def open_months(state: DataFrame, late_days: int = LATE_DAYS) -> DataFrame:
    """Counters of months that may still get calls: by the newest call seen, they ended at most ``late_days`` ago."""
    newest = state.agg(F.max("newest")).first()[0]
    ends = F.expr(f"month + INTERVAL '1' MONTH + INTERVAL '{late_days}' DAY")
    return state if newest is None else state.filter(ends > L.at(str(newest)))


def quota(calls: DataFrame, keys: DataFrame, out: str, late_days: int = LATE_DAYS) -> None:
    """Monthly quota over a stream of calls; state is one counter per (key, month).

    A batch writes the counters it changes; runs of them are merged level by level, and leave out months
    that ended more than ``late_days`` before the newest call. A call that comes later than that starts its
    month's count again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        month = F.date_trunc("month", F.col("timestamp")).cast("timestamp_ntz")
        schema = "key_id long, month timestamp_ntz, used long, newest timestamp_ntz"
        before = rt.latest(spark, out, "state", QUOTA_KEYS, batch_id - 1) if batch_id else spark.createDataFrame([], schema)
        state = open_months(before, late_days).select(*QUOTA_KEYS, "used")
        calls_ = batch.select("id", "key_id", "timestamp", month.alias("month")).join(keys.withColumn("_known", F.lit(True)), "key_id", "left")
        known = calls_.filter("_known").drop("_known")
        ran = L.running_sums(known, QUOTA_KEYS, ["timestamp", "id"], L.time_slot("timestamp"), {"_n": F.lit(1)})
        n = F.col("_n") + F.coalesce("used", F.lit(0))
        limited = (F.coalesce("monthly_limit", F.lit(0)) > 0) & (n > F.col("monthly_limit"))
        done = ran.join(state, QUOTA_KEYS, "left").select(
            "id", *QUOTA_KEYS, "timestamp", n.alias("n"), F.when(limited, 429).otherwise(200).alias("status")
        )
        none = F.lit(None).cast("long").alias("n")
        unknown = calls_.filter("_known IS NULL").select("id", *QUOTA_KEYS, "timestamp", none, F.lit(limits.UNKNOWN_KEY).alias("status"))
        decided = spark.read.parquet(rt.save(done.unionByName(unknown), out, "decisions", batch_id)).filter("n IS NOT NULL")
        seen = [df.agg(F.max(c)).first()[0] for df, c in ((before, "newest"), (decided, "timestamp"))]
        newest = max((x for x in seen if x is not None), default=None)
        clock = F.lit(None).cast("timestamp_ntz") if newest is None else L.at(str(newest))
        used = decided.groupBy(*QUOTA_KEYS).agg(F.max("n").alias("used")).withColumn("newest", clock)
        rt.save_version(used, out, "state", batch_id, QUOTA_KEYS, retire=lambda s: open_months(s, late_days))

    rt.run(calls, out, write)


def scan_gate(texts: DataFrame, out: str, at: str) -> None:
    """Scan every text once, hold the blocked ones back, and log the decision without content.

    Passed rows keep their text, held rows only their error. The log is derived from what was
    written, so the text is not scanned a second time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        gated = S.gate(S.scan(batch, redact=False)).withColumn("n_chars", F.length("text"))
        kept = gated.select(
            *[c for c in batch.columns if c != "text"],
            F.when(F.col("route") == "passed", F.col("text")).alias("text"),
            "n_chars",
            "detected_types",
            "action",
            "error_code",
            "error",
            "route",
        )
        stored = batch.sparkSession.read.parquet(rt.save(kept, out, "gate", batch_id, ["route"]))
        log = stored.select(
            *[c for c in batch.columns if c != "text"],
            F.lit("direct").alias("provider"),
            F.to_json("detected_types").alias("detected_types"),
            "action",
            F.ceil(F.col("n_chars") / F.lit(4)).alias("prompt_tokens"),
            L.at(at).alias("timestamp"),
        )
        leaked = sinks.FORBIDDEN & set(log.columns)
        if leaked:
            raise ValueError(f"content columns in a metadata log: {sorted(leaked)}")
        rt.save(log, out, "log", batch_id)

    rt.run(texts, out, write)


def alert_rows(log: DataFrame, projects: DataFrame) -> DataFrame:
    """Outbox rows for blocked and warned scans of projects that have an address. Delivery is left
    to whoever drains the outbox; the log id makes a repeated row recognisable."""
    slim = log.select("id", "project_id", "action", "detected_types", "timestamp")
    wanted = slim.filter(F.col("action").isin("BLOCK", "WARN")).join(
        projects.filter("webhook_url IS NOT NULL").select(F.col("id").alias("project_id"), "org_id", "webhook_url"), "project_id"
    )
    event = F.when(F.col("action") == "BLOCK", "scan.blocked").otherwise("scan.warned")
    data = F.struct("action", F.from_json("detected_types", "array<string>").alias("detected_types"))
    payload = F.to_json(F.struct(event.alias("event"), "project_id", "org_id", F.date_format("timestamp", ALERT_TIME).alias("timestamp"), data.alias("data")))
    return wanted.select("id", "project_id", "webhook_url", event.alias("event_type"), payload.alias("payload"))


def alerts(log: DataFrame, projects: DataFrame, out: str) -> None:
    rt.run(alert_rows(log, projects), out, lambda b, i: rt.save(b, out, "outbox", i))


class ConfigCache:
    """A copy of the last known configuration in the shared folder; taken anew once it is older than ``ttl``."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = CONFIG_TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self._load, self._ttl, self._clock = load, ttl, clock
        self._config, self._at = None, None
        self.reads = 0

    def get(self) -> DataFrame:
        now = self._clock()
        if self._config is None or now - self._at > self._ttl:
            table = self._load()
            copy = rt.new_folder(table.sparkSession, "config")
            table.write.parquet(copy)  # a table that is replaced later does not change what is held
            self._config, self._at = table.sparkSession.read.schema(table.schema).parquet(copy), now
            self.reads += 1
        return self._config


def scan_with_config(texts: DataFrame, config: ConfigCache, out: str) -> None:
    """Scan each batch under the tenants' configuration as last read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        df = S.scan(policy.with_tenant_policy(batch, config.get()), terms="terms", rules="rules", redact=False)
        rt.save(df.select("doc_id", "org_id", F.size("matches").cast("long").alias("n_matches"), "action"), out, "decisions", batch_id)

    rt.run(texts, out, write)
