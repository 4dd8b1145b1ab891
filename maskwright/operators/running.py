"""Per-user running state over the event log, computed in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.logs import running_sums, time_slot, types_array
from maskwright.operators.reports import literacy_label, literacy_points, primary_type

_ORDER = ["timestamp", "id"]


def with_primary_type(events: DataFrame) -> DataFrame:
    return events.withColumn("primary_type", primary_type(types_array(F.col("data_types"))))


def lesson_level(events: DataFrame) -> DataFrame:
    """n-th encounter of a primary type by a user decides the lesson: first, second to third, later."""
    d = running_sums(with_primary_type(events), ["user_id", "primary_type"], _ORDER, time_slot("timestamp"), {"n": F.lit(1)})
    return d.withColumn("level", F.when(F.col("n") <= 1, 0).when(F.col("n") <= 3, 1).otherwise(2))


def running_counters(events: DataFrame) -> DataFrame:
    """Block and warn counters as they stand after each event."""
    one = lambda a: F.when(F.col("action") == a, 1).otherwise(0)
    return running_sums(
        events, ["user_id"], _ORDER, time_slot("timestamp"), {"block_count": one("BLOCK"), "warn_count": one("WARN")}
    )


def literacy_running(events: DataFrame) -> DataFrame:
    """Score after every event: types met so far and events anonymised so far, both capped.

    The first event of each (user, type) comes from a pre-aggregated minimum, not from a window.
    """
    d = with_primary_type(events)
    first = d.groupBy("user_id", "primary_type").agg(F.min(F.struct(*_ORDER)).alias("_first"))
    flagged = d.join(first, ["user_id", "primary_type"]).withColumn(
        "_new", F.when(F.struct(*_ORDER) == F.col("_first"), 1).otherwise(0)
    )
    run = running_sums(flagged, ["user_id"], _ORDER, time_slot("timestamp"), {"_types": F.col("_new"), "_n": F.lit(1)})
    scored = run.withColumn("score", literacy_points(F.col("_types"), F.col("_n")))
    return scored.withColumn("label", literacy_label(F.col("score"))).drop("_first", "_new", "_types", "_n")
