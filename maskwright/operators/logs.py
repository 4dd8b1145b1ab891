"""Reusable pieces over the log tables: typed JSON columns, predicates, skew-safe running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import written

# rows of a key and slot beyond which the slot is cut into blocks, the rows that a block holds on average,
# and the sampled rows among which one is a cut, which keeps blocks alike
DENSE_SLOT = 200_000
BLOCK_ROWS = 50_000
SAMPLED_A_BLOCK = 8


def at(ts: str) -> Column:
    """Zone-less timestamp literal."""
    return F.expr(f"TIMESTAMP_NTZ'{ts}'")


def since(col: str, as_of: str, days: int) -> Column:
    return F.col(col) >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL '{days}' DAY")


def js_round(x: Column) -> Column:
    """Halves go up, as in ``floor(x + 0.5)``."""
    return F.floor(x + 0.5)


def pct(part: Column, whole: Column, if_none: int) -> Column:
    return F.when(whole > 0, js_round(part / whole * 100)).otherwise(F.lit(if_none)).cast("long")


def types_array(raw: Column) -> Column:
    """JSON array of types; anything else becomes the one-element array of the raw text."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))


def types_split(raw: Column) -> Column:
    """JSON array of types; anything else is split on commas, trimmed, blanks dropped."""
    pieces = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.from_json(raw, "array<string>"), pieces)


def log_filter(
    project: int | None = None, start: str | None = None, end: str | None = None, action: str | None = None
) -> Column:
    """Conjunction of the given predicates; absent ones fold away."""
    cond = F.lit(True)
    if project is not None:
        cond = cond & (F.col("project_id") == project)
    if start is not None:
        cond = cond & (F.col("timestamp") >= at(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= at(end))
    if action is not None:
        cond = cond & (F.col("action") == action.upper())
    return cond


def time_slot(ts: str, seconds: int = 600) -> Column:
    """Number of the time slot a zone-less timestamp falls in."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div {seconds}")


def _cut(d: DataFrame, dense: DataFrame, order: Sequence[str]) -> DataFrame:
    """``d`` plus ``_block``: rows of dense slots are cut at quantiles of a sample, about every BLOCK_ROWS.

    A row is sampled by the hash of what orders it, so that a task that is run again cuts alike. Rows that
    agree in all of ``order`` stay together.
    """
    place = F.struct(*order)
    sampled = d.filter(F.pmod(F.xxhash64(*order), F.lit(max(1, BLOCK_ROWS // SAMPLED_A_BLOCK))) == 0).join(dense, "_at", "left_semi")
    quantiles = F.filter(F.array_sort(F.collect_set(place)), lambda _, i: i % SAMPLED_A_BLOCK == SAMPLED_A_BLOCK - 1)
    cuts = sampled.groupBy("_at").agg(quantiles.alias("_cuts"))
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    return d.join(cuts, "_at", "left").withColumn("_block", F.when(F.col("_cuts").isNull(), 0).otherwise(block)).drop("_cuts")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, sums: dict[str, Column]
) -> DataFrame:
    """``df`` plus running sums per key, in ``order``, without ever sorting a whole key in one task.

    ``slot`` must not decrease along ``order`` (a time slot, an id range). Totals per (key, slot)
    are aggregated once and written; a window over those few totals gives what lies before each slot;
    the rows themselves are only ordered within their slot. Where a key has more than DENSE_SLOT rows in
    a slot, the slot is cut into blocks by quantiles of a sample, and the same is done block by block.
    A key with a third of all rows is thus spread over its slots, and over blocks if all lie in one slot.
    """
    cols = {f"_v{i}": e for i, e in enumerate(sums.values())}
    # keys travel as structs, which are never NULL themselves: NULL keys form a group of their own
    d = df.withColumn("_at", F.struct(*keys, slot.alias("_slot"))).withColumns(cols)
    rows_and_sums = [F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in cols]]
    totals, part = written(d.groupBy("_at").agg(*rows_and_sums), "totals"), ["_at"]
    dense = totals.filter(F.col("_rows") > DENSE_SLOT).select("_at")
    if not dense.isEmpty():
        part = ["_at", "_block"]
        d = _cut(d, dense, order)
        totals = d.groupBy(*part).agg(*rows_and_sums)
    whole = F.struct(*[F.col(f"_at.{k}").alias(k) for k in keys])
    earlier = Window.partitionBy(whole).orderBy("_at._slot", *part[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}") for c in cols])
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = d.join(before, part)
    out = [(F.col(f"_b{c}") + F.sum(c).over(within)).alias(name) for name, c in zip(sums, cols)]
    return j.select(*df.columns, *out)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``; partial maxima are combined before the shuffle."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows skip+1 … skip+n per key. The row_number bound lets Spark keep only the leading rows of
    each key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= skip + n)
    cut = ranked.filter(F.col("row_no") > skip) if skip else ranked
    return cut.withColumn("row_no", F.col("row_no").cast("long"))
