"""Pages per tenant: leading rows are selected before the shuffle, totals are counted separately."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.logs import running_sums, top_per

# Page sizes.
PAGE_DEFAULT, PAGE_MAX = 50, 100
LOG_PAGE_DEFAULT, LOG_PAGE_MAX = 50, 500
ID_RANGE = 100_000


def _cut(df: DataFrame, key: str, ts: str, limit: int, offset: int) -> DataFrame:
    totals = df.groupBy(key).agg(F.count("*").alias("total"))
    rows = top_per(df, [key], [F.desc(ts), F.col("id")], limit, offset)
    return rows.join(totals, key)


def page(df: DataFrame, key: str, ts: str, page: int = 1, limit: int | None = None) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows, newest first, with total and number of pages."""
    page, limit = max(1, page), min(PAGE_MAX, max(1, limit or PAGE_DEFAULT))
    cut = _cut(df, key, ts, limit, (page - 1) * limit)
    return cut.withColumn("page", F.lit(page)).withColumn("total_pages", F.ceil(F.col("total") / limit))


def page_envelopes(rows: DataFrame, key: str, items: str, fields: Sequence[str], limit: int) -> DataFrame:
    """One JSON text per key of a cut page: its rows in order, then the page's numbers.

    A page has at most PAGE_MAX rows, so a key's rows fit in one value.
    """
    listed = F.array_sort(F.collect_list(F.struct("row_no", F.struct(*fields).alias("item"))))
    numbers = F.struct("page", F.lit(limit).alias("limit"), "total", F.col("total_pages").alias("totalPages"))
    cut = rows.groupBy(key, "page", "total", "total_pages").agg(listed.alias("l"))
    return cut.select(key, F.to_json(F.struct(F.transform("l", lambda x: x["item"]).alias(items), numbers.alias("pagination"))).alias("json"))


def offset_page(df: DataFrame, key: str, ts: str, limit: int = LOG_PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    limit, offset = min(LOG_PAGE_MAX, max(1, limit)), max(0, offset)
    return _cut(df, key, ts, limit, offset).withColumn("has_more", F.col("total") > offset + limit)


def numbered(df: DataFrame, keys: Sequence[str], id_col: str, descending: bool = False) -> DataFrame:
    """``row_no`` per key in id order, counted over id ranges so a hot key is spread."""
    slot = F.floor(F.col(id_col) / ID_RANGE)
    up = running_sums(df, keys, [id_col], slot, {"_up": F.lit(1)})
    if not descending:
        return up.withColumnRenamed("_up", "row_no")
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return up.join(total, [*keys]).withColumn("row_no", F.col("_n") - F.col("_up") + 1).drop("_n", "_up")


def members_in_order(users: DataFrame, by: str = "email") -> DataFrame:
    """Members per tenant, role down, then e-mail up with missing ones first (or creation time).

    A range-partitioned global sort; the id as last key lets even one huge tenant be split.
    """
    second = F.asc_nulls_first("email") if by == "email" else F.asc("created_at")
    return users.orderBy("org_id", F.desc("role"), second, "id")
