"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.sources.views import frame, with_views


class Tables:
    """``t.users``, ``t.documents``, …: the adapter views and plain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return frame(self.spark, self.sf_dir, name)


Job = Callable[[Tables], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None) -> Callable[[Job], Job]:
    """Register a job; ``sql`` is its DuckDB equivalent over the same views."""

    def register(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = with_views(sql, views)
        return job

    return register


def runnable(job: Job) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return job(Tables(spark, sf_dir))

    return run
