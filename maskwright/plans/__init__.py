"""Registered queries: each pairs a Spark job with the SQL that checks it."""

from importlib import import_module

MODULES = ["detection", "scanning", "texts", "filters", "joins", "aggregates", "windows", "paging", "mutations", "scalars", "streams"]


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
