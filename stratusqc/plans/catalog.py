"""All registered queries. Importing the plan modules fills the registry."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from stratusqc.plans.registry import ORACLES, QUERIES, Query

MODULES = ("checks", "cleaning", "listing", "operations", "modelling", "model_facts", "streams")
for _name in MODULES:
    import_module(f"stratusqc.plans.{_name}")


def _in_utc(fn: Query) -> Query:
    """Timestamps are UTC throughout: naive input, spans of time and printed results depend on it."""

    @wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(fn) for name, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
