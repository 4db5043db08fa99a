"""Registered queries: a Spark plan and, where SQL can say it, the reference answer."""

from __future__ import annotations

from ..session import tune

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(tune(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return plan

    return add
