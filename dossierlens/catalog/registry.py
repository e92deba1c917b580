"""Registered queries: a Spark plan over the test tables and, where SQL can say the same, an independent statement."""

import functools

from dossierlens.session import adapt

QUERIES = {}
CHECKS = {}


def query(name: str, sql: str = None):
    def register(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _adapted(plan)
        if sql is not None:
            CHECKS[name] = sql
        return plan
    return register


def _adapted(plan):
    """The plan in a session with the run-time settings it is written for."""
    @functools.wraps(plan)
    def run(spark, sf_dir):
        adapt(spark)
        return plan(spark, sf_dir)
    return run
