"""All queries of the graph workbench by name: how to run them on the driver tables, and their oracles."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from chronoloom.session import shipping

FAMILIES = ["stats_queries", "check_queries", "topology_queries", "relational_queries", "link_queries", "retrieval_queries", "sink_queries", "simulate_queries", "grounding_queries"]


def entries() -> dict:
    found: dict = {}
    for family in FAMILIES:
        own = importlib.import_module(f"chronoloom.plans.{family}").QUERIES
        if twice := found.keys() & own.keys():
            raise ValueError(f"queries with the same name: {sorted(twice)}")
        found |= own
    return found


def queries() -> dict:
    return {name: shipping(run) for name, (run, _) in entries().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in entries().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["stats_battery"](spark, sf_dir)
