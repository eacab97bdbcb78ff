"""The registered queries, by subject."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

SUBJECTS = ["money", "dialogue", "steps", "telemetry", "methodology", "streams"]


def _run(job, spark: SparkSession, sf_dir: str) -> DataFrame:
    from runlens.plans.query import Source

    return job(Source(spark, sf_dir))


def _catalogs():
    return [import_module(f"runlens.plans.{subject}").catalog for subject in SUBJECTS]


def all_jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, job) for c in _catalogs() for name, job in c.jobs.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for c in _catalogs() for name, sql in c.oracles.items()}
