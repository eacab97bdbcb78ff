"""One registered query: a Spark job over the whole tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from runlens.plans.views import load, view


@dataclass
class Source:
    """The derived tables of one folder of parquet files."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"v_{name}")

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


@dataclass
class Catalog:
    jobs: dict[str, Callable[[Source], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, oracle: str | None = None):
        def register(job: Callable[[Source], DataFrame]):
            self.jobs[name] = job
            if oracle is not None:
                self.oracles[name] = oracle
            return job

        return register
