"""Rules the tables must keep, checked over whole tables. Counts combine before every shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.registry import BUCKETS, STATUSES, VERDICTS


def repeated(df: DataFrame, rule: str, key: list[str]) -> DataFrame:
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    counts = df.groupBy(*key).agg(F.count("*").alias("_times")).filter("_times > 1")
    return counts.select(F.lit(rule).alias("rule"), text.alias("key"), F.col("_times").alias("n"))


def constraint_audit(
    sessions: DataFrame, artifacts: DataFrame, adrs: DataFrame, payments: DataFrame
) -> DataFrame:
    """Keys that occur more often than their uniqueness rule allows."""
    active = sessions.filter("status = 'active'")
    found = [
        repeated(active, "one active run per user", ["tg_user_id"]),
        repeated(artifacts, "artifact per session and step", ["session_id", "step_id"]),
        repeated(adrs, "decision number per session", ["session_id", "n"]),
        repeated(payments, "charge", ["charge_id"]),
    ]
    return reduce(DataFrame.unionByName, found)


def check_audit(sessions: DataFrame) -> DataFrame:
    """Rows that break a value rule, all rules in one pass. A null verdict passes."""
    rules = {
        "status": ~F.col("status").isin(STATUSES),
        "last_verdict": ~F.col("last_verdict").isin(VERDICTS),
        "consumed": ~F.col("consumed").isin(BUCKETS),
        "clarify_budget": F.col("clarify_count") > F.col("clarify_budget"),
    }
    counted = sessions.agg(
        F.count("*").alias("checked"), *[F.count_if(broken).alias(rule) for rule, broken in rules.items()]
    )
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("broken")) for r in rules])
    return counted.select("checked", F.explode(pairs).alias("r")).select("r.rule", "r.broken", "checked")


def orphans(sessions: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Child rows whose session does not exist, counted per session before the join."""
    counts = [
        rows.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("child", F.lit(child))
        for child, rows in children.items()
    ]
    known = sessions.select(F.col("id").alias("session_id"))
    return (
        reduce(DataFrame.unionByName, counts)
        .join(known, "session_id", "left_anti")
        .select("child", "session_id", "n")
    )
