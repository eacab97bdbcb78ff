"""Call attempts, log alerts and sliding-window alerts.

A sliding window is built from panes as long as the slide: rows combine into panes before the shuffle, and
only panes are copied into the windows they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import OrderedRows, last_seen, running_sum
from runlens.registry import CALL_ATTEMPTS, MAX_WAIT_S, TURN_BUDGET_S

# Error names and log terms of the rules.
TIMEOUTS = ["TimeoutError"]
RETRYABLE_ERRORS = ["APITimeoutError", "APIConnectionError"]
FAILURE_REASONS = ["probefailed", "revisionfailed", "containerfailed", "failed"]
HARD_REASONS = ["revisionfailed", "containerfailed", "failed"]
FAILURE_TERMS = ["probe failed", "revision failed", "container failed", "failed startup probe"]
HARD_TERMS = ["revision failed", "container failed"]
CRITICAL_TERMS = ["critical", "traceback", "telegramconflicterror", "terminated by other getupdates", "sentry"]


def attempt_class(code: Column, error: Column) -> Column:
    """'ok', 'retryable' or 'fatal': waiting mends 429, 5xx, timeouts and broken connections, nothing else."""
    waits = error.isin(TIMEOUTS) | F.when(code.isNotNull(), (code == 429) | code.between(500, 599)).otherwise(
        error.isin(RETRYABLE_ERRORS)
    )
    return (
        F.when(code.between(200, 299) & error.isNull(), "ok")
        .when(F.coalesce(waits, F.lit(False)), "retryable")
        .otherwise("fatal")
    )


def retryable_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("class", attempt_class(F.col("status_code"), F.col("error")))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Per turn: attempts, failures that waiting could mend, outcome, waits, and the limits exceeded."""
    last = F.max_by("class", "attempt_id")
    outcome = F.when(last == "ok", "ok").when(last == "fatal", "fatal").otherwise("overloaded")
    return (
        retryable_attempts(attempts)
        .groupBy("turn_id")
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(F.col("class") == "retryable").alias("retryable"),
            outcome.alias("outcome"),
            F.sum("wait_s").cast("bigint").alias("waited"),
            (F.sum("wait_s") > TURN_BUDGET_S).alias("over_budget"),
            (F.count("*") > CALL_ATTEMPTS).alias("over_attempts"),
            F.count_if(F.col("retry_after") > MAX_WAIT_S).alias("long_requests"),
        )
    )


def truncated_turns(turns: DataFrame) -> DataFrame:
    """Turns cut by the token limit and their share, per version."""
    cut = F.col("stop_reason") == "max_tokens"
    return turns.groupBy("version").agg(
        F.count("*").alias("turns"), F.count_if(cut).alias("cut"), (F.count_if(cut) / F.count("*")).alias("share")
    )


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether a term occurs between term borders, in any case."""
    return F.lower(text).rlike(f"(?<![a-z0-9])({'|'.join(terms)})(?![a-z0-9])")


def failure_flags(logs: DataFrame) -> DataFrame:
    """Log lines of system failures, hard ones marked."""
    reason = F.lower("reason")
    return logs.filter(reason.isin(FAILURE_REASONS) | has_any(F.col("log"), FAILURE_TERMS)).withColumn(
        "hard", reason.isin(HARD_REASONS) | has_any(F.col("log"), HARD_TERMS)
    )


def system_failures(logs: DataFrame, prefix: str, threshold: int = 10) -> DataFrame:
    """One row if the apps named ``prefix``.. had a hard failure or enough soft ones, else none."""
    return (
        failure_flags(logs.filter(F.startswith("app", F.lit(prefix))))
        .agg(F.count("*").alias("total"), F.count_if("hard").alias("hard"))
        .filter((F.col("hard") > 0) | (F.col("total") >= threshold))
    )


def console_errors(logs: DataFrame, prefix: str, threshold: int = 3) -> DataFrame:
    mine = logs.filter(F.startswith("app", F.lit(prefix)) & has_any(F.col("log"), CRITICAL_TERMS))
    return mine.agg(F.count("*").alias("c")).filter(F.col("c") >= threshold)


def sliding(df: DataFrame, key: str, size_s: int, slide_s: int, folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Values per key and sliding window; ``folds`` maps a name to ('sum' | 'min' | 'max', column).

    ``size_s`` is a multiple of ``slide_s``. Windows start at multiples of the slide since 1970 and are named by
    their start in seconds.
    """
    over = {"sum": F.sum, "min": F.min, "max": F.max}
    pane = F.expr(f"us div {slide_s * 1_000_000}")
    panes = df.groupBy(key, pane.alias("pane")).agg(*[over[op](c).alias(n) for n, (op, c) in folds.items()])
    back = F.explode(F.sequence(F.lit(0), F.lit(size_s // slide_s - 1)))
    placed = panes.select("*", back.alias("back")).withColumn("start", (F.col("pane") - F.col("back")) * slide_s)
    return placed.groupBy(key, "start").agg(*[over[op](n).alias(n) for n, (op, _) in folds.items()])


def alert_no_replicas(metrics: DataFrame, least: int = 1) -> DataFrame:
    """Windows of 5 minutes, every minute, in which the metric fell below ``least``."""
    low = sliding(metrics, "app", 300, 60, {"low": ("min", F.col("cents"))})
    return low.filter(F.col("low") < least)


def alert_restarts(metrics: DataFrame, most: int) -> DataFrame:
    """Windows of 15 minutes, every 5, where the cumulative counter's maximum is too high: fired and resolved.

    The counter is cumulative, so the maximum counts; a sum would stay high for ever.
    """
    peaks = sliding(metrics, "app", 900, 300, {"peak": ("max", F.col("cents"))})
    rows = OrderedRows.of(peaks.withColumn("high", F.col("peak") > most), ["app"], ["start"])
    rows = rows.scan(before=last_seen("high", before=True))
    changed = rows.df.filter("high <> coalesce(before, false)")
    return changed.select("app", "start", "peak", F.when(F.col("high"), "fired").otherwise("resolved").alias("state"))


def alert_averages(metrics: DataFrame, rules: dict[str, int]) -> DataFrame:
    """Windows of 10 minutes, every 5, whose average exceeds a rule's limit, per rule."""
    means = sliding(metrics, "app", 600, 300, {"total": ("sum", F.col("cents")), "n": ("sum", F.lit(1).cast("bigint"))})
    limits = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(limit).alias("most")) for name, limit in rules.items()])
    )
    return (
        means.select("*", limits.alias("r"))
        .filter("total > r.most * n")
        .select("app", "start", "r.rule", F.col("total").cast("bigint").alias("total"), F.col("n").cast("bigint").alias("n"))
    )


def alert_logs(logs: DataFrame) -> DataFrame:
    """System failures on 5-minute windows every minute, critical lines on 15-minute windows every 5."""
    one = F.lit(1).cast("bigint")
    failures = sliding(
        failure_flags(logs), "app", 300, 60, {"total": ("sum", one), "hard": ("sum", F.col("hard").cast("bigint"))}
    ).filter("hard > 0 or total >= 10")
    critical = sliding(
        logs.filter(has_any(F.col("log"), CRITICAL_TERMS)), "app", 900, 300, {"total": ("sum", one)}
    ).filter("total >= 3")
    return failures.select(F.lit("system_failures").alias("rule"), "app", "start", "total").unionByName(
        critical.select(F.lit("console_errors").alias("rule"), "app", "start", "total")
    )


def overload_bursts(attempts: DataFrame, gap_s: int, least: int) -> DataFrame:
    """Runs of retryable failures of a service without a pause longer than ``gap_s``, of ``least`` or more.

    Failures of the same second combine first: they are always in one burst, as the gap is a second or more.
    """
    failed = retryable_attempts(attempts).filter(F.col("class") == "retryable")
    seconds = failed.groupBy("service", F.expr("us div 1000000").alias("second")).agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    rows = OrderedRows.of(seconds, ["service"], ["second"])
    rows = rows.scan(before=last_seen("last_us", before=True))
    rows = rows.map(
        lambda df: df.withColumn("opens", F.expr(f"if(first_us - before <= {gap_s * 1_000_000}L, 0L, 1L)"))
    )
    rows = rows.scan(burst=running_sum("opens"))
    return (
        rows.df.groupBy("service", "burst")
        .agg(F.min("first_us").alias("started"), F.max("last_us").alias("ended"), F.sum("n").alias("failures"))
        .filter(F.col("failures") >= least)
        .drop("burst")
    )
