"""Streams behind a watermark: sliding windows from panes, fired and resolved alerts, bursts, payments with a side table.

Windows and bursts are given out once, when the watermark has passed their end (append mode). Rows combine into panes as long
as the slide before they are copied into windows: the panes are one windowed aggregation, the windows a second one on
``window_time`` of the first, in the same query. Checkpoints and folders of results are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from runlens.operators.ledger import valid_payments
from runlens.operators.telemetry import CRITICAL_TERMS, failure_flags, has_any, retryable_attempts
from runlens.streaming.live import event_time, write_batches

OVER = {"sum": F.sum, "min": F.min, "max": F.max}


def timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("time", event_time(F.col("us"))).withWatermark("time", late)


def closed_windows(rows: DataFrame, size_s: int, slide_s: int, late: str, folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Values per app and sliding window as ``telemetry.sliding`` gives them, each window once it is closed."""
    pane = F.window("time", f"{slide_s} seconds").alias("pane")
    panes = timed(rows, late).groupBy("app", pane).agg(*[OVER[op](c).alias(n) for n, (op, c) in folds.items()])
    sliding = F.window(F.window_time("pane"), f"{size_s} seconds", f"{slide_s} seconds").alias("w")
    windows = panes.groupBy("app", sliding).agg(*[OVER[op](n).alias(n) for n, (op, _) in folds.items()])
    return windows.select("app", F.unix_seconds("w.start").alias("start"), *folds)


def live_no_replicas(metrics: DataFrame, least: int = 1, late: str = "1 hour") -> DataFrame:
    return closed_windows(metrics, 300, 60, late, {"low": ("min", F.col("cents"))}).filter(F.col("low") < least)


def live_averages(metrics: DataFrame, rules: dict[str, int], late: str = "1 hour") -> DataFrame:
    means = closed_windows(metrics, 600, 300, late, {"total": ("sum", F.col("cents")), "n": ("sum", F.lit(1).cast("bigint"))})
    limits = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(limit).alias("most")) for name, limit in rules.items()]))
    over = means.select("*", limits.alias("r")).filter("total > r.most * n")
    return over.select("app", "start", "r.rule", F.col("total").cast("bigint").alias("total"), F.col("n").cast("bigint").alias("n"))


def live_system_failures(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    one = F.lit(1).cast("bigint")
    found = closed_windows(failure_flags(logs), 300, 60, late, {"total": ("sum", one), "hard": ("sum", F.col("hard").cast("bigint"))})
    return found.filter("hard > 0 or total >= 10").select(F.lit("system_failures").alias("rule"), "app", "start", "total")


def live_console_errors(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    critical = logs.filter(has_any(F.col("log"), CRITICAL_TERMS))
    found = closed_windows(critical, 900, 300, late, {"total": ("sum", F.lit(1).cast("bigint"))})
    return found.filter("total >= 3").select(F.lit("console_errors").alias("rule"), "app", "start", "total")


class FiredResolved(StatefulProcessor):
    """Whether an app's alert is on; closed windows come in order, within a micro-batch they are sorted."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.on = handle.getValueState("on", "on boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        on = self.on.get()[0] if self.on.exists() else False
        for row in sorted(rows, key=lambda r: r.start):
            high = row.peak > self.most
            if high != on:
                on = high
                yield Row("app", "start", "peak", "state")(key[0], row.start, row.peak, "fired" if high else "resolved")
        self.on.update((on,))

    def close(self) -> None:
        pass


def live_restarts(metrics: DataFrame, most: int, late: str = "1 hour") -> DataFrame:
    """Windows of 15 minutes, every 5, in which the restart alert of an app fires or resolves itself."""
    peaks = closed_windows(metrics, 900, 300, late, {"peak": ("max", F.col("cents"))})
    return peaks.groupBy("app").transformWithState(FiredResolved(most), "app string, start bigint, peak bigint, state string", "Append", "None")


def live_bursts(attempts: DataFrame, gap_s: int, least: int, late: str = "1 hour") -> DataFrame:
    """Closed bursts of retryable failures per service, as ``telemetry.overload_bursts`` finds them.

    A session goes on with a failure that comes exactly a gap after the one before, as a burst does.
    """
    failed = timed(retryable_attempts(attempts).filter(F.col("class") == "retryable"), late)
    bursts = failed.groupBy("service", F.session_window("time", f"{gap_s} seconds")).agg(
        F.min("us").alias("started"), F.max("us").alias("ended"), F.count(F.lit(1)).alias("failures"))
    return bursts.filter(F.col("failures") >= least).select("service", "started", "ended", "failures")


def bounded_payments(payments: DataFrame, lateness_s: int, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Payments with a state that forgets: (credited, late), both by micro-batch; drains what there is.

    A charge is remembered until the watermark has passed it by ``lateness_s``. Valid payments behind the watermark are not
    dropped but written to the side table of late ones, which is for people to look at. So each valid payment is credited, a repetition of
    a credited one, or late. The watermark of a micro-batch follows from the newest payment of those before it; the first query parts
    the payments by it and keeps it beside its results, the second one sees on-time rows only and so loses none.
    """
    spark = payments.sparkSession
    valid = valid_payments(payments).select("charge_id", "event_id", "us", "user_id", F.col("amount").alias("stars"))
    names = ", ".join(f"`{name}` {kind}" for name, kind in valid.dtypes)
    folders = {name: f"{path}/{name}" for name in ("on_time", "late", "newest", "credited")}

    def part(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        before = None
        if batch_id:
            known = spark.read.schema("us bigint, batch bigint").parquet(folders["newest"]).filter(F.col("batch") < batch_id)
            before = known.agg(F.max("us")).first()[0]
        edge = -(2**62) if before is None else (before // 1000 - lateness_s * 1000) * 1000
        first = F.min(F.struct("us", "event_id", "user_id", "stars")).alias("first")  # of one micro-batch, the first by time
        on_time = batch.filter(F.col("us") > edge).groupBy("charge_id").agg(first).select(
            "charge_id", "first.event_id", "first.us", "first.user_id", "first.stars")
        for name, rows in (("on_time", on_time), ("late", batch.filter(F.col("us") <= edge)),
                           ("newest", batch.agg(F.max("us").alias("us")))):
            rows.write.mode("overwrite").parquet(f"{folders[name]}/batch={batch_id}")
        batch.unpersist()

    query = valid.writeStream.foreachBatch(part).option("checkpointLocation", f"{checkpoint}/parted").trigger(availableNow=True).start()
    query.awaitTermination()
    on_time = spark.readStream.schema(names).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folders["on_time"])
    first = timed(on_time, f"{lateness_s} seconds").dropDuplicatesWithinWatermark(["charge_id"]).drop("time")
    write_batches(first, "append", folders["credited"], f"{checkpoint}/credited")
    return tuple(spark.read.schema(f"{names}, batch bigint").parquet(folders[name]) for name in ("credited", "late"))

