"""Streaming twins of the ledger, the alerts and the transcript detectors.

Windowed alerts aggregate before the shuffle and drop rows behind the watermark. Money is never dropped:
payments are merged by charge whenever they come, and a payment that is older than what is already applied is
credited when it arrives; only run events can be too late, and they are reported as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.ledger import CARRY, ledger_carry, ledger_scans, valid_payments, with_outcomes
from runlens.operators.ordered import OrderedRows, last_seen
from runlens.operators.telemetry import CRITICAL_TERMS, failure_flags, has_any
from runlens.registry import FREE_RUNS, PIPELINES
from runlens.session import fresh_path

FILES_PER_TRIGGER = 64


def table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The files of a table as a stream, be the table one file or a folder of files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        .parquet(f"{folder}/{name}.[p]arquet")  # as a pattern, it may be a file as well
    )


def write_batches(stream: DataFrame, mode: str, path: str, checkpoint: str) -> bool:
    """Run over all that is there, writing each micro-batch below ``path``; a repeated one replaces itself.

    Says whether there was a micro-batch.
    """
    ran = []

    def write(batch: DataFrame, batch_id: int) -> None:
        ran.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return bool(ran)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All results of a stream over the files there are, with the number of their micro-batch."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    schema = f"{_ddl(stream)}, batch bigint"
    if not write_batches(stream, mode, path, fresh_path(spark, f"{name}-progress")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def latest(results: DataFrame, key: list[str]) -> DataFrame:
    """The newest result of each key of an update-mode stream."""
    values = [c for c in results.columns if c not in (*key, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return results.groupBy(*key).agg(newest).select(*key, "v.*")


def live_payments(payments: DataFrame) -> DataFrame:
    """First valid payment per charge, kept for ever (update mode).

    A minimum combines before the shuffle, so a charge that is sent again and again costs one row a task.
    """
    first = F.min(F.struct("us", "event_id", "user_id", "amount")).alias("first")
    return valid_payments(payments).groupBy("charge_id").agg(first)


def payments_of(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("charge_id")
        .agg(F.min("first").alias("first"))
        .select("charge_id", "first.event_id", "first.us", "first.user_id", F.col("first.amount").alias("stars"))
    )


class CarryLog:
    """Small per-key state between micro-batches, as files below the shared folder.

    A micro-batch writes the keys it changed; every ``COMPACT``-th one writes all keys, so reading never goes
    back further. A repeated micro-batch reads the same files and replaces its own.
    """

    COMPACT = 20

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def before(self, batch_id: int) -> DataFrame:
        """The newest state of every key before a micro-batch."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        since = (batch_id - 1) // self.COMPACT * self.COMPACT
        paths = [f"{self.path}/batch={i}" for i in range(since, batch_id)]
        logged = self.spark.read.schema(f"{self.schema}, batch bigint").option("basePath", self.path).parquet(*paths)
        return latest(logged, self.key)

    def write(self, batch_id: int, changed: DataFrame) -> None:
        if batch_id and batch_id % self.COMPACT == 0:
            kept = self.before(batch_id).join(changed.select(*self.key), self.key, "left_anti")
            changed = changed.unionByName(kept)
        changed.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


Step = Callable[[OrderedRows], tuple[DataFrame, DataFrame]]
"""Rows of a micro-batch with their key's carry -> (results, changed carries)."""


def carried(
    stream: DataFrame, key: list[str], carry: str, zero: dict[str, str], step: Step, name: str,
    late_adds: dict[str, tuple[str, str, str]] | None = None,
) -> DataFrame:
    """Run a stream whose keys carry state: rows of a key are taken in order of (us, event_id).

    A micro-batch is an ordinary batch job on the running values, so a key with a third of all rows is split
    like there. A row that comes after a later one of its key was applied is not applied: it gives the
    result 'late'. ``carry`` is the DDL of the state, ``zero`` its values for a new key.

    ``late_adds`` names what late rows of a kind still do: {kind: (carry column, what a row adds, its result)}.
    They take effect when they arrive, before the other rows of their micro-batch.
    """
    adds = late_adds or {}
    ran = []
    spark = stream.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-carry")
    kinds = dict(stream.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in key)
    log = CarryLog(spark, state, key, f"{keys}, last_us bigint, last_id bigint, {carry}")

    late = F.expr("coalesce(struct(us, event_id) <= struct(last_us, last_id), false)")

    def with_late(before: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The carries with what late rows add, and the keys that have such rows."""
        places = before.select(*key, "last_us", "last_id")
        behind = batch.filter(F.col("kind").isin(*adds)).join(places, key).filter(late)
        sums = [F.sum(F.expr(f"if(kind = '{kind}', {value}, 0L)")).alias(f"_{kind}") for kind, (_, value, _) in adds.items()]
        arrived = behind.groupBy(*key).agg(*sums)
        grown = {column: F.col(column) + F.coalesce(f"_{kind}", F.lit(0)) for kind, (column, _, _) in adds.items()}
        return before.join(arrived, key, "left").withColumns(grown).drop(*(f"_{kind}" for kind in adds)), arrived.select(*key)

    def handle(batch: DataFrame, batch_id: int) -> None:
        ran.append(batch_id)
        batch = batch.persist()
        before = log.before(batch_id)
        if adds:
            before, arrived = with_late(before, batch)
        rows = OrderedRows.of(batch, key, ["us", "event_id"]).attach(before)
        rows = rows.map(lambda df: df.withColumns({c: F.expr(f"coalesce({c}, {z})") for c, z in zero.items()}))
        results, changed = step(rows.map(lambda df: df.filter(~late)))
        result = F.lit("late")
        for kind, (_, _, said) in adds.items():
            result = F.when(F.col("kind") == kind, F.lit(said)).otherwise(result)
        passed = rows.df.filter(late).select(*key, "us", "event_id", "kind", result.alias("result"))
        if adds:  # keys of which nothing but late rows came
            others = arrived.join(changed.select(*key), key, "left_anti")
            changed = changed.unionByName(before.join(others, key, "left_semi").select(*changed.columns))
        results.unionByName(passed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        log.write(batch_id, changed)
        batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", fresh_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = f"{keys}, us bigint, event_id bigint, kind string, result string, batch bigint"
    return spark.read.schema(schema).parquet(path) if ran else spark.createDataFrame([], schema)


def outcomes(rows: OrderedRows, key: list[str], result: str) -> DataFrame:
    return rows.df.select(*key, "us", "event_id", "kind", F.expr(result).alias("result"))


def live_ledger(events: DataFrame, free_runs: int = FREE_RUNS) -> DataFrame:
    """The outcome of each start, credited payment, finish and abandon, as they arrive.

    events: user_id, us, event_id, kind, owner. Payments are valid and credited once already.
    """

    def step(rows: OrderedRows) -> tuple[DataFrame, DataFrame]:
        scanned = ledger_scans(rows, free_runs)
        return outcomes(with_outcomes(scanned), ["user_id"], "outcome"), ledger_carry(scanned.df)

    state = "carry_cycle bigint, carry_credits bigint, carry_prior struct<cycle: bigint, credits: bigint>, " \
        "carry_delivered bigint, carry_floor bigint"
    runs = events.filter(F.col("kind").isin("start", "pay", "finish", "abandon"))
    paid = {"pay": ("carry_credits", "1L", "credited")}
    return carried(runs, ["user_id"], state, CARRY, step, "ledger", paid)


def last_place() -> list[Column]:
    place = F.max(F.struct("us", "event_id"))
    return [place["us"].alias("last_us"), place["event_id"].alias("last_id")]


def live_choice(updates: DataFrame) -> DataFrame:
    """The version each message starts with: the pick since the last message or reset."""

    def step(rows: OrderedRows) -> tuple[DataFrame, DataFrame]:
        # what a row leaves pending: its pick, or nothing
        leaves = "named_struct('version', if(kind = 'pick', version, null))"
        rows = rows.scan(before=last_seen(leaves, before=True))
        rows = rows.map(lambda df: df.withColumn("taken", F.expr("if(before is null, pending, before.version)")))
        after = F.max_by(F.when(F.col("kind") == "pick", F.col("version")), F.struct("us", "event_id"))
        changed = rows.df.groupBy("user_id").agg(*last_place(), after.alias("pending"))
        return outcomes(rows, ["user_id"], "if(kind = 'message', taken, null)"), changed

    known = updates.filter((F.col("kind") != "pick") | F.col("version").isin(*PIPELINES))
    return carried(known, ["user_id"], "pending string", {}, step, "choice")


def live_messages(messages: DataFrame) -> DataFrame:
    """The transcript as it grows, each row with what the detectors make of it.

    messages: session_id, us (0), event_id (the message id), kind (the role), marks (question marks). The
    result is 'double_user' for a user message right after one, else 'user', 'asked' or 'said'.
    """

    def step(rows: OrderedRows) -> tuple[DataFrame, DataFrame]:
        rows = rows.scan(before=last_seen("kind", before=True))
        verdict = """case when kind = 'user' and coalesce(before, role) = 'user' then 'double_user'
            when kind = 'user' then 'user' when marks > 0 then 'asked' else 'said' end"""
        after = F.max_by("kind", F.struct("us", "event_id")).alias("role")
        return outcomes(rows, ["session_id"], verdict), rows.df.groupBy("session_id").agg(*last_place(), after)

    return carried(messages, ["session_id"], "role string", {}, step, "transcript")


def live_detectors(transcript: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lost replies and stranded sessions in what ``live_messages`` has written so far."""
    lost = transcript.filter("result = 'double_user'").select(
        F.lit("double_user").alias("detector"), "session_id", F.col("event_id").alias("id")
    )
    idle = F.expr("status = 'active' and current_question is null")
    states = sessions.select(F.col("id").alias("session_id"), idle.alias("idle"))
    last = transcript.groupBy("session_id").agg(
        F.max_by("result", "event_id").alias("result"), F.max("event_id").alias("id")
    )
    ended = F.when(F.col("result").isin("user", "double_user"), "no_reply").when(
        (F.col("result") == "said") & F.coalesce("idle", F.lit(False)), "nothing_asked"
    )
    tails = last.join(states, "session_id", "left").select(ended.alias("detector"), "session_id", "id")
    return lost.unionByName(tails.filter("detector is not null"))


def event_time(us: Column) -> Column:
    return F.timestamp_micros(us)


def live_windows(rows: DataFrame, size: str, slide: str, late: str, *folds: Column) -> DataFrame:
    """Folds per app and sliding window, behind a watermark (update mode)."""
    timed = rows.withColumn("time", event_time(F.col("us"))).withWatermark("time", late)
    grouped = timed.groupBy("app", F.window("time", size, slide)).agg(*folds)
    return grouped.withColumn("start", F.unix_seconds("window.start")).drop("window")


def live_metrics(metrics: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    cents = F.col("cents")
    return live_windows(
        metrics, size, slide, late,
        F.min(cents).alias("low"), F.max(cents).alias("peak"), F.sum(cents).alias("total"), F.count("*").alias("n"),
    )


def live_failures(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    return live_windows(
        failure_flags(logs), "5 minutes", "1 minute", late,
        F.count("*").alias("total"), F.count_if("hard").alias("hard"),
    )


def live_critical(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    critical = logs.filter(has_any(F.col("log"), CRITICAL_TERMS))
    return live_windows(critical, "15 minutes", "5 minutes", late, F.count("*").alias("total"))
