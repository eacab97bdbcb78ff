"""Replays of ordered events on a stream, with each key's state in the keyed store.

Rows may come in any order within a lateness. A key's state holds what follows from the rows that can no longer be overtaken and,
beside it, the rows that still can, so a micro-batch reads and writes the keys of its own rows only, whatever was seen
before. Rows from the first new one on are gone through again and their results given out once more; the newest result of a row
counts (``live.latest``). A row that comes later than the lateness allows is never dropped: it is reported, and rows of money still
take effect when they arrive.

The checkpoint and the folder of the results are the caller's: a query started again with both goes on where it stopped.
Text rules run as columns before the shuffle, so what a busy session sends to its task is a few short values per call.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from runlens.operators import steps
from runlens.operators.ledger import valid_payments
from runlens.registry import FINISH_MARKER, FREE_RUNS, MAX_ARTIFACT_BYTES, MAX_SESSION_BYTES, PIPELINES
from runlens.streaming.live import write_batches

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Rule:
    """How the rows of one key act on its state.

    ``step`` takes (state, row) to (new state, results); states and rows are JSON values. ``place`` names the two columns that
    order the rows, the first of them also in the unit of ``lateness``. ``late`` does the same for a row that comes too late.
    """

    place: tuple[str, str]
    columns: list[str]
    start: Any
    step: Callable[[Any, dict], tuple[Any, tuple]]
    late: Callable[[Any, dict], tuple[Any, tuple]]
    results: list[str]
    lateness: int
    ends_only: bool = False


class Replay(StatefulProcessor):
    """One key: the state behind all settled rows, the place of the last of them, and the rows that wait."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "settled string, first bigint, second bigint, waiting string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rule = self.rule
        state, last, waiting = rule.start, None, {}
        held = self.held.get()  # None for a new key; one call to the store fewer than asking first
        if held is not None:
            settled, first, second, left = held
            state, last = json.loads(settled), None if first is None else (first, second)
            waiting = {(a, b): values for a, b, values in json.loads(left)}
        fresh, newest = [], max(waiting, default=None)
        for row in rows:
            place = (row[rule.place[0]], row[rule.place[1]])
            values = {name: row[name] for name in rule.columns}
            if last is not None and place <= last:
                state, said = rule.late(state, values)
                yield self._row(key, place, values, said)
            else:
                waiting[place] = values
                fresh.append(place)
        settled, now, out = (state, last), state, None
        order = sorted(waiting)
        horizon = (order[-1][0] - rule.lateness) if order else 0
        for place in order:
            now, said = rule.step(now, waiting[place])
            if place[0] < horizon:
                settled = (now, place)
            if fresh and place >= min(fresh):
                out = self._row(key, place, waiting[place], said)
                if not rule.ends_only:
                    yield out
        if rule.ends_only and out is not None:
            yield out
        state, last = settled
        left = [[*place, waiting[place]] for place in order if last is None or place > last]
        self.held.update((json.dumps(state), *(last or (None, None)), json.dumps(left)))

    def _row(self, key, place, values: dict, said: tuple) -> Row:
        names = ["key", *self.rule.place, "kind", *self.rule.results]
        return Row(*names)(key[0], *place, values.get("kind"), *said)

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, key: str, rule: Rule, results: str, mode: str) -> DataFrame:
    """The results of the rows of a stream: ``key``, the place, kind and ``results`` (a DDL list)."""
    kinds = dict(rows.dtypes)
    kind = "" if "kind" not in kinds else ", kind string"
    schema = f"key {kinds[key]}, {', '.join(f'{c} bigint' for c in rule.place)}, kind string, {results}"
    told = rows.withColumnRenamed(key, "key").groupBy("key").transformWithState(Replay(rule), schema, mode, "None")
    return told.withColumnRenamed("key", key).drop(*([] if kind else ["kind"]))


def run(stream: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame | None:
    """Drain a stream with keyed state into the caller's folder; all results so far with their micro-batch, None if there never was one.

    A query started again on the same folder and checkpoint goes on; a micro-batch that runs twice replaces its own results.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        ran = write_batches(stream, mode, path, checkpoint)
    finally:
        spark.conf.set(STORE, before)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in stream.dtypes)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = ran or folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(f"{schema}, batch bigint").parquet(path) if there else None


# --- payments to credits ------------------------------------------------------------------------------------------

class FirstOfCharge(StatefulProcessor):
    """The payment that counts for a charge: the first that arrives, in one micro-batch the first by time. Kept for ever."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "event_id bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            first = min(rows, key=lambda r: (r.us, r.event_id))
            self.seen.update((first.event_id,))
            yield Row("user_id", "us", "event_id", "kind")(first.user_id, first.us, first.event_id, "pay")

    def close(self) -> None:
        pass


def ledger_rule(free_runs: int, lateness: int) -> Rule:
    """A user's entitlement: the bucket of the open run, free runs used, paid credits."""

    def step(state: list, row: dict) -> tuple[list, tuple]:
        bucket, used, credits = state
        kind = row["kind"]
        if kind == "pay":
            return [bucket, used, credits + 1], ("credited",)
        if kind == "start":
            if bucket is not None:
                return state, ("resumed",)
            if row["owner"]:
                return ["none", used, credits], ("owner",)
            if used < free_runs:
                return ["free", used + 1, credits], ("free",)
            if credits > 0:
                return ["paid", used, credits - 1], ("paid",)
            return state, ("needs_payment",)
        if bucket is None:
            return state, ("ignored",)
        if kind == "finish":
            return [None, used, credits], ("delivered",)
        back = {"none": (0, 0, "no_refund"), "free": (1, 0, "refunded_free"), "paid": (0, 1, "refunded_paid")}[bucket]
        return [None, used - back[0], credits + back[1]], (back[2],)

    def late(state: list, row: dict) -> tuple[list, tuple]:
        if row["kind"] == "pay":
            return [state[0], state[1], state[2] + 1], ("credited",)
        return state, ("late",)

    return Rule(("us", "event_id"), ["kind", "owner"], [None, 0, 0], step, late, ["outcome"], lateness)


def money_chain(payments: DataFrame, events: DataFrame, owners: DataFrame, lateness: int, free_runs: int = FREE_RUNS) -> DataFrame:
    """Raw payments and run events as they arrive -> the outcome of each start, credited payment, finish and abandon.

    Two keyed steps in one query, committed together: the first valid payment of each charge, then the user's ledger. Nothing is
    read but the new rows and their keys' states. payments: user_id, us, event_id, charge_id, currency, amount, payload. events:
    user_id, us, event_id, kind (payments among them are left out). owners: user_id, a small table.
    """
    first = valid_payments(payments).groupBy("charge_id").transformWithState(
        FirstOfCharge(), "user_id bigint, us bigint, event_id bigint, kind string", "Append", "None")
    runs = events.filter(F.col("kind").isin("start", "finish", "abandon")).select("user_id", "us", "event_id", "kind")
    both = first.unionByName(runs).join(owners.select("user_id").distinct().withColumn("owner", F.lit(True)), "user_id", "left")
    rows = both.withColumn("owner", F.coalesce("owner", F.lit(False)))
    return replayed(rows, "user_id", ledger_rule(free_runs, lateness), "outcome string", "Append")


# --- picks and messages, transcripts ------------------------------------------------------------------------------------

def keyed_choice(updates: DataFrame, lateness: int) -> DataFrame:
    """The version each message starts with: the pick since the last message or reset; ``late`` rows change nothing.

    updates: user_id, us, event_id, kind in (pick, message, reset), version.
    """
    def step(pending: str | None, row: dict) -> tuple[str | None, tuple]:
        taken = pending if row["kind"] == "message" else None
        return (row["version"] if row["kind"] == "pick" else None), (taken, False)

    rule = Rule(("us", "event_id"), ["kind", "version"], None, step, lambda pending, row: (pending, (None, True)), ["version", "late"], lateness)
    known = updates.filter((F.col("kind") != "pick") | F.col("version").isin(*PIPELINES))
    return replayed(known, "user_id", rule, "version string, late boolean", "Update")


def keyed_messages(messages: DataFrame, lateness: int) -> DataFrame:
    """The transcript as it grows: 'double_user' for a user message right after one, else 'user', 'asked' or 'said'.

    messages: session_id, id, kind (the role), marks (question marks). ``lateness`` counts in ids; the result of a row behind it is 'late'.
    """
    def step(before: str | None, row: dict) -> tuple[str, tuple]:
        role = row["kind"]
        verdict = ("double_user" if before == "user" else "user") if role == "user" else "asked" if row["marks"] else "said"
        return role, (verdict,)

    rule = Rule(("id", "place"), ["kind", "marks"], None, step, lambda before, row: (before, ("late",)), ["result"], lateness)
    return replayed(messages.withColumn("place", F.col("id")), "session_id", rule, "result string", "Update").drop("place")


# --- tool calls ---------------------------------------------------------------------------------------------------

FIRST = {version: pipeline[0][0] for version, pipeline in PIPELINES.items()}
PLACES = {version: {step[0]: pos for pos, step in enumerate(pipeline)} for version, pipeline in PIPELINES.items()}
START = {
    "asked": False, "spent": 0, "judged": True, "stopped": False, "turn": None, "offered": None, "version": None, "opened": False,
    "sizes": {}, "said": None, "slug": None, "adrs": 0, "finished_at": None, "reached_at": None,
}


def call_rule(initial: str, budget: int, lateness: int) -> Rule:
    """A session's tool calls with all guards; its state has a size of its own, whatever the number of calls."""

    def write(now: dict, row: dict) -> None:
        places = PLACES[now["version"]]
        pos, at, sizes = places.get(row["step_id"]), len(now["sizes"]), now["sizes"]
        if pos is None or row["bytes"] > MAX_ARTIFACT_BYTES or at < len(places) and pos > at:
            return
        if sum(size for p, size in sizes.items() if p != str(pos)) + row["bytes"] > MAX_SESSION_BYTES:
            return
        if pos == at:
            now["reached_at"] = row["seq"]
        now["sizes"] = {**sizes, str(pos): row["bytes"]}

    def step(state: dict, row: dict) -> tuple[dict, tuple]:
        now, name = dict(state), row["name"]
        if row["turn_id"] != now["turn"]:
            now["judged"], now["stopped"], now["turn"] = not now["asked"], False, row["turn_id"]
        runs = row["fine"] and not now["stopped"] and (now["judged"] or name == "assess_answer")
        was_open = now["asked"]
        if runs and name == "ask_question":
            now["asked"] = now["stopped"] = True
        elif runs and name == "assess_answer":
            picked = any(option in row["reply_words"] for option in now["offered"] or []) if row["reply_words"] else False
            closes = row["unknown"] or was_open and picked or row["said"] == "answer" or now["spent"] >= budget
            now["judged"], now["said"] = True, row["said"]
            now["asked"], now["spent"] = (False, 0) if closes else (was_open, now["spent"] + 1)
        elif runs and name == "set_version" and not now["opened"]:
            now["version"] = row["version"]
        elif runs and name == "set_product_name":
            now["slug"] = row["slug"]
        elif runs and name == "create_adr":
            now["adrs"] += 1
        elif runs and name == "finish":
            now["finished_at"] = row["seq"]
        elif runs and name == "save_artifact" and not was_open:
            write(now, row)
            now["opened"] = now["opened"] or bool(now["sizes"])
        if name == "ask_question" and row["fine"]:
            now["offered"] = row["option_words"]
        return now, ends(now)

    def ends(now: dict) -> tuple:
        pipeline, at = PIPELINES[now["version"]], len(now["sizes"])
        done = at >= len(pipeline) and now["finished_at"] is not None and now["finished_at"] > now["reached_at"]
        current = pipeline[at][0] if at < len(pipeline) else FINISH_MARKER
        return (now["version"], now["asked"], now["spent"], now["said"], now["slug"], now["adrs"], at, current, "finished" if done else "active", False)

    columns = ["seq", "turn_id", "name", "fine", "unknown", "reply_words", "option_words", "step_id", "version", "said", "slug", "bytes"]
    results = [part.split()[0] for part in ENDS.split(", ")]
    return Rule(("seq", "call_id"), columns, {**START, "version": initial}, step, lambda state, row: (state, (*ends(state)[:-1], True)), results, lateness, True)


ENDS = ("version string, open boolean, spent bigint, verdict string, slug string, adrs bigint, artifacts bigint, current_step string, status string, "
        "late boolean")


def live_replay(calls: DataFrame, lateness: int, initial: str = "lite", budget: int = 2) -> DataFrame:
    """The state of each session after the tool calls so far, given out whenever one of its calls arrives.

    calls: as for ``steps.tool_replay``. ``lateness`` counts in ``seq``; a call that is later changes nothing and comes as ``late``.
    """
    rows = steps.prepared_calls(calls).withColumn("call_id", F.col("seq"))
    told = replayed(rows, "session_id", call_rule(initial, budget, lateness), ENDS, "Update")
    return told.drop("call_id")


def session_ends(results: DataFrame) -> DataFrame:
    """The newest state of each session."""
    values = [c for c in results.columns if c not in ("session_id", "seq", "batch", "late")]
    kept = results.filter("not late")
    return kept.groupBy("session_id").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("session_id", "v.*")


FILE_ROWS = 50_000  # about as many rows of a micro-batch go into one file, so that many tasks write and read it


def in_files(df: DataFrame, folder: str, place: str, parts: int, mixed: float) -> DataFrame:
    """The rows as a stream of ``parts`` micro-batches, ordered by ``place`` but for a share ``mixed`` of a part's span.

    Each part is the same number of files, more of them the more rows there are; a micro-batch takes as many. Parts that fill
    fewer files get empty ones, so that no micro-batch reaches into the next part.
    """
    spark = df.sparkSession
    low, high, rows = df.agg(F.min(place), F.max(place), F.count(place)).first()
    span = max(1, (high or 0) - (low or 0) + 1)
    shift = (F.pmod(F.xxhash64(place, F.lit(11)), F.lit(1000)) / 1000 - 0.5) * mixed
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col(place) - F.lit(low or 0)) * parts / span + shift)))
    marked = df.withColumn("_part", part)
    files = max(1, -(-rows // (parts * FILE_ROWS)))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)

    def add(rows: DataFrame) -> None:
        rows.write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)

    for i in range(parts):  # one after the other, so that the source takes them in this order
        of_part = marked.filter(F.col("_part") == i).drop("_part")
        add(of_part.repartition(files) if files > 1 else of_part.coalesce(1))
        while files > 1 and len(spark.read.schema(schema).parquet(folder).inputFiles()) < files * (i + 1):
            add(spark.createDataFrame([], schema))
    return file_stream(spark, folder, schema, files)


def file_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
