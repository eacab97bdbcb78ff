"""Streams over many micro-batches against the batch jobs on the same rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import ledger
from runlens.plans.query import Source
from runlens.sources.tables import SCHEMAS, append_messages, load_tables
from runlens.sources.workspace import artifact_route, load_workspace
from runlens.streaming import live

SMALL = "/root/testdata/sf0.001"
RUNS = "user_id long, us long, event_id long, kind string, owner boolean"


def files(spark, folder, parts, schema):
    """One file per part, oldest first; rows inside a part in random order."""
    for i, rows in enumerate(parts):
        rows = list(rows)
        random.Random(i).shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{i}")
        for name in os.listdir(f"{folder}/p{i}"):
            os.utime(f"{folder}/p{i}/{name}", (1_700_000_000 + i * 10,) * 2)
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(str(folder))
    )


def ledger_input(spark):
    s = Source(spark, SMALL)
    credited = ledger.dedup_payments(s.payments_raw)
    events = ledger.run_events(s.run_events, credited).withColumn("owner", F.col("user_id") % 10 == 0)
    rows = sorted(events.select("user_id", "us", "event_id", "kind", "owner").collect(), key=lambda r: r.us)
    batch = ledger.entitlement_ledger(s.run_events, credited, s.owners)
    return rows, {r.event_id: r.outcome for r in batch.collect()}


@pytest.mark.parametrize("limit", [None, "4"])
def test_ledger_over_batches_equals_batch(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(live.CarryLog, "COMPACT", 3)
    rows, wanted = ledger_input(spark)
    size = len(rows) // 5 + 1
    stream = files(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)], RUNS)
    if limit:
        spark.conf.set("runlens.hotKeyRows", limit)
    try:
        got = live.live_ledger(stream)
    finally:
        spark.conf.unset("runlens.hotKeyRows")
    assert got.select("batch").distinct().count() == 5
    assert {r.event_id: r.result for r in got.collect()} == wanted


def test_late_events_are_reported_not_applied(spark, tmp_path):
    first = [(1, 10, 1, "start", False), (1, 30, 3, "finish", False)]
    second = [(1, 20, 2, "abandon", False), (1, 40, 4, "start", False), (2, 5, 5, "start", False)]
    got = live.live_ledger(files(spark, tmp_path, [first, second], RUNS))
    assert {r.event_id: r.result for r in got.collect()} == {
        1: "free", 3: "delivered", 2: "late", 4: "needs_payment", 5: "free",
    }


def test_late_payments_are_credited_when_they_arrive(spark, tmp_path):
    parts = [
        [(1, 10, 1, "start", False), (1, 30, 3, "finish", False), (2, 10, 11, "start", False), (2, 30, 13, "finish", False)],
        [(1, 20, 2, "pay", False), (1, 40, 4, "start", False), (2, 20, 12, "pay", False)],
        [(2, 40, 14, "start", False), (2, 50, 15, "finish", False), (2, 60, 16, "start", False)],
        [(2, 55, 17, "pay", False), (2, 70, 18, "start", False)],
    ]
    got = live.live_ledger(files(spark, tmp_path, parts, RUNS))
    assert {r.event_id: r.result for r in got.collect()} == {
        1: "free", 3: "delivered", 2: "credited", 4: "paid", 11: "free", 13: "delivered", 12: "credited",
        14: "paid", 15: "delivered", 16: "needs_payment", 17: "credited", 18: "paid",
    }


def test_streams_read_folders_and_nothing(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    schema = ", ".join(f"{n} {k}" for n, k in source.dtypes)
    assert live.drained(live.table_stream(spark, str(tmp_path), "events", schema), "append", "folder").count() == source.count()
    assert live.drained(live.table_stream(spark, SMALL, "events", schema), "append", "file").count() == source.count()
    os.makedirs(f"{tmp_path}/none.parquet")
    empty = live.drained(live.table_stream(spark, str(tmp_path), "none", schema), "append", "none")
    assert empty.count() == 0 and empty.columns == [*source.columns, "batch"]


def test_picks_and_messages_over_batches(spark, tmp_path):
    parts = [
        [(1, 1, 1, "pick", "lite"), (1, 2, 2, "pick", "pro"), (2, 3, 3, "message", None)],
        [(1, 4, 4, "message", None), (1, 5, 5, "message", None), (2, 6, 6, "pick", "full")],
        [(2, 7, 7, "reset", None), (2, 8, 8, "message", None), (1, 9, 9, "pick", "full"), (1, 10, 10, "message", None)],
    ]
    schema = "user_id long, us long, event_id long, kind string, version string"
    got = live.live_choice(files(spark, tmp_path, parts, schema)).filter("kind = 'message'").collect()
    assert {r.event_id: r.result for r in got} == {3: None, 4: "lite", 5: None, 8: None, 10: "full"}


def test_lost_replies_over_batches(spark, tmp_path):
    parts = [
        [(1, 0, 0, "user", 0)],
        [(1, 0, 1, "user", 0), (1, 0, 2, "assistant", 1)],
        [(1, 0, 3, "user", 0), (2, 0, 0, "user", 0), (2, 0, 1, "assistant", 0), (3, 0, 0, "assistant", 0)],
    ]
    stream = files(spark, tmp_path, parts, "session_id long, us long, event_id long, kind string, marks int")
    log = live.live_messages(stream)
    sessions = spark.createDataFrame(
        [(1, "active", None), (2, "active", None), (3, "active", "open?")], "id long, status string, current_question string"
    )
    got = {tuple(r) for r in live.live_detectors(log, sessions).collect()}
    assert got == {("double_user", 1, 1), ("no_reply", 1, 3), ("nothing_asked", 2, 1)}


def test_payments_stay_single_over_batches(spark, tmp_path):
    schema = "event_id long, us long, user_id long, charge_id string, currency string, amount int, payload string"
    ok = lambda i, us, charge: (i, us, 7, charge, "XTR", 100, "run:7")
    parts = [
        [ok(1, 10, "a"), (2, 11, 7, "x", "USD", 100, "run:7"), (3, 12, 7, "y", "XTR", 5, "run:7")],
        [ok(4, 20, "a"), ok(5, 21, "b"), (6, 22, 7, "z", "XTR", 100, "run:999")],
        [ok(7, 5, "b")],
    ]
    results = live.drained(live.live_payments(files(spark, tmp_path, parts, schema)), "update", "payments")
    got = {r.charge_id: r.event_id for r in live.payments_of(results).collect()}
    assert got == {"a": 1, "b": 7}


def test_balances_of_the_literal_cases(spark):
    def run(*kinds):
        rows = [(i, i * 10, 1, k) for i, k in enumerate(kinds)]
        events = spark.createDataFrame(rows, "event_id long, us long, user_id long, kind string")
        owners = spark.createDataFrame([(99,)], "user_id long")
        got = ledger.ledger_balances(events, events.filter("kind = 'pay'"), owners).first()
        return got.free_used, got.paid_credits, got.open_bucket

    assert run("start", "abandon") == (0, 0, None)
    assert run("start", "abandon", "abandon") == (0, 0, None)
    assert run("start", "finish", "abandon") == (1, 0, None)
    assert run("start", "finish", "pay", "start", "abandon") == (1, 1, None)
    assert run("start", "start", "pay") == (1, 1, "free")
    assert run("start", "finish", "start", "pay", "start") == (1, 0, "paid")


def test_tables_and_workspace_as_files(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/db/{name}")
    rows = spark.sql("select 1L id, 2L session_id, 'user' role, 'hi' text, timestamp'2024-01-01' created_at")
    append_messages(rows, f"{tmp_path}/db/messages")
    append_messages(rows.withColumn("id", F.lit(2).cast("long")), f"{tmp_path}/db/messages")
    tables = load_tables(spark, f"{tmp_path}/db")
    assert tables["messages"].count() == 2 and tables["sessions"].count() == 0

    root = tmp_path / "work" / "my product"
    (root / "adr").mkdir(parents=True)
    for name in ("02-vision-story.md", "README.md", "adr/001-store.md", "adr/README.md"):
        (root / name).write_text("# " + name, encoding="utf-8")
    files_ = load_workspace(spark, str(tmp_path / "work"))
    got = {r.file_name: (r.product, r.kind, r.step_no, r.decision_no) for r in files_.collect()}
    assert got == {
        "02-vision-story.md": ("my product", "step", 2, None),
        "README.md": ("my product", "other", None, None),
        "adr/001-store.md": ("my product", "decision", None, 1),
        "adr/README.md": ("my product", "other", None, None),
    }
    fates = {r.file_name: r.fate for r in artifact_route(files_, "status").collect()}
    assert fates["02-vision-story.md"] == "moves" and fates["README.md"] == "unmapped"


def test_time_zone_plays_no_role(spark):
    job = Source(spark, SMALL)
    utc = job.run_events.agg(F.sum("us")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        assert job.run_events.agg(F.sum("us")).first()[0] == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_specs_as_text_files(spark, tmp_path):
    """Any number of decisions, equal numbers and a blank last body give one file each."""
    from runlens.operators.documents import assemble_spec
    from runlens.sources.workspace import write_spec_texts

    sessions = spark.createDataFrame([(1, "a", "lite"), (2, "a", "lite")], "id long, slug string, version string")
    artifacts = spark.createDataFrame([], "session_id long, step_id string, markdown string")
    adrs = [(1, 7 + i, i // 2, f"t{i}", f" body {i}\n" if i < 1499 else "  ") for i in range(1500)]
    adrs = spark.createDataFrame(adrs, "session_id long, id long, n long, title string, markdown string")
    specs = assemble_spec(sessions, artifacts, adrs).withColumn("file_name", F.lit("a-spec.md")).repartition(5)
    write_spec_texts(specs, str(tmp_path / "out"))
    (long,) = (tmp_path / "out").glob("part-*/1-a-spec.md")
    (short,) = (tmp_path / "out").glob("part-*/2-a-spec.md")
    head = "# a — Product Spec\n\n_Сгенерировано автоматически (версия: lite)._"
    bodies = [f"### ADR-{i // 2}: t{i}\n\nbody {i}" for i in range(1499)]
    assert long.read_text() == "\n\n".join([head, "## Решения (ADR)", *bodies, "### ADR-749: t1499"]) + "\n"
    assert short.read_text() == head + "\n"



def test_replay_of_a_whole_run(spark):
    import json

    from runlens.operators.steps import tool_replay

    calls = [
        (1, "ask_question", {"question": "Что важнее?", "options": ["скорость", "цена"]}, "начнём"),
        (1, "save_artifact", {"step_id": "L1", "markdown": "x"}, "начнём"),  # after a question: skipped
        (2, "save_artifact", {"step_id": "L1", "markdown": "x"}, "Скорость!"),  # not assessed yet: gated
        (2, "assess_answer", {"verdict": "offtopic"}, "Скорость!"),  # the option decides
        (2, "save_artifact", {"step_id": "L2", "markdown": "x"}, "Скорость!"),  # ahead
        (2, "save_artifact", {"step_id": "L1", "markdown": "x"}, "Скорость!"),
        (2, "set_version", {"version": "full"}, "Скорость!"),  # has an artifact
        (2, "finish", {}, "Скорость!"),  # not complete
        (3, "save_artifact", {"step_id": "L2", "markdown": "я" * 10_001}, "дальше"),  # too large
        (3, "save_artifact", {"step_id": "L2", "markdown": "y"}, "дальше"),
        (3, "save_artifact", {"step_id": "L3", "markdown": "y"}, "дальше"),
        (3, "save_artifact", {"step_id": "L4", "markdown": "y"}, "дальше"),
        (3, "create_adr", {"title": "t", "markdown": "m"}, "дальше"),
        (3, "set_product_name", {"name": "AI-рекрутер"}, "дальше"),
        (3, "assess_answer", {"verdict": "partial"}, "скорость"),  # nothing open: no option counts
        (3, "finish", {}, "дальше"),
    ]
    rows = [(7, turn, i, name, json.dumps(args), reply) for i, (turn, name, args, reply) in enumerate(calls)]
    df = spark.createDataFrame(rows, "session_id long, turn_id long, seq long, name string, args string, reply string")
    (end,) = tool_replay(df).collect()
    assert (end.version, end.status, end.current_step, end.artifacts, end.adrs) == ("lite", "finished", "_finish", 4, 1)
    assert (end.slug, end.verdict, end.open, end.spent) == ("ai-рекрутер", "partial", False, 1)
