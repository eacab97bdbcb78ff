"""Streams with keyed state: many micro-batches, rows out of order, restarts, late rows."""

import os

import pytest
from pyspark.sql import functions as F

from runlens.operators import ledger, steps
from runlens.plans.query import Source
from runlens.streaming import live, replay

SMALL = "/root/testdata/sf0.001"
DAY = 86_400_000_000
EVENTS = "user_id long, us long, event_id long, kind string"
PAYMENTS = "user_id long, us long, event_id long, charge_id string, currency string, amount int, payload string"


@pytest.fixture(scope="module")
def source(spark):
    return Source(spark, SMALL)


@pytest.fixture(scope="module")
def batch_ledger(source):
    rows = ledger.entitlement_ledger(source.run_events, ledger.dedup_payments(source.payments_raw), source.owners)
    return {r.event_id: r.outcome for r in rows.collect()}


@pytest.fixture(scope="module")
def batch_ends(source):
    return sorted(map(tuple, steps.tool_replay(source.tool_calls).collect())), steps.tool_replay(source.tool_calls).columns


def outcomes(results):
    return {r.event_id: r.outcome for r in live.latest(results, ["event_id"]).collect()}


def files(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return replay.file_stream(spark, folder, schema)


def test_money_chain_in_any_order_equals_batch(spark, source, batch_ledger, tmp_path):
    """Files overlap by half their span; the lateness covers that."""
    span = source.run_events.agg(F.max("us") - F.min("us")).first()[0]
    payments = replay.in_files(source.payments_raw, f"{tmp_path}/p", "us", 6, 0.0)
    events = replay.in_files(source.run_events, f"{tmp_path}/e", "us", 6, 1.0)
    chain = replay.money_chain(payments, events, source.owners, lateness=span // 4)
    results = replay.run(chain, "append", f"{tmp_path}/out", f"{tmp_path}/progress")
    assert results.select("batch").distinct().count() >= 6
    assert outcomes(results) == batch_ledger
    assert replay.run(chain, "append", f"{tmp_path}/out", f"{tmp_path}/progress").count() == results.count()


def test_money_chain_goes_on_after_a_restart(spark, source, batch_ledger, tmp_path):
    streams = {}
    for name, table in (("p", source.payments_raw), ("e", source.run_events)):
        replay.in_files(table, f"{tmp_path}/all-{name}", "us", 5, 0.0)
        os.makedirs(f"{tmp_path}/{name}")
        streams[name] = replay.file_stream(spark, f"{tmp_path}/{name}", ", ".join(f"{n} {k}" for n, k in table.dtypes))
    batches = []
    for begin, end in ((0, 2), (2, 5)):
        for name in streams:
            folder = f"{tmp_path}/all-{name}"
            parts = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.stat(f"{folder}/{f}").st_mtime_ns)
            for part in parts[begin:end]:
                os.link(f"{folder}/{part}", f"{tmp_path}/{name}/{part}")
        chain = replay.money_chain(streams["p"], streams["e"], source.owners, lateness=DAY)
        results = replay.run(chain, "append", f"{tmp_path}/out", f"{tmp_path}/progress")
        batches.append({r.batch for r in results.select("batch").distinct().collect()})
    assert batches[0] < batches[1]
    assert outcomes(results) == batch_ledger


def test_late_money_is_credited_and_late_runs_are_told(spark, tmp_path):
    paid = lambda e, us, charge: (1, us, e, charge, "XTR", 100, "run:1")
    payments = files(spark, f"{tmp_path}/p", [[paid(90, 5, "a"), paid(91, 6, "a"), (1, 7, 92, "b", "USD", 100, "run:1")], [paid(93, 1, "a"), paid(94, 2, "c")], [paid(95, 3, "c")]], PAYMENTS)
    events = files(spark, f"{tmp_path}/e", [
        [(1, 100, 1, "start"), (1, 200, 2, "finish"), (1, 50_000, 3, "start")],  # 3 settles what is before 40,000
        [(1, 150, 4, "abandon"), (1, 49_000, 5, "finish"), (1, 60_000, 6, "start")],
        [(1, 61_000, 7, "abandon"), (1, 62_000, 8, "start")],
    ], EVENTS)
    owners = spark.createDataFrame([(10,)], "user_id long")
    results = replay.run(replay.money_chain(payments, events, owners, lateness=10_000), "append", f"{tmp_path}/out", f"{tmp_path}/progress")
    assert outcomes(results) == {
        90: "credited", 94: "credited", 1: "free", 2: "delivered", 3: "paid", 4: "late", 5: "ignored", 6: "resumed", 7: "refunded_paid", 8: "paid"}


def test_tool_calls_in_any_order_equal_batch(spark, source, batch_ends, tmp_path):
    wanted, columns = batch_ends
    calls = source.tool_calls
    span = calls.agg(F.max("seq") - F.min("seq")).first()[0]
    stream = replay.in_files(calls, f"{tmp_path}/calls", "seq", 6, 1.0)
    results = replay.run(replay.live_replay(stream, lateness=span // 4), "update", f"{tmp_path}/out", f"{tmp_path}/progress")
    assert results.select("batch").distinct().count() == 6 and results.filter("late").isEmpty()
    assert sorted(map(tuple, replay.session_ends(results).select(*columns).collect())) == wanted


def test_one_session_with_all_calls(spark, source, tmp_path):
    calls = source.tool_calls.withColumn("session_id", F.lit(1).cast("bigint"))
    columns = steps.tool_replay(calls).columns
    stream = replay.in_files(calls, f"{tmp_path}/calls", "seq", 5, 0.4)
    results = replay.run(replay.live_replay(stream, lateness=10**6), "update", f"{tmp_path}/out", f"{tmp_path}/progress")
    assert list(map(tuple, replay.session_ends(results).select(*columns).collect())) == list(map(tuple, steps.tool_replay(calls).collect()))


def test_a_call_behind_the_lateness_changes_nothing(spark, tmp_path):
    schema = "session_id long, turn_id long, seq long, name string, args string, reply string"
    parts = [[(1, 1, 10, "set_version", '{"version":"full"}', ""), (1, 2, 900, "create_adr", '{"title":"t","markdown":"m"}', "")],
             [(1, 1, 5, "set_version", '{"version":"spec_only"}', ""), (1, 2, 901, "set_product_name", '{"name":"Boat trip"}', "")]]
    stream = files(spark, f"{tmp_path}/calls", parts, schema)
    results = replay.run(replay.live_replay(stream, lateness=100), "update", f"{tmp_path}/out", f"{tmp_path}/progress")
    assert results.filter("late").select("seq").collect()[0].seq == 5
    end = replay.session_ends(results).first()
    assert (end.version, end.slug, end.adrs, end.current_step) == ("full", "boat-trip", 1, "F1")


def test_nothing_to_read(spark, tmp_path):
    os.makedirs(f"{tmp_path}/e")
    stream = replay.file_stream(spark, f"{tmp_path}/e", "session_id long, turn_id long, seq long, name string, args string, reply string")
    assert replay.run(replay.live_replay(stream, lateness=1), "update", f"{tmp_path}/out", f"{tmp_path}/progress") is None


def test_picks_out_of_order_and_over_a_restart(spark, tmp_path):
    schema = "user_id long, us long, event_id long, kind string, version string"
    parts = [[(1, 40, 4, "message", None), (1, 10, 1, "pick", "lite"), (1, 20, 2, "pick", "pro"), (2, 30, 3, "message", None)],
             [(1, 50, 5, "message", None), (2, 60, 6, "pick", "full"), (1, 30, 13, "pick", "spec_only")],
             [(2, 80, 8, "message", None), (2, 70, 7, "reset", None), (1, 90, 9, "pick", "full"), (1, 100, 10, "message", None), (1, 1000, 11, "message", None)],
             [(1, 995, 12, "pick", "lite"), (1, 95, 14, "pick", "lite")]]
    found = {}
    for i in range(0, 4, 2):
        stream = files(spark, f"{tmp_path}/u", parts[i : i + 2], schema)
        results = replay.run(replay.keyed_choice(stream, lateness=100), "update", f"{tmp_path}/out", f"{tmp_path}/progress")
        found[i] = {r.event_id: r.version for r in live.latest(results, ["event_id"]).filter("kind = 'message'").collect()}
    assert found[0] == {4: "spec_only", 5: None, 3: None}
    assert found[2] == {4: "spec_only", 5: None, 3: None, 8: None, 10: "full", 11: "lite"}
    assert [r.event_id for r in results.filter("late").collect()] == [14]


def test_transcripts_out_of_order(spark, source, tmp_path):
    rows = source.messages.select("session_id", "id", F.col("role").alias("kind"), F.lit(0).alias("marks"))
    from runlens.operators.dialogue import double_user_rows

    stream = replay.in_files(rows, f"{tmp_path}/m", "id", 5, 1.0)
    results = replay.run(replay.keyed_messages(stream, lateness=50), "update", f"{tmp_path}/out", f"{tmp_path}/progress")
    got = {(r.session_id, r.id) for r in live.latest(results, ["session_id", "id"]).filter("result = 'double_user'").collect()}
    assert got == {(r.session_id, r.id) for r in double_user_rows(source.messages).collect()} and got


def test_parts_of_many_files_stay_one_micro_batch_each(spark, tmp_path, monkeypatch):
    """Uneven parts, one of them empty, with more tasks than one: every micro-batch is one part, in order."""
    monkeypatch.setattr(replay, "FILE_ROWS", 25)
    places = [*range(500), 1200, 1201, *range(1600, 2000)]  # of parts of 400: 400, 100, none, 2, 400 rows
    rows = spark.createDataFrame([(p, f"t{p}") for p in places], "place long, text string").repartition(3)
    stream = replay.in_files(rows, f"{tmp_path}/in", "place", 5, 0.0)
    names = [n for n in os.listdir(tmp_path / "in") if n.startswith("part-")]
    assert len(names) == 5 * 8
    replay.run(stream, "append", f"{tmp_path}/out", f"{tmp_path}/progress")
    got = {int(n.split("=")[1]): sorted(r.place for r in spark.read.schema("place long, text string").parquet(f"{tmp_path}/out/{n}").collect())
           for n in os.listdir(tmp_path / "out") if n.startswith("batch=")}
    assert got == {i: [p for p in places if p // 400 == i] for i in range(5)}


def test_a_small_table_is_one_file_for_each_micro_batch(spark, tmp_path):
    replay.in_files(spark.range(100), f"{tmp_path}/in", "id", 5, 0.8)
    assert len([n for n in os.listdir(tmp_path / "in") if n.startswith("part-")]) == 5
