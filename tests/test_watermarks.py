"""Streams behind a watermark: closed windows once, bursts, alerts that resolve, late payments kept."""

import pytest

from runlens.operators import ledger, telemetry
from runlens.plans.query import Source
from runlens.streaming import replay, watermarks

SMALL = "/root/testdata/sf0.001"
PAYMENTS = "user_id long, us long, event_id long, charge_id string, currency string, amount int, payload string"
METRICS = "app string, us long, cents long"
MINUTE = 60_000_000


def files(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return replay.file_stream(spark, folder, schema)


def rows_of(stream, tmp_path, name="out"):
    return sorted(tuple(r)[:-1] for r in replay.run(stream, "append", f"{tmp_path}/{name}", f"{tmp_path}/{name}-progress").collect())


def test_windows_close_once_and_late_rows_are_left_out(spark, tmp_path):
    parts = [[("a", 1 * MINUTE, 5), ("a", 2 * MINUTE, 0)], [("a", 200 * MINUTE, 7)], [("a", 400 * MINUTE, 7)], [("a", 3 * MINUTE, -9), ("a", 401 * MINUTE, 7)], [("a", 600 * MINUTE, 7)]]
    stream = files(spark, f"{tmp_path}/m", parts, METRICS)
    found = rows_of(watermarks.live_no_replicas(stream, 1, "1 hour"), tmp_path)
    assert found == [("a", (2 - back) * 60, 0) for back in (4, 3, 2, 1, 0)]


def test_alert_fires_and_resolves_over_batches(spark, tmp_path):
    values = [1, 1, 9, 9, 1, 1, 1, 1, 9, 1, 1, 1, 1, 1]
    rows = [("a", i * 5 * MINUTE, v) for i, v in enumerate(values)] + [("b", 0, 1), ("a", 1000 * MINUTE, 1)]
    rows.sort(key=lambda r: r[1])
    stream = files(spark, f"{tmp_path}/m", [rows[i : i + 3] for i in range(0, len(rows), 3)], METRICS)
    found = rows_of(watermarks.live_restarts(stream, 5, "5 minutes"), tmp_path)
    wanted = telemetry.alert_restarts(spark.createDataFrame(rows, METRICS), 5).collect()
    assert found == sorted(tuple(r) for r in wanted) and [r[3] for r in found] == ["fired", "resolved", "fired", "resolved"]


def test_bursts_with_pauses_of_exactly_the_gap(spark, tmp_path):
    schema = "service string, us long, status_code int, error string"
    rows = [("s", us, 503, None) for us in (0, 10_000_000, 20_000_000, 30_000_001, 40_000_000, 90_000_000)] + [("s", 15_000_000, 200, None), ("s", 10**12, 429, None)]
    rows.sort(key=lambda r: r[1])
    stream = files(spark, f"{tmp_path}/a", [rows[i : i + 2] for i in range(0, len(rows), 2)], schema)
    assert rows_of(watermarks.live_bursts(stream, 10, 2, "1 minute"), tmp_path) == [("s", 0, 20_000_000, 3), ("s", 30_000_001, 40_000_000, 2)]


@pytest.mark.parametrize("lateness_s", [3600, 10 * 365 * 86_400])
def test_no_valid_payment_is_in_neither_table(spark, tmp_path, lateness_s):
    payments = Source(spark, SMALL).payments_raw
    stream = replay.in_files(payments, f"{tmp_path}/p", "us", 6, 1.5)  # files overlap by more than an hour
    credited, late = watermarks.bounded_payments(stream, lateness_s, f"{tmp_path}/out", f"{tmp_path}/progress")
    valid = ledger.valid_payments(payments).select("charge_id", "event_id")
    taken, aside = ({r.event_id for r in t.collect()} for t in (credited, late))
    charges = {r.charge_id for r in credited.collect()}
    assert not taken & aside and bool(aside) == (lateness_s == 3600)
    assert all(r.event_id in taken | aside or r.charge_id in charges for r in valid.collect())
    if lateness_s > 3600:
        assert len(taken) == len(charges) == valid.select("charge_id").distinct().count()
    again = watermarks.bounded_payments(stream, lateness_s, f"{tmp_path}/out", f"{tmp_path}/progress")
    assert [t.count() for t in again] == [len(taken), len(aside)]


def test_a_charge_sent_again(spark, tmp_path):
    paid = lambda e, us, charge: (1, us, e, charge, "XTR", 100, "run:1")
    second = 1_000_000
    parts = [[paid(2, 11 * second, "a"), paid(1, 10 * second, "a"), paid(3, 12 * second, "b")], [paid(4, 13 * second, "a"), paid(5, 500 * second, "c")],
             [paid(6, 20 * second, "d"), paid(7, 501 * second, "c"), (1, 502 * second, 8, "e", "USD", 100, "run:1")]]
    stream = files(spark, f"{tmp_path}/p", parts, PAYMENTS)
    credited, late = watermarks.bounded_payments(stream, 100, f"{tmp_path}/out", f"{tmp_path}/progress")
    assert sorted(r.event_id for r in credited.collect()) == [1, 3, 5] and [r.event_id for r in late.collect()] == [6]


def test_an_app_without_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = replay.file_stream(spark, f"{tmp_path}/none", METRICS)
    assert replay.run(watermarks.live_no_replicas(stream), "append", f"{tmp_path}/out", f"{tmp_path}/progress") is None
