"""Split keys and plain windows must give the same running values; folds the same states."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import compose
from runlens.operators.fold import fold_rows
from runlens.operators.ordered import OrderedRows, last_seen, running_max, running_min, running_sum


def sample(spark, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        key = 0 if rnd.random() < 0.4 else rnd.randrange(1, 40)
        # many equal times, so that the second order column decides
        rows.append((key, rnd.randrange(20), i, rnd.choice([None, rnd.randrange(-9, 9)])))
    return rows, spark.createDataFrame(rows, "k int, t int, i int, v int")


def expected(rows):
    out = []
    for key in {r[0] for r in rows}:
        total, low, high, last = 0, None, None, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            before = last
            if r[3] is not None:
                total += r[3]
                low = r[3] if low is None else min(low, r[3])
                high = r[3] if high is None else max(high, r[3])
                last = r[3]
            out.append((key, r[2], total, low, high, before))
    return sorted(out)


def scanned(df):
    rows = OrderedRows.of(df, ["k"], ["t", "i"])
    rows = rows.scan(total=running_sum("v"), low=running_min("v"), high=running_max("v"))
    rows = rows.scan(prev=last_seen("v", before=True))
    return rows, sorted(map(tuple, rows.df.select("k", "i", "total", "low", "high", "prev").collect()),)


def test_plain_scan(spark):
    rows, df = sample(spark)
    ordered, got = scanned(df)
    assert ordered.hot is None
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in expected(rows)]


def test_split_scan(hot):
    rows, df = sample(hot, seed=2)
    ordered, got = scanned(df)
    assert ordered.hot is not None
    spans = ordered.hot.filter("k = 0").select("key_segment").distinct().count()
    assert spans > 1, "the hot key must span several partitions"
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in expected(rows)]


def test_attach_keeps_every_row(hot):
    rows, df = sample(hot, seed=3)
    names = hot.createDataFrame([(k, f"n{k}") for k in range(0, 40, 2)], "k int, name string")
    joined = OrderedRows.of(df, ["k"], ["t", "i"]).attach(names).df
    assert joined.count() == len(rows)
    assert joined.filter("name is null").select("k").distinct().filter("k % 2 = 0").count() == 0


def total_fold(df):
    def step(state, row):
        n = state["n"] * 3 % 1009 + row.i
        return {"n": n}, (n,)

    rows = OrderedRows.of(df, ["k"], ["t", "i"])
    return sorted(map(tuple, fold_rows(rows, {"n": 7}, step, "n bigint").df.collect()))


def test_fold_of_hot_keys_goes_on_over_segments(spark):
    rows, df = sample(spark, seed=4)
    df = df.drop("v")
    plain = total_fold(df)
    spark.conf.set("runlens.hotKeyRows", "12")
    try:
        assert total_fold(df) == plain
    finally:
        spark.conf.unset("runlens.hotKeyRows")
    assert len(plain) == len(rows)


def test_fold_keeps_states_over_removed_segments(hot):
    df = hot.range(200).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    rows = OrderedRows.of(df, ["k"], ["i"]).map(lambda d: d.filter("i < 20 or i >= 150"))

    def step(state, row):
        return {"n": state["n"] + 1}, (state["n"] + 1,)

    got = fold_rows(rows, {"n": 0}, step, "n bigint").df
    assert [r.n for r in got.orderBy("i").collect()] == list(range(1, 71))


def test_finite_states_of_hot_keys(spark):
    rows, df = sample(spark, seed=5)
    states = [(a, b) for a in range(5) for b in (False, True)]

    def after(a, b, i):
        return ((a + i) % 5, not b) if i % 3 else (b * 2, a > 2)

    table = [[states.index(after(a, b, i)) for a, b in states] for i in range(15)]
    wanted, held = [], {}
    for k, t, i, _ in sorted(rows):
        wanted.append((k, t, i, states.index(held.get(k, (0, False)))))
        held[k] = after(*held.get(k, (0, False)), i)

    def run():
        ordered = OrderedRows.of(df.withColumn("code", F.col("i") % 15).drop("v"), ["k"], ["t", "i"])
        return sorted(map(tuple, compose.states_before(ordered, "code", table, 0, "state").df.select("k", "t", "i", "state").collect()))

    assert run() == wanted
    spark.conf.set("runlens.hotKeyRows", "12")
    try:
        assert run() == wanted
    finally:
        spark.conf.unset("runlens.hotKeyRows")


def test_tail_limits_before_the_shuffle(spark):
    from runlens.operators.dialogue import transcript_tail

    messages = spark.range(2000).select(
        F.expr("id div 1000000").alias("session_id"), "id", F.lit("user").alias("role"), F.lit("x").alias("text")
    )
    tail = transcript_tail(messages, 40)
    assert tail.count() == 40 and tail.agg(F.min("id")).first()[0] == 1960
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(("chunk", "limit"), [(256, "1000"), (3, "1000"), (3, "30")])
def test_composed_transitions_equal_a_loop(spark, monkeypatch, chunk, limit):
    """Several levels of chunks, hot keys and null keys."""
    monkeypatch.setattr(compose, "CHUNK", chunk)
    table = [[1, 2, 3, 0], [0, 0, 2, 2], [3, 3, 3, 1], [0, 1, 2, 3]]
    rnd = random.Random(chunk)
    rows = [(key, at, rnd.randrange(4)) for key, n in ((1, 120), (2, 7), (None, 50), (4, 1)) for at in range(n)]
    wanted, state = [], {}
    for key, at, code in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        wanted.append((key, at, code, state.get(key, 2)))
        state[key] = table[code][state.get(key, 2)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "k long, at long, code int")
    spark.conf.set("runlens.hotKeyRows", limit)
    try:
        found = compose.states_before(OrderedRows.of(df, ["k"], ["at"]), "code", table, 2, "state").df.select("k", "at", "code", "state").collect()
    finally:
        spark.conf.unset("runlens.hotKeyRows")
    assert sorted(map(tuple, found), key=lambda r: (str(r[0]), r[1])) == wanted
