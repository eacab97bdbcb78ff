"""Mixing where many rows are alike: the cut falls inside them."""

from collections import Counter

import pytest

from runlens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("shares", [(400, 1000), (4000, 10), (1, 3000)])
def test_equal_rows_come_near_the_target(spark, shares):
    """One source is a single row many times over, beside sources of other sizes."""
    n, m = shares
    rows = [(1, "w " * 10, "a")] * n + [(i, "v " * 5, "b") for i in range(2, m)] + [(m + 7, "u " * 3, None)] * 50
    docs = table(spark, rows)
    made = mixing.mixing_report(docs).collect()
    assert len(made) == len(rows)
    taken, target, size = Counter(), {}, {}
    for r in made:
        source = "a" if r.doc_id == 1 else None if r.doc_id == m + 7 else "b"
        taken[source] += r.taken
        target[source], size[source] = r.target, r.size
        assert r.taken == r.times * r.size and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= size[s] / 2 + 1 for s in target)
    assert Counter(map(tuple, made)) == Counter(map(tuple, mixing.mixing_report(docs.repartition(3)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r[0] for r in mixed.select("doc_id").collect()) == Counter(
        {i: sum(r.times for r in made if r.doc_id == i) for i in {r.doc_id for r in made if r.times}})


def test_long_counts_are_dealt_in_blocks(spark):
    made = mixing.counted_out(spark.createDataFrame([("x", 5000), ("y", 1), ("z", 1024)], "k string, n long"), "n")
    assert made.groupBy("k").count().count() == 3
    assert sorted(r._i for r in made.where("k = 'x'").collect()) == list(range(1, 5001))
