"""Ordered rules with a few states, by composing transitions.

A row is a function from states to states, and functions compose in any grouping. The rows of a key are cut by their place
into chunks; each chunk becomes one vector (where it leads from every state), the vectors of neighbouring chunks compose into vectors
of larger ones, and the known start is handed down again. Every array is bounded by ``CHUNK``, a key with a third of all rows
is spread like all others, and all of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import OrderedRows, hot_key_rows, joined_on, running_sum
from runlens.session import settle

CHUNK = 256


def states_before(rows: OrderedRows, code: str, table: Sequence[Sequence[int]], start: int, name: str) -> OrderedRows:
    """The rows with the state before each, as ``name``. ``table``: per code, the state that each state leads to."""
    rows = rows.scan(_n=running_sum("1L", before=True))
    most = rows.most
    usual = _filled(rows.usual, rows.key, code, table, start, name, min(most, hot_key_rows(rows.usual)))
    hot = None if rows.hot is None else settle(_filled(rows.hot, rows.key, code, table, start, name, most))
    return OrderedRows(usual, hot, rows.key, rows.order, most)


def looked_up(table: Sequence[Sequence[int]], code: Column, state: Column) -> Column:
    """table[code][state], the table being one constant array."""
    flat = F.split(F.lit(",".join(str(s) for states in table for s in states)), ",").cast("array<int>")
    return F.element_at(flat, code * len(table[0]) + state + 1)


def _filled(df: DataFrame, key: list[str], code: str, table, start: int, name: str, most: int) -> DataFrame:
    others = [c for c in df.columns if c not in (*key, "_n")]
    place = F.expr(f"_n div {CHUNK}").alias("_chunk")
    chunks = df.groupBy(*key, place).agg(F.array_sort(F.collect_list(F.struct("_n", *others))).alias("_rows"))
    step = lambda state, row: looked_up(table, row[code], state)
    if most > CHUNK:
        chunks = settle(chunks)  # read twice: for the vectors and for the rows
        vector = F.transform(_states(table), lambda s: F.aggregate("_rows", s, step)).alias("_vector")
        chunks = joined_on(chunks, _starts(chunks.select(*key, "_chunk", vector), key, table, start, -(-most // CHUNK)), [*key, "_chunk"])
    else:
        chunks = chunks.withColumn("_start", F.lit(start))
    return _spread(chunks, key, F.col("_rows"), step, name).select(*key, *[f"_row.{c}" for c in others], name)


def _states(table) -> Column:
    return F.sequence(F.lit(0), F.lit(len(table[0]) - 1))


def _spread(groups: DataFrame, key: list[str], rows: Column, step, name: str) -> DataFrame:
    """A row for each element of the groups' arrays, with the state before it."""
    before = F.aggregate(rows, F.array(F.col("_start")), lambda seen, row: F.concat(seen, F.array(step(F.element_at(seen, F.lit(-1)), row))))
    pairs = F.zip_with(rows, F.slice(before, 1, F.size(rows)), lambda row, state: F.struct(row.alias("_row"), state.alias(name)))
    return groups.select(*key, F.explode(pairs).alias("_pair")).select(*key, "_pair._row", f"_pair.{name}")


def _starts(vectors: DataFrame, key: list[str], table, start: int, most: int) -> DataFrame:
    """(key, _chunk, _vector) -> key, _chunk, _start: the state in which each chunk begins."""
    above = F.expr(f"_chunk div {CHUNK}").alias("_above")
    groups = vectors.groupBy(*key, above).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_vector"))).alias("_parts"))
    step = lambda state, part: F.element_at(part["_vector"], state + 1)
    if most > CHUNK:
        groups = settle(groups)
        vector = F.transform(_states(table), lambda s: F.aggregate("_parts", s, step)).alias("_vector")
        upper = groups.select(*key, F.col("_above").alias("_chunk"), vector)
        found = _starts(upper, key, table, start, -(-most // CHUNK)).withColumnRenamed("_chunk", "_above")
        groups = joined_on(groups, found, [*key, "_above"])
    else:
        groups = groups.withColumn("_start", F.lit(start))
    return _spread(groups, key, F.col("_parts"), step, "_begin").select(*key, F.col("_row._chunk").alias("_chunk"), F.col("_begin").alias("_start"))
