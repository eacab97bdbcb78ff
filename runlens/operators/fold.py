"""Ordered folds of a small state, for rules that running values cannot express.

Rows are shuffled by key, sorted, and streamed through a small Python step: no group is ever held in memory.
Hot keys come in bounded segments (see ``ordered``) and are folded segment after segment, their state written to
the checkpoint folder in between; all hot keys advance together. Rules with few states compose instead
(``compose``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import SEGMENT, OrderedRows
from runlens.session import settle

STATE = "fold_state"
Step = Callable[[Any, Any], tuple[Any, tuple]]
"""(state, row) -> (new state, the row's results). The state is small and JSON-shaped."""


def by_group(batches: Iterator[pd.DataFrame], group: Sequence[str]) -> Iterator[tuple[tuple, Any]]:
    """(group, row) of sorted batches."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield tuple(getattr(row, name) for name in group), row


def in_batches(rows: Iterator[tuple], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    yield pd.DataFrame(held, columns=columns)


def ddl(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{name}` {kinds[name]}" for name in names)


def sorted_groups(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def fold_groups(df: DataFrame, group: list[str], order: list[str], start: Any, step: Step, results: str) -> DataFrame:
    """The results of each row; the last row of a group has the end state in ``STATE``, the others null.

    A group starts from the JSON in its column ``STATE``, or from ``start`` where that is null.
    """
    names = [*group, *order]
    columns = [*names, *[part.split()[0] for part in results.split(",")], STATE]
    begin = json.dumps(start)

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        owner, state, held = None, None, None
        for mine, row in by_group(batches, group):
            if mine != owner:
                if held is not None:
                    yield (*held, json.dumps(state))
                given = getattr(row, STATE)
                owner, state = mine, json.loads(given if isinstance(given, str) else begin)
            elif held is not None:
                yield (*held, None)
            state, found = step(state, row)
            held = (*(getattr(row, name) for name in names), *found)
        if held is not None:
            yield (*held, json.dumps(state))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(traced(batches), columns)

    return sorted_groups(df, group, order).mapInPandas(run, f"{ddl(df, names)}, {results}, {STATE} string")


def fold_rows(rows: OrderedRows, start: Any, step: Step, results: str) -> OrderedRows:
    """Key and order of each row with the ``results`` (a DDL list) of the step."""
    key, order = rows.key, rows.order
    fresh = F.lit(None).cast("string")
    usual = fold_groups(rows.usual.withColumn(STATE, fresh), key, order, start, step, results).drop(STATE)
    if rows.hot is None:
        return OrderedRows(usual, None, key, order, rows.most)
    # the r-th segment of every hot key is folded in round r; one row per hot key in the tables of states
    first = rows.hot.groupBy(*key).agg(F.min(SEGMENT).alias("_first"))
    hot = rows.hot.join(F.broadcast(first), key).withColumn("_round", F.col(SEGMENT) - F.col("_first"))
    rounds = hot.agg(F.coalesce(F.max("_round") + 1, F.lit(0))).first()[0]
    carried, folded = None, []
    for now in range(rounds):
        part = hot.filter(F.col("_round") == now)
        part = part.withColumn(STATE, fresh) if carried is None else part.join(F.broadcast(carried), key, "left")
        done = settle(fold_groups(part, key, [SEGMENT, *order], start, step, results))
        folded.append(done.drop(STATE))
        ended = done.filter(F.col(STATE).isNotNull()).select(*key, STATE)
        if carried is not None:  # a key without rows in this round keeps its state
            ended = ended.unionByName(carried.join(F.broadcast(ended.select(*key)), key, "left_anti"))
        carried = settle(ended)
    return OrderedRows(usual, reduce(DataFrame.unionByName, folded) if folded else None, key, order, rows.most)
