"""Running values per key, exact and balanced even when one key holds a third of all rows.

A plain window sends every row of a key to one task. ``OrderedRows`` keeps that plan for keys of bounded
size and treats the rest apart: the rows of hot keys are range-partitioned on (key, order), so a key spans
several partitions; each partition computes its own running values, and the totals of the partitions before
it are added as a carry. Sum, min, max and last are associative, so the result equals the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import settle

HOT_KEY_ROWS = 1_000_000
"""A key with more rows than this is split. The setting runlens.hotKeyRows overrides it."""

SEGMENT = "key_segment"


@dataclass(frozen=True)
class Running:
    """One running value: ``op`` over ``value``, up to this row or up to the row before."""

    op: str
    value: Column
    before: bool = False

    def total(self, order: Sequence[str]) -> Column:
        if self.op == "last":
            place = F.when(self.value.isNotNull(), F.struct(*order))
            return F.max_by(self.value, place)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.op](self.value)

    def local(self, window) -> Column:
        end = -1 if self.before else Window.currentRow
        framed = window.rowsBetween(Window.unboundedPreceding, end)
        if self.op == "last":
            return F.last(self.value, ignorenulls=True).over(framed)
        running = {"sum": F.sum, "min": F.min, "max": F.max}[self.op](self.value).over(framed)
        return F.coalesce(running, F.lit(0)) if self.op == "sum" else running

    def join(self, carry: Column, local: Column) -> Column:
        if self.op == "sum":
            return F.coalesce(carry, F.lit(0)) + local
        if self.op == "min":
            return F.least(carry, local)
        if self.op == "max":
            return F.greatest(carry, local)
        return F.coalesce(local, carry)


def running_sum(value, before: bool = False) -> Running:
    return Running("sum", _column(value), before)


def running_min(value, before: bool = False) -> Running:
    return Running("min", _column(value), before)


def running_max(value, before: bool = False) -> Running:
    return Running("max", _column(value), before)


def last_seen(value, before: bool = False) -> Running:
    """The latest value that is not null."""
    return Running("last", _column(value), before)


def _column(value) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def hot_key_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("runlens.hotKeyRows", str(HOT_KEY_ROWS)))


def joined_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which null equals null; a key may be null."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in names})
    same = [F.col(name).eqNullSafe(F.col(f"_right_{name}")) for name in names]
    return left.join(renamed, same, how).drop(*(f"_right_{name}" for name in names))


class OrderedRows:
    """Rows of many keys, totally ordered inside each key. ``order`` must be unique per key.

    ``most``: no key has more rows than this.
    """

    def __init__(self, usual: DataFrame, hot: DataFrame | None, key: list[str], order: list[str], most: int):
        self.usual, self.hot, self.key, self.order, self.most = usual, hot, key, order, most

    @classmethod
    def of(
        cls, df: DataFrame, key: Sequence[str], order: Sequence[str], bound: DataFrame | None = None
    ) -> OrderedRows:
        """Count the rows per key (one narrow, map-side combined pass) and split off hot keys if any.

        ``bound``: rows that are cheaper to count and at least as many per key.
        """
        key, order = list(key), list(order)
        limit = hot_key_rows(df)
        sizes = (df if bound is None else bound).groupBy(*key).agg(F.count("*").alias("_rows"))
        most = sizes.agg(F.max("_rows")).first()[0] or 0
        if most <= limit:
            return cls(df, None, key, order, most)
        sizes = settle(sizes.filter(F.col("_rows") > limit))
        # at most rows / limit keys, so the list is small by construction
        names = F.broadcast(sizes.select(*key))
        rows = sizes.agg(F.sum("_rows")).first()[0]
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(spread, math.ceil(rows / limit))
        hot = (
            joined_on(df, names, key, "left_semi")
            .repartitionByRange(parts, *key, *order)
            .withColumn(SEGMENT, F.spark_partition_id())
        )
        return cls(joined_on(df, names, key, "left_anti"), settle(hot), key, order, most)

    def scan(self, **running: Running) -> OrderedRows:
        """Add the running values as columns."""
        window = Window.partitionBy(*self.key).orderBy(*self.order)
        usual = self.usual.withColumns({name: r.local(window) for name, r in running.items()})
        return OrderedRows(usual, self._scan_hot(running), self.key, self.order, self.most)

    def _scan_hot(self, running: dict[str, Running]) -> DataFrame | None:
        if self.hot is None:
            return None
        inside = Window.partitionBy(*self.key, SEGMENT).orderBy(*self.order)
        earlier = (
            Window.partitionBy(*self.key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = self.hot.groupBy(*self.key, SEGMENT).agg(
            *[r.total(self.order).alias(name) for name, r in running.items()]
        )
        over = {"sum": F.sum, "min": F.min, "max": F.max}
        carries = totals.select(
            *self.key,
            SEGMENT,
            *[
                (F.last(name, ignorenulls=True) if r.op == "last" else over[r.op](name))
                .over(earlier)
                .alias(f"_carry_{name}")
                for name, r in running.items()
            ],
        )
        # the rows are grouped by (key, segment) for the window already, and no such group is large
        joined = joined_on(
            self.hot.withColumns({name: r.local(inside) for name, r in running.items()}), carries, [*self.key, SEGMENT]
        )
        done = joined.withColumns(
            {name: r.join(F.col(f"_carry_{name}"), F.col(name)) for name, r in running.items()}
        ).drop(*[f"_carry_{name}" for name in running])
        return settle(done)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> OrderedRows:
        """Apply a row-wise change that keeps the key and order columns."""
        hot = None if self.hot is None else change(self.hot)
        return OrderedRows(change(self.usual), hot, self.key, self.order, self.most)

    def attach(self, table: DataFrame) -> OrderedRows:
        """Left join a table with one row per key."""
        usual = self.usual.join(table, self.key, "left")
        hot = None
        if self.hot is not None:
            wanted = F.broadcast(self.hot.select(*self.key).distinct())
            few = table.join(wanted, self.key, "left_semi")
            hot = self.hot.join(F.broadcast(few), self.key, "left")
        return OrderedRows(usual, hot, self.key, self.order, self.most)

    @property
    def df(self) -> DataFrame:
        if self.hot is None:
            return self.usual
        return self.usual.unionByName(self.hot.drop(SEGMENT))
