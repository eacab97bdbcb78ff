"""Sharding by sampled splitters (SQL functions only): shards of near-equal bytes in one total order of the records.

Order: a 64-bit hash of doc_id and text, then a row key that tells repeated rows apart. A sample drawn with a
probability in proportion to a record's size gives quantile boundaries; records go to the ranges between them.
Ranges with more than ``rows_per_piece`` rows are subdivided by the row key. Counts per piece, summed up in
order, give every row its place and its bytes so far by one sort within its piece, and the shard is the n-th
part of all bytes in which the middle of the row lies.

Defined cases: a null text counts as empty (size 1); null and repeated ids are records like others; an empty table
gives an empty result; other columns pass through, and only the names ``size shard slot`` are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import settled, unpacked

RANGES = 128
SAMPLES_PER_RANGE = 32  # the sample has RANGES * SAMPLES_PER_RANGE keys, whatever the size of the table
ROWS_PER_PIECE = 100_000
SEED = 71


def utf8_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(keyed: DataFrame, total: int, ranges: int, per_range: int, seed: int) -> list:
    """Quantile boundaries of a size-weighted sample of the keys, at most ranges - 1."""
    wanted = ranges * per_range
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_key"), F.col("_tie")), 11) / F.lit(float(1 << 53))
    drawn = keyed.where(unit < chance).select("_key", "_tie")
    place = F.row_number().over(Window.orderBy("_key", "_tie"))
    every = drawn.withColumn("_n", place).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    step = F.ceil(F.col("_all") / F.lit(ranges))
    return [(r[0], r[1]) for r in every.where((F.col("_n") % step == 0) & (F.col("_n") < F.col("_all"))).select("_key", "_tie").collect()]


def range_of(bounds: list) -> Column:
    if not bounds:
        return F.lit(0)
    fixed = F.array(*(F.struct(F.lit(k).cast("long").alias("_key"), F.lit(t).cast("long").alias("_tie")) for k, t in sorted(bounds)))
    own = F.struct("_key", "_tie")
    return F.size(F.filter(fixed, lambda b: b < own))


def shard(docs: DataFrame, shards: int = 8, ranges: int = RANGES, per_range: int = SAMPLES_PER_RANGE,
          rows_per_piece: int = ROWS_PER_PIECE, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or only its columns in ``carry``) with ``size`` (UTF-8 bytes + 1), ``shard`` (0 to shards - 1) and ``slot`` (from 0 in each shard)."""
    names = [c for c in carry or docs.columns if c not in ("size", "shard", "slot")]
    keyed = settled(
        docs.select(F.struct(*(F.col(f"`{name}`") for name in names)).alias("_row"), utf8_size(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_key"),
                    F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("_tie")), "shard-rows")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    placed = keyed.withColumn("_range", range_of(splitters(keyed, total, ranges, per_range, seed)))
    counts = settled(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")), "shard-ranges")
    parts = counts.select("_range", F.ceil(F.col("_rows") / F.lit(rows_per_piece)).cast("long").alias("_parts"))
    cut = {r[0]: r[1] for r in parts.where("_parts > 1").collect()}  # at most one entry for each range
    pieces = F.create_map(*(F.lit(x) for pair in cut.items() for x in pair))[F.col("_range")] if cut else F.lit(1)
    placed = placed.withColumn("_piece", F.pmod(F.col("_tie"), F.coalesce(pieces, F.lit(1)).cast("long")))
    in_order = Window.orderBy("_range", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settled(
        placed.groupBy("_range", "_piece").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))
        .select("_range", "_piece", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_rows0"),
                F.coalesce(F.sum("_b").over(in_order), F.lit(0)).alias("_bytes0")), "shard-pieces")
    within = Window.partitionBy("_range", "_piece").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        placed.withColumn("_n", F.row_number().over(within) - 1).withColumn("_b", F.sum("size").over(within))
        .join(offsets, ["_range", "_piece"])
        .withColumn("_place", F.col("_rows0") + F.col("_n"))
        .withColumn("_middle", (F.col("_bytes0") + F.col("_b")) * 2 - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_middle") * shards / F.lit(2.0 * max(total, 1)))).cast("int"))
    )
    firsts = settled(rows.groupBy("shard").agg(F.min("_place").alias("_first")), "shard-firsts")
    return (
        rows.join(F.broadcast(firsts), "shard")  # one row for each shard
        .withColumn("slot", F.col("_place") - F.col("_first"))
        .select(*unpacked(names), "size", "shard", "slot")
    )


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per record its size, checksum, shard and slot; the law is near-equal bytes."""
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    rows = shard(docs.select("doc_id", "text", crc), shards, carry=["doc_id", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
