"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions (SQL functions only).

A source's size is the sum of its documents' sizes (words). The weights share the total; a source whose share exceeds
``max_epochs`` times its size is clamped there and the rest goes to the others by weight until none exceeds its cap.
Its documents are then taken floor(target / size) times, and once more those first in a seeded hash order, as
far as the remaining words reach. The cut in that order is found through a histogram over hash cells, so only one
cell of each source is ever sorted.

Rows alike in doc_id, source and text share a hash. Those in which the cut falls are taken as one group: as many of them as
fit are taken once more, which of them does not matter, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an empty table gives an empty result;
other columns pass through (of alike rows at the cut, one row stands for all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import WORD, packed, settled, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
CELL_BITS = 14  # hash cells of a source as a power of two; a hot source's cell holds that share of its documents
DRAW_BITS = 54
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with one row per source -> adds weight and target.

    The clamped sources are those with the smallest cap for their weight. After the first k of that order are
    clamped, the level of the others is what is left for each unit of weight; the answer is the first k whose
    level no remaining source's cap undercuts.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    rising = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    place = (F.row_number().over(in_order) - 1) % len(weights)
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("_free", F.col("_level") <= F.col("_ratio"))
        .withColumn("_final", F.min(F.when(F.col("_free"), F.struct("_ratio", "_level"))).over(everything)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap"))))
        .select("source", "source_size", "weight", "target")
    )


def repetition_plan(sized: DataFrame, seed: int = SEED, weights: Sequence[float] = WEIGHTS,
                    max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, size, _u) of all documents -> per source its target, whole repetitions and the hash cut for one more."""
    cell = cell_of(F.col("_u"))
    histogram = settled(sized.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words")), "mixing-cells")
    totals = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = (
        source_targets(totals, weights, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("wanted", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    targets = settled(targets, "mixing-targets")
    up = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    reached = (
        histogram.withColumn("upto", F.sum("words").over(up))
        .join(targets.select(F.col("source").alias("_s"), "wanted"), F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source")
        .agg(F.min(F.when(F.col("upto") > F.col("wanted"), F.col("cell"))).alias("cell"),
             F.max(F.when(F.col("upto") <= F.col("wanted"), F.col("upto"))).alias("below"))
    )
    plan = settled(
        targets.join(reached.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "source_size", "target", "whole", "cell",
                (F.col("wanted") - F.coalesce("below", F.lit(0))).alias("_left")), "mixing-plan")
    edge = sized.withColumn("cell", cell).join(
        plan.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "_left"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
    # alike rows are one group; the cut takes whole groups, then as many rows of the next one as fit, to the nearest row
    groups = edge.groupBy("source", "_u").agg(F.sum("size").alias("_words"), F.max("size").alias("size"), F.max("_left").alias("_left"))
    ordered = Window.partitionBy("source").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    run = groups.withColumn("_run", F.sum("_words").over(ordered)).withColumn("_fits", F.col("_run") - F.col("size") / 2 <= F.col("_left"))
    copies = F.floor((F.col("_left") - F.col("_run") + F.col("_words")) / F.col("size") + 0.5)
    cuts = run.groupBy("source").agg(
        F.max(F.when(F.col("_fits"), F.col("_u"))).alias("_cut"),
        F.min(F.when(~F.col("_fits"), F.struct("_u", copies.cast("long").alias("copies")))).alias("_next"))
    return settled(
        plan.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "source_size", "target", "whole", "cell", "_cut", F.col("_next._u").alias("_next"),
                F.coalesce("_next.copies", F.lit(0)).cast("long").alias("_copies")), "mixing-cuts")


def draw(name: str, seed: int) -> Column:
    """Where a document stands in the seeded order: random bits, the highest of them its cell."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    return F.shiftrightunsigned(key, 64 - DRAW_BITS).alias(name)


def cell_of(drawn: Column) -> Column:
    return F.shiftright(drawn, DRAW_BITS - CELL_BITS)


def with_repetitions(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (with source and _u) and for each row how often the mix takes it (``_times``) and its source's figures.

    ``_split``: of the rows alike to this one, ``_copies`` are taken once more (0: none, the row is not at a cut).
    """
    cell = cell_of(F.col("_u"))
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", F.col("cell").alias("_c"), "_cut", "_next", "_copies")
    extra = F.col("_c").isNull() | (cell < F.col("_c")) | ((cell == F.col("_c")) & F.coalesce(F.col("_u") <= F.col("_cut"), F.lit(False)))
    joined = docs.join(p, F.col("source").eqNullSafe(F.col("_s")), "left")
    fraction = F.col("target") > F.col("whole") * F.col("source_size")
    split = fraction & (cell == F.col("_c")) & (F.col("_u") == F.col("_next")) & (F.col("_copies") > 0)
    return joined.withColumn("_times", F.col("whole") + (fraction & extra).cast("int")).withColumn(
        "_split", F.coalesce(split, F.lit(False))).drop("_s", "whole", "_c", "_cut", "_next")


def counted_out(groups: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times, numbered ``_i`` from 1; in blocks, so that no long array is ever made."""
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / 1024))))
    first = F.col("_block") * 1024
    return blocks.withColumn("_i", F.explode(F.sequence(first + 1, F.least(F.col(count), first + 1024)))).drop("_block")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw("_u", seed))


def mix(docs: DataFrame, seed: int = SEED, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    names = docs.columns
    plan = repetition_plan(settled(sized(docs, seed).drop("doc_id"), "mixing-sizes"), seed, weights, max_epochs)
    rows = with_repetitions(packed(docs, "source", draw("_u", seed)), plan)
    taken = rows.where("_times > 0 and not _split").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    if plan.where("_copies > 0").isEmpty():
        return taken.select(*unpacked(names))
    alike = rows.where("_split").groupBy("source", "_u").agg(
        F.first("_row").alias("_row"), (F.sum("_times") + F.max("_copies")).cast("long").alias("_all"))
    return taken.select(*unpacked(names)).union(counted_out(alike, "_all").select(*unpacked(names)))


def mixing_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    narrow = settled(sized(docs, seed), "mixing-sizes")
    plan = repetition_plan(narrow, seed)
    rows = with_repetitions(narrow, plan)
    shown = ["doc_id", "size", "source_size", "target"]
    told = [*shown, (F.col("_times") * F.col("size")).alias("taken"), F.col("_times").alias("times")]
    if plan.where("_copies > 0").isEmpty():
        return rows.select(*told)
    alike = rows.where("_split").groupBy(*shown, "_times", "_copies").agg(F.count(F.lit(1)).alias("_all"))
    split = counted_out(alike, "_all").withColumn("_times", F.col("_times") + (F.col("_i") <= F.col("_copies")).cast("int"))
    return rows.where("not _split").select(*told).union(split.select(*told))
