"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

1. Vectors that are alike bit for bit, with one label, are one node; all else is done on nodes.
2. A node's vector is rotated by three rounds of random signs and a fast Hadamard transform; a cross-polytope hash is the
   coordinate of largest absolute value with its sign. A table's code is ``k`` such hashes. The code is the node's own bucket;
   ``PROBES`` more buckets differ in the one hash whose second best coordinate is nearest to the best.
3. Two nodes are candidates if one's own bucket is an own or a probed bucket of the other, in any table. All candidates of a bucket are
   verified by their cosine in double precision, block by block; a pair that meets more than once counts where it meets first.
   A block gives one row for each node with links (their number and the smallest node it is joined with), never the pairs.

The codes grow with the logarithm of the largest label, so that chance meetings stay rare; the number of tables follows
from the measured chance that a pair at exactly the limit meets in one table (``REACH``). A pair at the limit is missed with a
probability of about 1 in 10,000, closer pairs less often. Buckets have no cap: large ones are cut into slices that meet pairwise
in separate tasks.

Defined cases: vectors with a null label, without components, zero, or with null or non-finite components link with nothing;
vectors of different lengths link with nothing; repeated rows are vectors of their own, linked with one another; a null
id is taken as larger than all ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import joined_ranks, mixed, ragged, settled, whole_groups
from runlens.llm.near import components

LIMIT = 0.98
PROBES = 2
REACH = 0.81  # least chance, measured, that a pair at the limit meets in a table of two hashes
MISS = 1e-4
SLICE = 1024  # nodes of a bucket that one side of a block holds, about
SALTS = 16
PAIRS = 1 << 20  # pairs counted together, about


def shape(largest: int, width: int) -> tuple[int, int]:
    """(hashes in a code, tables) for labels of up to ``largest`` nodes with ``width`` components."""
    k = max(2, ceil(log(4 * (1 + PROBES) * max(largest, 1)) / log(2 * padded(width))))
    return k, ceil(log(MISS) / log(1 - REACH ** (k / 2)))


def padded(width: int) -> int:
    return max(8, 1 << (width - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x


def codes(x: np.ndarray, group: np.ndarray, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their group keys -> own buckets (rows, tables) and probed ones (rows, tables, PROBES)."""
    rows, width = x.shape
    full = np.zeros((rows, padded(width)))
    full[:, :width] = x
    scale = 1 / np.sqrt(full.shape[1])
    signs = np.random.default_rng(77).choice([-1.0, 1.0], size=(tables, k, 3, full.shape[1]))
    own, probed = np.zeros((rows, tables), np.uint64), np.zeros((rows, tables, PROBES), np.uint64)
    at = np.arange(rows)
    with np.errstate(over="ignore"):
        for t in range(tables):
            first, second, gap = (np.zeros((rows, k), dtype) for dtype in (np.uint64, np.uint64, float))
            for j in range(k):
                turned = full
                for round_signs in signs[t, j]:
                    turned = hadamard(turned * round_signs) * scale
                size = np.abs(turned)
                best = size.argmax(axis=1)
                top = size[at, best]
                size[at, best] = -1
                next_best = size.argmax(axis=1)
                first[:, j] = 2 * best + (turned[at, best] < 0)
                second[:, j] = 2 * next_best + (turned[at, next_best] < 0)
                gap[:, j] = top - size[at, next_best]
            parts = np.stack([mixed(first[:, j], 31 + j) for j in range(k)], axis=1)
            base = mixed(group, 11 + t) + parts.sum(axis=1, dtype=np.uint64)
            own[:, t] = mixed(base)
            order = np.argsort(gap, axis=1, kind="stable")
            for p in range(PROBES):
                j = order[:, p]
                swapped = np.zeros(rows, np.uint64)
                for which in range(k):
                    hit = j == which
                    swapped[hit] = mixed(second[hit, which], 31 + which)
                probed[:, t, p] = mixed(base - parts[at, j] + swapped)
    return own, probed


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in two steps so that no square overflows."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def entries(nodes: DataFrame, k: int, tables: int) -> DataFrame:
    """(node, group, embedding) -> bucket, node, probe, table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = ragged(batch.column("embedding"))
            widths = np.diff(at)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                x = unit(flat[at[rows][:, None] + np.arange(width)])
                own, probed = codes(x, batch.column("group").to_numpy()[rows].view(np.uint64), k, tables)
                buckets = np.concatenate([own[:, :, None], probed], axis=2)
                places = 1 + PROBES
                yield pa.RecordBatch.from_arrays([
                    pa.array(buckets.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy()[rows], tables * places)),
                    pa.array(np.tile(np.arange(places) > 0, len(rows) * tables)),
                    pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), places), len(rows)))], names=["bucket", "node", "probe", "table"])

    return nodes.select("node", "group", "embedding").mapInArrow(run, "bucket long, node long, probe boolean, table int")


def blocks(placed: DataFrame, slice_size: int) -> DataFrame:
    """The entries of buckets where something meets, as bucket, low, high, slice, node, probe, table: blocks of two slices at most."""
    live = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("own")).where("n > 1 and own > 0")
    live = settled(live.select(F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / slice_size).cast("int").alias("slices"),
                               F.explode(F.sequence(F.lit(0), F.when(F.col("n") > slice_size, SALTS - 1).otherwise(0))).alias("_salt"),
                               (F.col("n") > slice_size).alias("_large")), "vector-buckets")
    small = live.where("not _large").select("_bucket", "slices")
    large = live.where("_large").select("_bucket", "slices", "_salt")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    met = placed.join(small, F.col("bucket") == F.col("_bucket")).select("bucket", "slices", "node", "probe", "table").union(
        placed.join(large, (F.col("bucket") == F.col("_bucket")) & (salt == F.col("_salt"))).select("bucket", "slices", "node", "probe", "table"))
    own = met.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(3)), F.col("slices")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return spread.select("bucket", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "node", "probe", "table")


def first_meetings(p: np.ndarray, q: np.ndarray, table: np.ndarray, probe: np.ndarray, node: np.ndarray, own: np.ndarray,
                   probed: np.ndarray) -> np.ndarray:
    """Which of the pairs (p, q), met in ``table``, have met in no earlier table and count here, not in the other's own bucket."""
    fresh = np.ones(len(p), bool)

    def reaches(a: np.ndarray, b: np.ndarray, t) -> np.ndarray:
        return (probed[a, t] == own[b, t][:, None]).any(axis=1)

    for t in range(int(table.max(initial=0))):
        left = np.flatnonzero(fresh & (table > t))
        a, b = p[left], q[left]
        fresh[left] = ~((own[a, t] == own[b, t]) | reaches(a, b, t) | reaches(b, a, t))
    guest, host = np.where(probe[p], p, q), np.where(probe[p], q, p)
    both = (probe[p] | probe[q]) & reaches(host, guest, table)
    return fresh & ~(both & (node[host] > node[guest]))


def linked(met: DataFrame, nodes: DataFrame, k: int, tables: int, limit: float) -> DataFrame:
    """Blocks and nodes -> node, links, root: what blocks add to a node's links, and the smallest node it is joined with there."""
    schema = "node long, links long, root long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["bucket", "low", "high"]):
            flat, at = ragged(batch.column("embedding"))
            node, size, group, slices, low, high, table = (batch.column(c).to_numpy() for c in ("node", "size", "group", "slice", "low", "high", "table"))
            probe = batch.column("probe").to_numpy(zero_copy_only=False)

            def counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                """The pairs of rows of some blocks, each once, added up; codes are made once for each node among them."""
                p, q = (np.concatenate(c) for c in zip(*pairs))
                names, first, place = np.unique(node, return_index=True, return_inverse=True)
                wanted = np.unique(place[np.concatenate([p, q])])
                own, probed = np.zeros((len(names), tables), np.uint64), np.zeros((len(names), tables, PROBES), np.uint64)
                widths = np.diff(at)[first[wanted]]
                for width in np.unique(widths):
                    some = wanted[widths == width]
                    x = unit(flat[at[first[some]][:, None] + np.arange(width)])
                    own[some], probed[some] = codes(x, group[first[some]].view(np.uint64), k, tables)
                fresh = first_meetings(p, q, table[p], probe, node, own[place], probed[place])
                p, q = p[fresh], q[fresh]
                used, ends = np.unique(np.concatenate([p, q]), return_inverse=True)
                p, q = ends[: len(p)], ends[len(p) :]
                links = np.bincount(p, size[used[q]], len(used)) + np.bincount(q, size[used[p]], len(used))
                root = joined_ranks(node[used], p, q)
                return pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(links.astype(np.int64)), pa.array(np.sort(node[used])[root])],
                                                  names=["node", "links", "root"])

            held, waiting = [], 0
            for a, b in zip(starts, starts[1:]):
                if b - a < 2 or probe[a:b].all() or at[b] - at[a] != (b - a) * (at[a + 1] - at[a]):
                    continue
                x = unit(flat[at[a] : at[b]].reshape(b - a, -1))
                near = x @ x.T >= limit
                near &= ~(probe[a:b, None] & probe[None, a:b]) & (group[a:b, None] == group[None, a:b])
                if low[a] == high[a]:
                    p, q = np.nonzero(np.triu(near, 1))
                else:
                    inside = slices[a:b] == low[a]
                    p, q = np.nonzero(near & inside[:, None] & ~inside[None, :])
                if not len(p):
                    continue
                held.append((p + a, q + a))
                waiting += len(p)
                if waiting > PAIRS:
                    yield counted(held)
                    held, waiting = [], 0
            if held:
                yield counted(held)

    held = nodes.select(F.col("node").alias("_node"), "group", "size", "embedding")
    rows = met.join(held, F.col("node") == F.col("_node")).drop("_node")
    keys = ["bucket", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def vector_links(rows: DataFrame, limit: float = LIMIT, slice_size: int = SLICE) -> DataFrame:
    """(vec_id, embedding, label) -> per row vec_id, n_links, component_id, kept."""
    values = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("_v", lambda v: v != 0)
    keyed = rows.select("vec_id", "label", values.alias("_v")).withColumn("_sound", F.coalesce(sound, F.lit(False)))
    keys = {"group": F.xxhash64("label", F.size("_v")), "key_a": F.xxhash64("_v"), "key_b": F.xxhash64(F.lit(1), "_v")}
    good = keyed.where("_sound").select("vec_id", F.col("_v").alias("embedding"), *(c.alias(n) for n, c in keys.items()))
    classes = good.groupBy("group", "key_a", "key_b").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
    nodes = settled(classes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"))
    largest = sizes.agg(F.max("n").alias("n"), F.min("width").alias("width")).first()
    k, tables = shape(largest.n or 1, largest.width or 1)
    met = blocks(settled(entries(nodes, k, tables), "vector-entries"), slice_size)
    found = settled(linked(met, nodes, k, tables, limit), "vector-links")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_node")
    told = nodes.select("node", "group", "key_a", "key_b", "least", "size").join(counted, F.col("node") == F.col("_node"), "left").join(
        joined, F.col("node") == F.col("id"), "left").where("links is not null or size > 1")
    told = settled(told.withColumn("component", F.coalesce("component", "node")), "vector-told")
    roots = told.groupBy("component").agg(F.min("least").alias("root")).withColumnRenamed("component", "_component")
    told = told.join(roots, F.col("component") == F.col("_component")).select(
        *(F.col(c).alias(f"_{c}") for c in keys), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "root",
        # one row for a single vector, one for each salt for many alike
        F.explode(F.when(F.col("size") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
            F.array(F.pmod(F.xxhash64("least"), F.lit(SALTS)).cast("int")))).alias("_salt"))
    marked = keyed.select("vec_id", "_sound", *(c.alias(n) for n, c in keys.items()), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    same = [F.col(c) == F.col(f"_{c}") for c in (*keys, "salt")]
    full = marked.join(told, [F.col("_sound"), *same], "left")
    component = F.coalesce("root", "vec_id")
    return full.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
with recursive sound as (
  select row_number() over () as place, vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as one, b.vec_id as two from sound a join sound b
  on a.label = b.label and len(a.v) = len(b.v) and a.place <> b.place and list_cosine_similarity(a.v, b.v) >= 0.98
),
reach as (
  select vec_id, vec_id as root from embeddings union select l.one, r.root from links l join reach r on l.two = r.vec_id
),
roots as (select vec_id, min(root) as component_id from reach group by vec_id),
degrees as (select one, count(*) as n from links group by one)
select e.vec_id, coalesce(d.n, 0) as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join roots r on r.vec_id = e.vec_id left join degrees d on d.one = e.vec_id
"""
