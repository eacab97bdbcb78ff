"""MinHash near-duplicates with sequential Bayesian verification.

Each text becomes the set of its word shingles, with a MinHash signature in bands. Texts with the same set are one
class at once; the rest works on one representative of each class.

1. Candidates share a band. A bucket's members are paired with its hub only, never with one another.
2. The signatures of a candidate pair are compared batch by batch. With m of n values equal and no earlier knowledge, the
   probability that the similarity reaches the limit is the binomial tail P(Bin(n + 1, limit) <= m); a pair is pruned as
   soon as that falls below ``MISS``.
3. Survivors are verified on their full sets; only that makes a link.

Round one verifies each text with the hub it shares most bands with, round two the other hubs of texts that are still
apart, round three the members of a bucket that lie in different components, exactly and in blocks, by their differences from
their common hub (``across``). So no link that could join two components is left out, while the members of a joined group are
never paired with one another.

Defined cases: a text without words (or null) has an empty set and no link; a text with fewer words than a shingle is one
shingle; a null id is linked with nothing and is its own, null component; rows that share an id and a set are one
document; rows that share only the id are judged by their own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import (bloom, filled, for_workers, joined_ranks, mixed, packed, passing, ragged, settled, slices, span_hashes, unpacked,
                                unrepeated, whole_groups, word_hashes, words_of)

SHINGLE = 5
PERCENT = 80
BANDS = 32
ROWS = 5  # a pair at 0.8 shares no band with a probability of 3 in a million
BATCH = 32  # signature values compared at once
MISS = 1e-7
HASHES = BANDS * ROWS
TEXT_BYTES = 2 << 20
BLOCK = 512  # members of a bucket that one side of a block holds, about
COLUMNS = 4096  # shingles of a block counted at once
SALTS = 16
_DRAWN = np.random.default_rng(4242)
_FACTORS = _DRAWN.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _DRAWN.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.StringArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of the texts and their owners, ordered by owner."""
    words, firsts = words_of(filled(pc.ascii_lower(texts)))
    hashes = word_hashes(words)
    counts = np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = firsts[:-1][owner] + place
    shingles = span_hashes(hashes, starts, starts + np.minimum(counts[owner], size))
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    return owner[new], shingles[new]


def signatures(owner: np.ndarray, shingles: np.ndarray, texts: int) -> np.ndarray:
    """The low 16 bits of the smallest value of each hash function over each set; 0 for empty sets."""
    made = np.zeros((texts, HASHES), np.uint16)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                least = np.minimum.reduceat(shingles * _FACTORS[k] + _ADDENDS[k], starts)
                made[owner[starts], k] = (least >> np.uint64(20)).astype(np.uint16)
    return made


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, 128 bits that stand for the set, signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            owner, shingles = shingle_sets(filled(batch.column("text")), size)
            n = np.bincount(owner, minlength=batch.num_rows)
            sums = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
            if len(owner):
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for seed, s in enumerate(sums):
                    with np.errstate(over="ignore"):
                        s[owner[starts]] = np.add.reduceat(mixed(shingles, seed + 5), starts)
            made = signatures(owner, shingles, batch.num_rows)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), batch.num_rows, [None, pa.py_buffer(made)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), fixed],
                                             names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return for_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.cast(pa.binary(2 * HASHES)) if len(column) else column
    return np.frombuffer(b"".join(flat.to_pylist()), np.uint16).reshape(-1, HASHES) if len(column) else np.zeros((0, HASHES), np.uint16)


def banded(reps: DataFrame) -> DataFrame:
    """(rep, signature) -> bucket, rep: one row for each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("signature")).astype(np.uint64).reshape(batch.num_rows, BANDS, ROWS)
            flat = np.concatenate([np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :, None], (batch.num_rows, BANDS, 1)), values], axis=2).reshape(-1)
            at = np.arange(batch.num_rows * BANDS) * (ROWS + 1)
            buckets = span_hashes(mixed(flat), at, at + ROWS + 1) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], names=["bucket", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "bucket long, rep long")


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """Per batch the fewest equal values with which a pair may still reach the limit."""
    limit = percent / 100
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * limit**m * (1 - limit) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def surviving(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the signatures leave, by the batch-wise posterior bound."""
    bounds = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column("sa")), _matrix(batch.column("sb"))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, bound in enumerate(bounds):
                part = slice(i * BATCH, (i + 1) * BATCH)
                equal[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= bound]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    one = signed.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    two = signed.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, ..) with both texts, ``ta`` and ``tb``."""
    bits = bloom(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield unrepeated(batch.filter(pa.array(passing(bits, batch.column("doc_id").to_numpy().view(np.uint64)))))

    texts = for_workers(docs.select("doc_id", "text").where("doc_id is not null")).mapInArrow(wanted, "doc_id long, text string").repartition("doc_id")
    texts = texts.withColumn("_text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_key"])  # equal rows once
    one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", TEXT_BYTES):
            left, right = (shingle_sets(filled(batch.column(c)), size) for c in ("ta", "tb"))
            sizes = np.bincount(left[0], minlength=batch.num_rows) + np.bincount(right[0], minlength=batch.num_rows)
            owner, value = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            both = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
            common = np.bincount(owner[1:][both], minlength=batch.num_rows)
            linked = pa.array((100 * common >= percent * (sizes - common)) & (common > 0))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(linked), batch.column("b").filter(linked)], names=["a", "b"])

    return with_texts(pairs, docs).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> id, component: the smallest id reachable, for every id with a link (alternating stars)."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    before = None
    while True:
        # each id hands its smallest neighbour to its larger neighbours, then to the smaller ones
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).union(
            least.where("w < u").select("u", F.col("w").alias("v"))).where("u <> v").distinct()
        large = settled(large, "near-large")
        down = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).union(
            down.select("u", F.col("w").alias("v"))).where("u <> v").distinct()
        edges = settled(small, "near-small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of ``column``; an id without a link is its own."""
    known = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return rows.join(known, F.col(column) == F.col("_id"), "left").withColumn(name, F.coalesce("_component", column)).drop("_id", "_component")


def differences(members: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(rep, hub, ..) -> per member the shingles that only one of the two sets holds, with the set's size ``n``."""
    narrow = ["rep", "hub", "component", "main", "x_slices", "y_slices"]
    schema = ", ".join(f"{c} long" for c in (*narrow, "n")) + ", shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta", TEXT_BYTES), "tb", TEXT_BYTES):
            left, right = (shingle_sets(filled(batch.column(c)), size) for c in ("ta", "tb"))
            owner, value = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            same = np.zeros(len(owner) + 1, bool)
            same[1:-1] = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
            single = ~(same[1:] | same[:-1])
            owner, value = owner[single], value[single]
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
            sizes = pa.array(np.bincount(left[0], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in narrow), sizes, lists], names=[*narrow, "n", "shingles"])

    both = with_texts(members.withColumns({"a": F.col("rep"), "b": F.col("hub")}), docs)
    return both.select(*narrow, "ta", "tb").mapInArrow(run, schema)


def block_links(sides: np.ndarray, rep: np.ndarray, component: np.ndarray, n: np.ndarray, shingles: np.ndarray, at: np.ndarray,
                percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the x and the y members of a block that lie in different components, as (rep, smallest rep it is joined with)."""
    x, y = np.flatnonzero(sides), np.flatnonzero(~sides)
    d = np.diff(at)
    owner = np.repeat(np.arange(len(d)), d)
    on_x = sides[owner]
    known = np.intersect1d(shingles[on_x], shingles[~on_x])
    place = np.searchsorted(known, shingles)
    held = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == shingles) if len(known) else np.zeros(0, np.int64)
    common = np.zeros((len(x), len(y)), np.float32)
    row = np.zeros(len(d), np.int64)
    row[x], row[y] = np.arange(len(x)), np.arange(len(y))
    order = held[np.argsort(place[held], kind="stable")]
    edges = np.searchsorted(place[order], np.arange(0, len(known) + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = order[a:b]
        ones = [np.zeros((len(side), COLUMNS), np.float32) for side in (x, y)]
        for on, matrix in ((on_x[part], ones[0]), (~on_x[part], ones[1])):
            matrix[row[owner[part[on]]], place[part[on]] - i * COLUMNS] = 1
        common += ones[0] @ ones[1].T
    apart = d[x][:, None] + d[y][None, :] - 2 * common.astype(np.int64)
    total = n[x][:, None] + n[y][None, :]
    near = (100 * (total - apart) >= percent * (total + apart)) & (total > apart) & (component[x][:, None] != component[y][None, :])
    p, q = np.nonzero(near)
    ids, places = np.unique(rep, return_inverse=True)
    root = joined_ranks(ids, places[x[p]], places[y[q]])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def across(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, hub, rep, component) -> links between members of one bucket in different components, enough to join them.

    Each member x has been compared with its hub h. Let D(x) be the shingles that only one of x and h holds; sets x and y differ in the
    shingles that are in only one of D(x) and D(y), so the sizes of the sets, of D(x), D(y) and of what those share tell the
    similarity exactly, from few shingles. Members outside the hub's largest component (x) meet all members (y), in blocks of slices of
    each: a block is one group of at most about 2 ``BLOCK`` members, counts shared shingles by matrix products, and gives a
    row for each member that it joins with a smaller one, never the pairs. Hubs whose members are all joined take no part.
    """
    members = settled(members, "near-members")
    split = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    held = settled(members.join(split, "bucket", "left_semi").where("rep <> hub").select("rep", "hub", "component").distinct(), "near-held")
    each = held.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("times"))
    hubs = each.groupBy("hub").agg(F.max_by("component", F.struct("times", "component")).alias("main"), F.max("times").alias("most"), F.sum("times").alias("n"))
    hubs = settled(hubs.where("n > most").select(
        F.col("hub").alias("_hub"), "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("x_slices"), F.ceil(F.col("n") / BLOCK).alias("y_slices"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), "near-open-hubs")
    met = held.join(hubs, (F.col("hub") == F.col("_hub")) & (F.pmod(F.xxhash64("rep"), F.lit(SALTS)) == F.col("_salt")))
    sets = settled(differences(settled(met.select("rep", "hub", "component", "main", "x_slices", "y_slices"), "near-met"), docs, size), "near-differences")

    def sliced(count: str):
        return F.pmod(F.xxhash64("rep", F.lit(5)), F.col(count))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    kept = ["rep", "component", "n", "shingles"]
    x = sets.where("component <> main").select("hub", sliced("x_slices").alias("xs"), every("y_slices").alias("ys"), F.lit(True).alias("is_x"), *kept)
    y = sets.select("hub", every("x_slices").alias("xs"), sliced("y_slices").alias("ys"), F.lit(False).alias("is_x"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["hub", "xs", "ys"]):
            shingles, at = ragged(batch.column("shingles"))
            rep, component, n = (batch.column(c).to_numpy() for c in ("rep", "component", "n"))
            sides, found = batch.column("is_x").to_numpy(zero_copy_only=False), []
            for a, b in zip(starts, starts[1:]):
                if sides[a:b].any() and not sides[a:b].all():
                    found.append(block_links(sides[a:b], rep[a:b], component[a:b], n[a:b], shingles[at[a] : at[b]], at[a : b + 1] - at[a], percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

    keys = ["hub", "xs", "ys"]
    return x.union(y).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, set_a, set_b, component_id."""
    sketched = settled(sketches(docs, size), "near-sketches")
    same = ["n_shingles", "set_a", "set_b"]
    groups = settled(sketched.where("doc_id is not null and n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "near-groups")
    # ids are spread evenly, sets are not
    signed = settled(
        sketched.join(groups.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
        .dropDuplicates(["doc_id", *same]).select(F.col("doc_id").alias("rep"), "n_shingles", "signature"), "near-signed")
    buckets = settled(banded(signed), "near-buckets")
    hubs = settled(buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("bucket", "hub"), "near-hubs")
    live = settled(buckets.join(hubs, "bucket"), "near-live")  # buckets with more than one member
    pairs = settled(live.where("rep > hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "near-pairs")
    first = pairs.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    first = settled(first, "near-first")
    links = settled(verified(settled(surviving(first, signed, percent), "near-survivors"), docs, size, percent), "near-links")
    labels = components(links)

    def joined(apart: DataFrame, links: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Candidates in different components, pruned and verified, added to the links."""
        found = settled(surviving(settled(apart, f"near-{name}-apart"), signed, percent), f"near-{name}-survivors")
        if found.isEmpty():
            return links, labels
        more = settled(verified(found, docs, size, percent), f"near-{name}-links")
        links = links.union(more)
        return links, components(links) if not more.isEmpty() else labels

    others = pairs.join(first, ["a", "b"], "left_anti").select("a", "b")
    others = _labelled(_labelled(others, "a", labels, "ca"), "b", labels, "cb").where("ca <> cb").select("a", "b")
    links, labels = joined(others, links, labels, "second")
    more = settled(across(_labelled(live.select("bucket", "hub", "rep"), "rep", labels, "component"), docs, size, percent), "near-third-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    found = settled(_labelled(groups, "rep", labels, "component_id").drop("rep"), "near-components")
    named = found.select(*(F.col(c).alias(f"_{c}") for c in same), "component_id")
    return sketched.select("doc_id", *same).join(
        named, [F.col(c) == F.col(f"_{c}") for c in same], "left").select(
        "doc_id", *same, F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_report(docs: DataFrame, size: int = 2, percent: int = PERCENT) -> DataFrame:
    """Per document its set's size, its component and whether it stays."""
    return classes(docs, size, percent).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component: that with the smallest id. Those with a null id stay; columns unchanged.

    The nodes are texts under their id (64 bits of hash of both), not ids: where ids are shared, a text only goes if a
    document near to that text stays, and of rows with the same id and text one stays, the first by a hash of its other columns.
    """
    key = F.xxhash64("doc_id", "text")
    known = docs.where("doc_id is not null")
    found = classes(known.select(key.alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    nodes = known.groupBy(key.alias("_key")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("times"))
    named = settled(nodes.join(found, "_key"), "near-nodes")
    stays = named.groupBy("component_id").agg(F.min(F.struct("id", "_key")).alias("best")).select("component_id", F.col("best._key").alias("best"))
    gone = settled(named.join(stays, "component_id").where("_key <> best").select("_key"), "near-gone")
    again = settled(named.where("times > 1").select("_key"), "near-again")
    others = F.xxhash64(*(F.col(f"`{name}`").cast("string") for name in docs.columns))
    rows = packed(docs, F.when(F.col("doc_id").isNotNull(), key).alias("_key"), others.alias("_others")).join(gone, "_key", "left_anti")
    single = rows.join(again, "_key", "left_anti").select("_row")
    repeated = rows.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", "_others").alias("_row")).select("_row")
    return single.union(repeated).select(*unpacked(docs.columns))
