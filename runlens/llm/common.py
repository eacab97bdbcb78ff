"""What the operators share: written intermediate tables, bounded Arrow batches and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import fresh_path

BATCH_BYTES = 4 << 20  # text that one step in a Python worker handles at once; a longer text is a step of its own
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
FILTER_BITS = 25  # of a Bloom filter, as a power of two: 4 MB whatever the data
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame, *needed) -> DataFrame:
    """Each row as one column ``_row``, beside the columns that are needed: no name in the table can clash."""
    return docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("_row"), *needed)


def unpacked(names: list[str]) -> list:
    return [F.col("_row").getField(name).alias(name) for name in names]


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and sizes are known."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def for_workers(rows: DataFrame) -> DataFrame:
    """``rows``, in a session that hands them to workers in batches of about ``BATCH_BYTES``; a longer text is a batch of its own.

    Spark's own 64 MB are held several times over by every task, outside the heap in buffers that grow by doubling, and again
    in the worker. Spark reads the setting when rows are asked for, so it stays on; one that the caller has made is left alone.
    """
    conf = rows.sparkSession.conf
    if conf.get(ARROW_BYTES, None) is None:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return rows


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each; no text is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes.astype(np.int64)) // limit
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)
        pa.default_memory_pool().release_unused()  # a worker is used again and again, its idle memory counts


def unrepeated(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with one row of those alike in doc_id and text; doc_id is never null.

    Only texts whose id comes up again in the batch are hashed, one at a time.
    """
    ids = batch.column("doc_id").to_numpy()
    _, first, again, times = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    if len(first) == len(ids):
        return batch
    texts, seen, kept = batch.column("text"), set(), []
    for i in range(len(ids)):
        if times[again[i]] > 1:
            text = texts[i].as_buffer() if texts[i].is_valid else None
            key = (ids[i], text if text is None else blake2b(text, digest_size=16).digest())
            if key in seen:
                continue
            seen.add(key)
        kept.append(i)
    return batch.take(pa.array(kept))


def filled(texts: pa.Array) -> pa.StringArray:
    """Texts without nulls, from offset 0, so that their buffers can be read as they are."""
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])


def bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a filled array."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts in order, and for each text the place of its first word (one more at the end).

    A word is a run of characters other than the six ASCII white-space characters.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "")
    kept = owner[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.searchsorted(kept, np.arange(len(texts) + 1))


# --- hashes ---------------------------------------------------------------------------------------------------

_DRAWN = np.random.default_rng(20240613)
_BYTE = _DRAWN.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


BLOCK_BITS = 20
BLOCK = 1 << BLOCK_BITS  # values hashed at once; the tables below have this size whatever the texts


def _running(factor: np.uint64, size: int) -> np.ndarray:
    made = np.full(size, factor)
    made[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(made, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, up to one block."""
    return _running(_STEP, BLOCK), _running(_BACK, BLOCK)


@lru_cache(maxsize=1)
def _block_powers(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for whole blocks."""
    return tuple(_running(np.uint64(pow(int(f), BLOCK, 2**64)), blocks) for f in (_STEP, _BACK))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Every bit of each 64-bit value spread over all bits."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal runs of values have equal hashes."""
    forth, back = _powers()
    jumps, returns = _block_powers((len(values) >> BLOCK_BITS) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, jump in enumerate(jumps):
            at = i << BLOCK_BITS
            part = values[at : at + BLOCK]
            np.cumsum(part * forth[: len(part)] * jump, dtype=np.uint64, out=sums[at + 1 : at + 1 + len(part)])
            sums[at + 1 : at + 1 + len(part)] += sums[at]
        inverse = back[starts & (BLOCK - 1)] * returns[starts >> BLOCK_BITS]
        return mixed((sums[ends] - sums[starts]) * inverse + (ends - starts).astype(np.uint64))


def text_hashes(texts: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each text, alike on every machine; about a block of bytes is expanded at a time."""
    raw, offsets = bytes_of(texts)
    made, first = np.zeros(len(texts), np.uint64), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        if offsets[last] - offsets[first] > BLOCK:
            made[first] = _long_hash(raw[offsets[first] : offsets[last]])
        else:
            at = offsets[first : last + 1] - offsets[first]
            made[first:last] = span_hashes(_BYTE[raw[offsets[first] : offsets[last]]], at[:-1], at[1:])
        first = last
    return made


def _long_hash(raw: np.ndarray) -> np.uint64:
    """The hash of one text of more than a block: the sums of its blocks, put together from the last to the first."""
    forth, _ = _powers()
    total, jump = 0, pow(int(_STEP), BLOCK, 2**64)
    with np.errstate(over="ignore"):
        for at in range((len(raw) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            part = _BYTE[raw[at : at + BLOCK]]
            total = (total * jump + int(np.sum(part * forth[: len(part)], dtype=np.uint64))) % 2**64
    return mixed(np.array([(total + len(raw)) % 2**64], np.uint64))[0]


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """The hash of each word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return text_hashes(filled(coded.dictionary))[coded.indices.to_numpy()]


# --- a filter of fixed size ---------------------------------------------------------------------------------------

def _places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(mixed(hashes, seed) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for seed in (1, 2)]


def bloom(keys: DataFrame, column: str):
    """A broadcast Bloom filter over a column of 64-bit keys: 2 ** FILTER_BITS bits, whatever their number.

    It saves work before an exact join; the more keys, the more it lets through, so no result depends on it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column("key").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(np.int32(1) << (at & 7).astype(np.int32))], names=["cell", "bits"])

    cells = keys.select(F.col(column).alias("key")).where("key is not null").mapInArrow(run, "cell long, bits int")
    cells = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    table[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def passing(bits, hashes: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    table = np.frombuffer(bits.value, np.uint8)
    hit = np.ones(len(hashes), bool)
    for at in _places(hashes):
        hit &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return hit


# --- groups of rows in a task ---------------------------------------------------------------------------------------

def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the place where each row's begin (one more at the end)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches regrouped so that none cuts a group of equal keys: (rows, places where groups start and end)."""
    held: list[pa.RecordBatch] = []

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch.column(key).to_numpy()
            change |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(key)[-1] == batch.column(key)[0] for key in keys) and edges(batch)[-1] == 0:
            held.append(batch)  # one group goes on through all of this batch
            continue
        held.append(batch)
        rows = joined()
        starts = edges(rows)
        held = [rows.slice(starts[-1])]
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts
    if held:
        rows = joined()
        yield rows, np.append(edges(rows), rows.num_rows)


def joined_ranks(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For nodes with these ids and links (p, q) between their places: the rank of the smallest id each one is joined with."""
    root = np.argsort(np.argsort(ids))
    while True:
        least = np.minimum(root[p], root[q])
        if (least == root[p]).all() and (least == root[q]).all():
            return root
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
