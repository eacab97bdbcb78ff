"""Substring deduplication: an FM-index for each shard, through which the documents' segments are streamed.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller id. No document is
compared with the whole corpus. Every window has an anchor, the smallest hash among its runs of ``ANCHOR`` words, and
consecutive windows with the same anchor form a segment; equal windows have equal anchors, wherever they stand. So:

1. Segments are listed as narrow rows. Only anchors that occur in two documents matter.
2. Segments alike in all words are one text, owned by its smallest document; any later document has all windows of it.
3. The owners' segments go to shards by anchor, each shard of a bounded number of words. A shard indexes its segments
   and streams them through the index: backward search gives the matching statistics, and intervals that
   reach ``WINDOW`` words and occur in a smaller document are reported.
4. Anchors with more than ``SPLIT`` different segments (a passage in a third of all documents, with other words around
   it each time) are taken apart into windows, which are grouped by their hash in the same way as segments in step 2.

Hashes that decide are pairs of 64 bits. Defined cases: a null text has no words; a null id neither removes words nor
loses any; rows that share an id do not remove one another's words, nor their own; equal rows are listed and indexed once; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import bloom, filled, mixed, passing, settled, slices, span_hashes, unrepeated, word_hashes, words_of
from runlens.llm.fmindex import FmIndex

WINDOW = 50
ANCHOR = 10
MOST_WINDOWS = 100  # of a segment; longer ones are continued in another
SPLIT = 1000
SHARD_WORDS = 400_000
TEXT_BYTES = 2 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[: len(least) - step], least[step:]), span + step
    return least


def segments(texts: pa.StringArray, window: int, anchor: int):
    """Per segment: owner, first word (from the text's first), number of windows, anchor and hash of all its words."""
    words, firsts = words_of(texts)
    hashes = word_hashes(words)
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), hashes, firsts
    at = np.arange(n - anchor + 1)
    least = sliding_least(span_hashes(hashes, at, at + anchor), window - anchor + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    places = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(places):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), hashes, firsts
    key = least[places]
    new = np.append(True, (key[1:] != key[:-1]) | (places[1:] != places[:-1] + 1))
    run = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    new |= (np.arange(len(places)) - run) % MOST_WINDOWS == 0
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(places)))
    start = places[heads]
    return owner[start], start - firsts[owner[start]], count, key[heads], span_hashes(hashes, start, start + count + window - 1), hashes, firsts


def listed(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, segment, doc_id, row_key, start, windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            owner, start, count, key, whole, _, _ = segments(filled(batch.column("text")), window, anchor)
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("doc_id").take(of), batch.column("row_key").take(of),
                 pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["anchor", "segment", "doc_id", "row_key", "start", "windows"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "anchor long, segment long, doc_id long, row_key long, start int, windows int")


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (doc_id, row_key, ..) with the documents' texts; documents that have no row do not move."""
    bits = bloom(rows, "row_key")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield unrepeated(batch.filter(pa.array(passing(bits, batch.column("row_key").to_numpy().view(np.uint64)))))

    texts = docs.select("doc_id", "row_key", "text").where("doc_id is not null")
    once = texts.mapInArrow(wanted, "doc_id long, row_key long, text string").dropDuplicates(["doc_id", "row_key"])
    return once.join(rows, ["doc_id", "row_key"])


def taken_out(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, row_key, text, wanted: (start, windows, shard) -> the segments' words; shard -1: the windows' hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()),
                            ("words", pa.string()), ("hash_a", pa.int64()), ("hash_b", pa.int64())])
        for batch in slices(batches, "text", TEXT_BYTES):
            words, firsts = words_of(filled(batch.column("text")))
            asked = batch.column("wanted")
            flat, counts = asked.flatten(), asked.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            start, many, shard = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            begin, end = firsts[:-1][owner] + start, firsts[:-1][owner] + start + many + window - 1
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("row_key").to_numpy()
            whole = shard >= 0
            if whole.any():
                spelled = words.to_pylist()
                made = [" ".join(spelled[b:e]) for b, e in zip(begin[whole].tolist(), end[whole].tolist())]
                none = pa.nulls(len(made), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard[whole]), pa.array(ids[owner[whole]]), pa.array(keys[owner[whole]]),
                                                  pa.array(start[whole].astype(np.int32)), pa.array(made, pa.string()), none, none], schema=schema)
            if not whole.all():
                reps = many[~whole]
                each = np.repeat(np.flatnonzero(~whole), reps)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(reps) - reps, reps)
                hashes = word_hashes(words)
                at = begin[each] + offset
                a, b = (span_hashes(mixed(hashes, seed), at, at + window).view(np.int64) for seed in (21, 22))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), -1)), pa.array(ids[owner[each]]), pa.array(keys[owner[each]]),
                                                  pa.array((start[each] + offset).astype(np.int32)), pa.nulls(len(each), pa.string()), pa.array(a), pa.array(b)], schema=schema)

    return texts.mapInArrow(run, "shard long, doc_id long, row_key long, start int, words string, hash_a long, hash_b long")


def repeats(table: pa.Table, window: int) -> pa.Table:
    """One shard: the intervals of its segments that occur in a segment of a smaller document."""
    words, firsts = words_of(filled(table.column("words").combine_chunks()))
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    lengths = np.diff(firsts)
    owners = table.column("doc_id").to_numpy()
    index = FmIndex(code, lengths, owners, window)
    matched, first = index.matching(code, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    hit = np.flatnonzero((matched >= window) & (first < owners[owner]))
    new = np.append(True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)) if len(hit) else np.zeros(0, bool)
    heads = hit[new]
    tails = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else heads
    of = owner[heads]
    start = table.column("start").to_numpy()[of] + (heads - firsts[of])
    return pa.table({"doc_id": table.column("doc_id").combine_chunks().take(pa.array(of)), "row_key": table.column("row_key").combine_chunks().take(pa.array(of)),
                     "start": pa.array(start.astype(np.int32)), "end": pa.array((start + tails - heads + window).astype(np.int32))})


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, split: int = SPLIT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs (doc_id, row_key, text) -> doc_id, row_key, start, end: words that a smaller document has, maybe several times."""
    marks = settled(listed(docs.where("doc_id is not null"), window, anchor).distinct(), "repeat-marks")
    shared = settled(marks.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "repeat-anchors")
    live = settled(marks.join(shared, "anchor", "left_semi"), "repeat-live")
    owned = settled(live.groupBy("anchor", "segment").agg(F.min("doc_id").alias("owner")), "repeat-owners")
    wide = settled(owned.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("anchor", F.lit(True).alias("wide")), "repeat-wide")
    seen = settled(live.join(owned, ["anchor", "segment"]).join(wide, "anchor", "left"), "repeat-seen")
    later = seen.where("doc_id > owner").select("doc_id", "row_key", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("end"))
    own = seen.where("doc_id = owner")
    total = own.where("wide is null").agg(F.sum(F.col("windows") + (window - 1))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    shard = F.when(F.col("wide"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).cast("long")
    asked = own.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "windows", shard.alias("shard"))).alias("wanted"))
    out = settled(taken_out(_with_texts(settled(asked, "repeat-asked"), docs), window), "repeat-texts")
    found = out.where("shard >= 0").groupBy("shard").applyInArrow(
        lambda table: repeats(table, window), "doc_id long, row_key long, start int, end int")
    single = out.where("shard < 0").select("hash_a", "hash_b", "doc_id", "row_key", "start")
    smallest = settled(single.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("owner")), "repeat-windows")
    apart = single.join(smallest, ["hash_a", "hash_b"]).where("doc_id > owner").select("doc_id", "row_key", "start", (F.col("start") + window).cast("int").alias("end"))
    return later.union(found).union(apart)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed and kept_text: the words that stay, joined by one space."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    spans = repeated_spans(keyed, window)
    per_row = settled(spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeat-spans")
    bits = bloom(per_row, "row_key")

    def split_off(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passing(bits, batch.column("row_key").to_numpy().view(np.uint64)) == inside))

        return keyed.mapInArrow(run, "doc_id long, text string, row_key long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, firsts = words_of(filled(batch.column("text")))
            spelled = words.to_pylist()
            gone = np.zeros(len(spelled) + 1, np.int64)
            for i, row in enumerate(batch.column("spans").to_pylist()):
                for span in row or ():
                    gone[firsts[i] + span["start"]] += 1
                    gone[firsts[i] + span["end"]] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            kept = [" ".join([w for w, s in zip(spelled[a:b], stays[a:b].tolist()) if s]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            sums = np.concatenate([[0], np.cumsum(~stays)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(firsts).astype(np.int64)), pa.array(sums[firsts[1:]] - sums[firsts[:-1]]), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_text"])

    # documents without a repeat stay where they are; the others meet their spans
    named = per_row.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "spans")
    met = split_off(True).join(named, (F.col("doc_id") == F.col("_id")) & (F.col("row_key") == F.col("_key")), "left").select("doc_id", "text", "spans")
    rest = split_off(False).select("doc_id", "text", F.lit(None).cast(met.schema["spans"].dataType).alias("spans"))
    return met.union(rest).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document its words, how many go, and a digest of those that stay."""
    return removed(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
