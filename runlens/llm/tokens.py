"""Token counts with a public tokenizer: overlap resynchronisation for huge texts, shared pieces for the others.

Byte-level BPE first cuts a text by a pattern that looks ahead but never back, and in which no match holds a white-space
character after another character. So wherever white space follows something else, every encoding of the
text, whatever its start, has a boundary: such a place is a proven stable boundary.

* A text of more than ``chunk`` characters is encoded in chunks that overlap. Two neighbouring encodings are spliced
  at a place in the overlap that is a token boundary of both and proven stable; if the overlap holds none, it is
  doubled, up to the rest of the text.
* Shorter texts are cut at all their stable boundaries, and equal pieces of a batch are encoded once.

Special strings hold no white space, so neither cut divides one; they are handled as the library does by default.
Defined cases: a null text counts as empty, with 0 tokens; repeated rows are counted one by one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from runlens.llm.common import bytes_of, filled, slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 32_768  # characters
OVERLAP = 1_024
BATCH_BYTES = 16 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
# bytes that may end a white-space character of Unicode, and those that may stand before them
_LAST, _BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_LAST[[*range(0x80, 0x8B), 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x1C, 0x20)]] = True
_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def stable(text: str, at: int) -> bool:
    """Whether white space follows something else at this place."""
    return 0 < at < len(text) and text[at] in " \t\n\v\f\r" and not text[at - 1].isspace()


def spliced_count(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a huge text, from the encodings of overlapping chunks."""
    def encode(start: int, end: int) -> np.ndarray:
        offsets = tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        return np.array(offsets, dtype=np.int64).reshape(-1, 2) + start

    total, begin = 0, 0
    end = min(len(text), chunk)
    left = encode(begin, end)
    while end < len(text):
        width = overlap
        while True:
            start = max(begin + 1, end - width)
            further = min(len(text), start + chunk + width)
            right = encode(start, further)
            common = np.intersect1d(left[:, 0], right[:, 0])
            places = [p for p in common[common > start].tolist() if stable(text, p)]
            if places:
                break
            if start == begin + 1:  # nothing to splice at in the whole chunk: take a longer one
                end = min(len(text), begin + 2 * (end - begin))
                left = encode(begin, end)
                if end == len(text):
                    return total + len(left)
            width *= 2
        cut = places[len(places) // 2]
        total += int((left[:, 0] < cut).sum())
        left, begin, end = right[right[:, 0] >= cut], cut, further
    return total + len(left)


def pieces_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts cut at their stable boundaries, and the place of each text's first piece."""
    raw, offsets = bytes_of(texts)
    blank = _BLANK[raw]
    doubtful = _LAST[raw]
    doubtful[1:] &= _BEFORE[raw[:-1]] | (raw[1:] < 0x80)
    cuts = np.flatnonzero(blank[1:] & ~blank[:-1] & ~doubtful[:-1]) + 1
    edges = np.union1d(cuts, offsets)
    made = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw))
    return made, np.searchsorted(edges, offsets)


def counted(texts: pa.StringArray, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    tokenizer = encoder(path)
    counts = np.zeros(len(texts), np.int64)
    huge = np.flatnonzero(pc.utf8_length(texts).to_numpy() > chunk)
    for at in huge.tolist():
        counts[at] = spliced_count(texts[at].as_py(), tokenizer, chunk, overlap)
    small = np.setdiff1d(np.arange(len(texts)), huge)
    if len(small):
        pieces, firsts = pieces_of(filled(texts.take(pa.array(small))))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        each = np.fromiter((len(e) for i in range(0, len(distinct), 20_000)
                            for e in tokenizer.encode_batch_fast(distinct[i : i + 20_000], add_special_tokens=False)),
                           np.int64, len(distinct))
        sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        counts[small] = sums[firsts[1:]] - sums[firsts[:-1]]
    return counts


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = filled(batch.column("text"))
            n = counted(texts, path, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
