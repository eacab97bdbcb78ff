"""Repeated stretches inside a text: all runs of words with at least three periods, by recompression.

A run is a stretch with smallest period q (words q apart are the same) of at least max(24, 3 q) words that cannot be extended by a
neighbouring word. Every run holds two places of the grid of its period, x and x + q, whose words agree there and at
two further places; only the few grid places that pass those comparisons are extended.

The extension is exact and needs no suffix array. The words of the texts concerned are recompressed: equal neighbours become one
block symbol (symbol, times), then pairs across a random split of the symbols become one symbol, and so on until one
symbol is left. Names are exact, not hashed. As the parse of a common part is the same but for its ends, the longest common
extension of two places climbs while both stand at the start of equal symbols, steps over equal symbols (a block in one
step) and goes down where they differ: about as many steps as there are levels. Extensions to the left use the mirrored grammar.

Each text is worked on whole in one task, with the grammar's memory in proportion to its words; no text is cut and no run is left out.

Defined cases: a text without words, or null, has no run and the hash of nothing; a null id never has its words replaced; rows
that share an id are judged each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.common import filled, mixed, slices, words_of

LEAST = 24
TIMES = 3
TEXT_BYTES = 1 << 20
CANDIDATES = 1 << 20  # grid places looked at together
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


class Grammar:
    """The levels of a recompressed sequence, one behind the other in flat arrays, each closed by an end mark."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray | None]]):
        sizes = np.array([len(symbols) + 1 for symbols, _ in levels])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        total = int(offsets[-1])
        self.symbol, self.parent, self.child = np.full(total, -1, np.int32), np.full(total, -1, np.int32), np.full(total, -1, np.int32)
        self.first, self.left = np.ones(total, bool), np.ones(total, np.int32)
        for level, (symbols, parent) in enumerate(levels):
            at, n = int(offsets[level]), len(symbols)
            self.symbol[at : at + n] = symbols
            ends = np.append(np.flatnonzero(symbols[1:] != symbols[:-1]), n - 1)
            self.left[at : at + n] = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 1
            if parent is not None:
                up = int(offsets[level + 1])
                first = np.append(True, parent[1:] != parent[:-1])
                self.parent[at : at + n], self.parent[at + n] = up + parent, up + len(levels[level + 1][0])
                self.first[at : at + n] = first
                self.child[up : up + sizes[level + 1] - 1], self.child[up + sizes[level + 1] - 1] = at + np.flatnonzero(first), at + n

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a < b of the sequence, how many symbols from there on agree."""
        found, asked = np.zeros(len(a), np.int64), np.arange(len(a))
        a, b, begun = a.astype(np.int64), b.astype(np.int64), b
        while len(asked):
            up_a, up_b = self.parent[a], self.parent[b]
            climb = self.first[a] & self.first[b] & (up_a >= 0) & (self.symbol[up_a] == self.symbol[up_b])
            same = self.symbol[a] == self.symbol[b]
            step = np.minimum(self.left[a], self.left[b])
            down_a, down_b = self.child[a], self.child[b]
            done = ~same & (down_b < 0)
            if done.any():
                found[asked[done]] = b[done] - begun[done]
            a = np.where(climb, up_a, np.where(same, a + step, down_a))
            b = np.where(climb, up_b, np.where(same, b + step, down_b))
            if done.any():
                go_on = ~done
                a, b, asked, begun = a[go_on], b[go_on], asked[go_on], begun[go_on]
        return found


def _named(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One name for each different pair; y is -1 or more."""
    return np.unique(x.astype(np.int64) * (int(y.max()) + 2) + (y + 1), return_inverse=True)[1].astype(np.int32)


def recompressed(symbols: np.ndarray) -> tuple[Grammar, Grammar]:
    """The grammar of a sequence of at least one symbol, and that of its mirror image."""
    levels, now, round_no = [], symbols.astype(np.int32), 0
    while len(now) > 1:
        first = np.append(True, now[1:] != now[:-1])
        if not first.all():  # blocks
            starts = np.flatnonzero(first)
            levels.append((now, (np.cumsum(first) - 1).astype(np.int32)))
            now = _named(now[starts], np.diff(starts, append=len(first)))
        if len(now) > 1:  # pairs
            opens = (mixed(now.astype(np.uint64), 100 + round_no) & np.uint64(1)).astype(bool)
            pairs = np.flatnonzero(opens[:-1] & ~opens[1:])
            round_no += 1
            if not len(pairs):
                continue
            first = np.ones(len(now), bool)
            first[pairs + 1] = False
            second = np.full(len(now), -1, np.int64)
            second[pairs] = now[pairs + 1]
            levels.append((now, (np.cumsum(first) - 1).astype(np.int32)))
            now = _named(now[first], second[first])
    levels.append((now, None))
    mirror = []
    for i, (level, parent) in enumerate(levels):
        mirror.append((level[::-1], None if parent is None else (len(levels[i + 1][0]) - 1 - parent)[::-1]))
    return Grammar(levels), Grammar(mirror)


def grid(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid places that can lie in a run: (text, place in ``words``, period).

    A run of period q has L = max(24, 3 q) words or more, so words agree with those q further on at L - q places in a row. A
    stride of half of that puts a grid place and a whole stride behind it inside.
    """
    sizes = np.diff(firsts)
    periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = (np.maximum(LEAST, TIMES * period) - period) // 2
    places = (sizes[text] - np.maximum(LEAST, TIMES * period)) // stride + 2
    places = np.minimum(places, (sizes[text] - period - 1) // stride + 1)
    ends = np.cumsum(places)
    kept, at = [], 0
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
        n = places[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        offset = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * stride[which]
        x, q = firsts[text[which]] + offset, period[which]
        alive = np.flatnonzero(words[x] == words[x + q])
        x, q, which = x[alive], q[alive], which[alive]
        for share in (1, 2):
            y = np.minimum(x + share * (stride[which] - 1) // 2, firsts[text[which] + 1] - 1 - q)
            alive = np.flatnonzero(words[y] == words[y + q])
            x, q, which = x[alive], q[alive], which[alive]
        kept.append((text[which], x, q))
        at = upto
    if not kept:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*kept))


def stretches(found: np.ndarray) -> np.ndarray:
    """Of the rows (text, start, length, period) those with the smallest period of each stretch, each once."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[new]


def runs(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts, as (text, start in the text, length, period), by text, start and period."""
    text, x, q = grid(words, firsts)
    if not len(text):
        return (np.zeros(0, np.int64),) * 4
    used, own = np.unique(text, return_inverse=True)
    sizes = np.diff(firsts)[used]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.repeat(firsts[used] - begin[:-1], sizes) + np.arange(begin[-1])
    forth, back = recompressed(np.unique(words[joined], return_inverse=True)[1])
    x = x - firsts[text] + begin[own]
    total, found = int(begin[-1]), []
    for at in range(0, len(x), CANDIDATES):
        place, period, mine = x[at : at + CANDIDATES], q[at : at + CANDIDATES], own[at : at + CANDIDATES]
        after = np.minimum(forth.common(place, place + period), begin[mine + 1] - place - period)
        before = np.minimum(back.common(total - place - period, total - place), place - begin[mine])
        length = before + period + after
        long = length >= np.maximum(LEAST, TIMES * period)
        found.append(stretches(np.stack([mine, place - before, length, period], axis=1)[long]))
    found = stretches(np.concatenate(found))
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return used[found[:, 0]], found[:, 1] - begin[found[:, 0]], found[:, 2], found[:, 3]


def replaced(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each word of a text comes from, for the texts whose end is made periodic; None for all others."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def greatest(starts: list[int], lengths: list[int], periods: list[int]) -> int:
    """The run of greatest exact length / period; the first of equal ones, as runs come by start and period."""
    best = 0
    for i in range(1, len(starts)):
        if lengths[i] * periods[best] > lengths[best] * periods[i]:
            best = i
    return best


def run_report(docs: DataFrame, replace: bool = False) -> DataFrame:
    """Per document its runs and the text without their repetitions: the words of a run behind its first period are dropped.

    With ``replace`` the end of one text in ten is first made periodic, as ``replaced`` tells from its id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            texts = filled(batch.column("text"))
            words, firsts = words_of(texts)
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            source = np.arange(len(ids))
            changed = np.zeros(len(texts), bool)
            for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), np.diff(firsts).tolist())):
                places = replaced(doc_id, n) if replace else None
                if places is not None:
                    source[firsts[i] : firsts[i + 1]] = firsts[i] + places
                    changed[i] = True
            ids = ids[source]
            text, start, length, period = runs(ids, firsts)
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, firsts[text] + start + period, 1)
            np.add.at(cover, firsts[text] + start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            edges = np.searchsorted(text, np.arange(len(texts) + 1))
            rows = []
            for i in range(len(texts)):
                a, b = edges[i], edges[i + 1]
                if a == b and not changed[i]:
                    body = b" ".join(texts[i].as_buffer().to_pybytes().split())
                else:
                    inside = slice(firsts[i], firsts[i + 1])
                    body = " ".join(words.take(pa.array(source[inside][kept[inside]])).to_pylist()).encode()
                s, n, q = start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()
                lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q)).encode()
                best = greatest(s, n, q) if s else None
                top = (None,) * 4 if best is None else (s[best], n[best], q[best], 1000 * n[best] // q[best])
                rows.append((len(s), *top, sha256(lines).hexdigest(), sha256(body).hexdigest()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
