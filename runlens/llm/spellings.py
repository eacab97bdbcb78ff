"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

A word is a point whose coordinates are the counts of its letters. One inserted or deleted letter moves it by exactly one unit in
one coordinate, one replaced letter by one unit up in one and one unit down in another, so by an L1 distance of two at most. A
search therefore asks, for each pair of lengths, a tree of the words of one length: the same length allows one unit up and one unit
down, the next length one unit up and none down. A branch whose box lies further off is pruned; what is left is verified letter by letter.

1. A top tree for each length, built from a bounded sample of the vocabulary (``SAMPLE`` words, taken by hash), cuts the words into
   cells of about ``CELL`` words. It only deals the work; every word is placed and searched, whatever the sample.
2. Each word goes to its own cell as a point, and to every cell that its search reaches as a query. Pairs of one length are looked for
   from the smaller to the larger cell only, so each pair is found once.
3. In a cell, the points of a slice get a tree of their own, and all queries walk it together, level by level.

A cell that cannot be cut (anagrams) has its points spread over slices, with the queries sent to each; no cell has a cap.

Defined cases: a null text has no words; a null id counts as the empty string in the hash of a run; repeated rows count each; a length
that the sample does not hold is a cell of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import settled

# Letters and the share of runs that lose one letter.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOILT = 31
LEAST_LETTERS = 7
LEAST_TIMES = 2
FACTOR = 10
SAMPLE = 65_536
CELL = 16_384  # words of a cell, about
LEAF = 16  # words of a leaf of a cell's own tree
PAIRS = 1 << 20  # pairs verified at once
WIDTH = 26 + 64  # a-z and U+00C0 to U+00FF
OTHER_LENGTH = 1 << 40  # cells of lengths that the sample does not hold start here


def letter_places(chars: np.ndarray) -> np.ndarray:
    """The coordinate of each letter, given as code point."""
    return np.where(chars < 0xC0, chars - ord("a"), chars - 0xC0 + 26)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, as one array and the place where each word starts."""
    raw = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    return raw, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def counts_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letter counts, one row for each word; above 255 a count stays 255, which only weakens pruning."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    flat = np.bincount(owner * WIDTH + letter_places(raw), minlength=(len(at) - 1) * WIDTH)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, WIDTH)


def marks_of(points: np.ndarray) -> np.ndarray:
    """64 bits of each point of which one unit in one coordinate changes one at most: for a-z whether there is one and whether there
    are two, for the others the parity of twelve groups."""
    marks = np.zeros(len(points), np.uint64)
    for i in range(26):
        for least, shift in ((1, i), (2, 26 + i)):
            marks |= (points[:, i] >= least).astype(np.uint64) << np.uint64(shift)
    for group in range(12):
        odd = points[:, 26 + group :: 12].sum(axis=1) & 1
        marks |= odd.astype(np.uint64) << np.uint64(52 + group)
    return marks


class Tree:
    """A k-d tree: at each node a coordinate and the largest count that goes left; leaves hold ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.axis, self.cut, self.right, self.leaf, self.ranges = [], [], [], [], []
        waiting = [(0, len(points), -1)]
        while waiting:
            begin, end, parent = waiting.pop()
            node = len(self.axis)
            if parent >= 0 and self.right[parent] == -2:
                self.right[parent] = node
            elif parent >= 0:
                self.right[parent] = -2  # the left child follows its parent, the right one is told when it comes
            axis, cut = self._split(points, begin, end) if end - begin > leaf else (-1, 0)
            self.axis.append(axis)
            self.cut.append(cut)
            self.right.append(-1)
            self.leaf.append(-1 if axis >= 0 else len(self.ranges))
            if axis < 0:
                self.ranges.append((begin, end))
                continue
            rows = self.order[begin:end]
            low = points[rows, axis] <= cut
            self.order[begin:end] = np.concatenate([rows[low], rows[~low]])
            middle = begin + int(low.sum())
            waiting += [(middle, end, node), (begin, middle, node)]
        self.axis, self.cut, self.right, self.leaf = (np.array(x) for x in (self.axis, self.cut, self.right, self.leaf))
        self.ranges = np.array(self.ranges).reshape(-1, 2)

    def _split(self, points: np.ndarray, begin: int, end: int) -> tuple[int, int]:
        """The coordinate and count that cut the points most evenly, or -1 where all are alike."""
        rows = points[self.order[begin:end]]
        middle = np.sort(rows, axis=0)[len(rows) // 2] if len(rows) <= 4096 else np.median(rows, axis=0).astype(np.uint8)
        below = (rows < middle).sum(axis=0)
        upto = (rows <= middle).sum(axis=0)
        gain = np.maximum(np.minimum(below, len(rows) - below), np.minimum(upto, len(rows) - upto))
        axis = int(gain.argmax())
        if not gain[axis]:
            return -1, 0
        even_below = min(below[axis], len(rows) - below[axis]) >= min(upto[axis], len(rows) - upto[axis])
        return axis, int(middle[axis]) - int(even_below)

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf that holds each point."""
        which, leaf = self.reached(points, 0, 0)
        return leaf[np.argsort(which)]

    def reached(self, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for all leaves whose box holds something ``up`` units up and ``down`` units down (0 or 1) from the point."""
        found, which, node = [], np.arange(len(points)), np.zeros(len(points), np.int64)
        # the coordinate that used up the unit up or down, -1: none yet, -2: there is none
        used_up, used_down = (np.full(len(points), -1 if unit else -2) for unit in (up, down))
        while len(which):
            done = self.axis[node] < 0
            found.append((which[done], self.leaf[node[done]]))
            which, node, used_up, used_down = (x[~done] for x in (which, node, used_up, used_down))
            axis, cut = self.axis[node], self.cut[node]
            above = points[which, axis].astype(np.int64) - cut  # 1 or more: on the right side
            left = (above <= 0) | ((above == 1) & ((used_down == -1) | (used_down == axis)))
            right = (above >= 1) | ((above == 0) & ((used_up == -1) | (used_up == axis)))
            down_now, up_now = np.where(above >= 1, axis, used_down), np.where(above <= 0, axis, used_up)
            which, node, used_up, used_down = (
                np.concatenate([a[left], b[right]]) for a, b in ((which, which), (node + 1, self.right[node]), (used_up, up_now), (down_now, used_down)))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class TopTrees:
    """The cells of the vocabulary: for each length of the sample a tree whose leaves are numbered on."""

    def __init__(self, sample: pa.Array, share: float):
        self.trees: dict[int, tuple[Tree, int]] = {}
        self.cells, slices = 0, []
        raw, at = letters_of(sample)
        points, sizes = counts_of(raw, at), np.diff(at)
        for size in np.unique(sizes):
            tree = Tree(points[sizes == size], max(1, int(CELL * share)))
            self.trees[int(size)] = (tree, self.cells)
            self.cells += len(tree.ranges)
            slices.append(np.ceil(np.diff(tree.ranges, axis=1)[:, 0] / max(share, 1e-12) / (2 * CELL)))
        self.slices = np.maximum(1, np.concatenate(slices)).astype(np.int64) if slices else np.ones(0, np.int64)

    def own(self, size: int, points: np.ndarray) -> np.ndarray:
        if size not in self.trees:
            return np.full(len(points), OTHER_LENGTH + size)
        tree, first = self.trees[size]
        return first + tree.homes(points)

    def searched(self, size: int, points: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.trees:
            return np.arange(len(points)), np.full(len(points), OTHER_LENGTH + size)
        tree, first = self.trees[size]
        which, leaf = tree.reached(points, 1, 0 if longer else 1)
        return which, first + leaf


def placed(vocabulary: DataFrame, top: TopTrees) -> DataFrame:
    """(word, n) -> cell, slice, query, home, word, n: a word as point of its own cell and as query of the cells it has to search."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            words, times = batch.column("word"), batch.column("n")
            raw, at = letters_of(words)
            points, sizes = counts_of(raw, at), np.diff(at)
            salt = np.array([hash_of(w) for w in words.to_pylist()], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                home = trees.own(size, points[rows])
                parts = [(np.arange(len(rows)), home, np.zeros(len(rows), bool))]
                for longer in (False, True):
                    which, cell = trees.searched(size + longer, points[rows], longer)
                    ahead = longer | (cell >= home[which])
                    parts.append((which[ahead], cell[ahead], np.ones(int(ahead.sum()), bool)))
                which, cell, query = (np.concatenate(c) for c in zip(*parts))
                slices = np.ones(len(cell), np.int64)
                known = cell < OTHER_LENGTH
                slices[known] = trees.slices[cell[known]]
                copies = np.where(query, slices, 1)
                each = np.repeat(np.arange(len(cell)), copies)
                part = np.where(query[each], np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies), salt[rows[which[each]]] % slices[each])
                source = pa.array(rows[which[each]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[each]), pa.array(part), pa.array(query[each]), pa.array(home[which[each]]), words.take(source), times.take(source)],
                    names=["cell", "slice", "query", "home", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "cell long, slice long, query boolean, home long, word string, n long")


def hash_of(word: str) -> int:
    """A small hash that is the same on every machine."""
    made = 7
    for c in word:
        made = (made * 1_000_003 + ord(c)) & 0x7FFFFFFF
    return made


def one_edit(a_raw: np.ndarray, a_at: np.ndarray, b_raw: np.ndarray, b_at: np.ndarray, size: int, longer: int) -> np.ndarray:
    """Whether words of ``size`` letters and words of ``size + longer`` letters, given by their starts, differ by exactly one edit."""
    a = a_raw[a_at[:, None] + np.arange(size)]
    if not longer:
        return (a != b_raw[b_at[:, None] + np.arange(size)]).sum(axis=1) == 1
    b = b_raw[b_at[:, None] + np.arange(size + 1)]
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def near_in_cell(table: pa.Table) -> pa.Table:
    """The points and queries of one slice of a cell -> pairs (word, n, other, other_n) one edit apart."""
    query = table.column("query").to_numpy()
    words, times = table.column("word").combine_chunks(), table.column("n").to_numpy()
    home, cell = table.column("home").to_numpy(), int(table.column("cell")[0].as_py())
    raw, at = letters_of(words)
    sizes, points = np.diff(at), counts_of(raw, at)
    marks, held = marks_of(points), np.flatnonzero(~query)
    pairs = []
    if len(held):
        size = int(sizes[held[0]])  # all points of a cell have one length
        tree = Tree(points[held], LEAF)
        for longer in (0, 1):
            asking = np.flatnonzero(query & (sizes == size - longer))
            which, leaf = tree.reached(points[asking], 1, 1 - longer)
            begin, end = tree.ranges[leaf, 0], tree.ranges[leaf, 1]
            ends = np.cumsum(end - begin)
            first = 0
            while first < len(which):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
                n = (end - begin)[first:last]
                q = asking[np.repeat(which[first:last], n)]
                p = held[tree.order[np.repeat(begin[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
                close = np.bitwise_count(marks[q] ^ marks[p]) <= 2 - longer  # as the box of a single point would tell
                q, p = q[close], p[close]
                good = one_edit(raw, at[q], raw, at[p], size - longer, longer)
                q, p = q[good], p[good]
                if not longer:  # both words of a pair ask in their own cell: keep the one that is asked by the smaller
                    inside = home[q] == cell
                    smaller = np.array([a < b for a, b in zip(words.take(pa.array(q)).to_pylist(), words.take(pa.array(p)).to_pylist())], bool)
                    q, p = q[~inside | smaller], p[~inside | smaller]
                pairs.append((q, p))
                first = last
    q, p = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table([words.take(pa.array(q)), pa.array(times[q]), words.take(pa.array(p)), pa.array(times[p])], names=["word", "n", "other", "other_n"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n), each word once -> word, n, other, other_n: all pairs one edit apart, each once."""
    count = vocabulary.count()
    sample = vocabulary.select("word", F.xxhash64("word").alias("_h")).orderBy("_h").limit(SAMPLE).select("word").toArrow().column("word").combine_chunks()
    top = TopTrees(sample, min(1.0, SAMPLE / max(count, 1)))
    return placed(vocabulary, top).groupBy("cell", "slice").applyInArrow(near_in_cell, "word string, n long, other string, other_n long")


def runs_of(docs: DataFrame) -> DataFrame:
    """All runs of letters of the texts, A-Z lower-cased, as doc_id, run."""
    return docs.select("doc_id", F.explode(F.split(F.translate("text", UPPER, LOWER), f"[^{LETTERS}]+")).alias("run")).where("run <> ''")


def spoilt(doc_id: Column, run: Column) -> Column:
    """The run, without one of its letters if the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    place = (h % F.length(run)).cast("int")
    return F.when(h % SPOILT == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """The words of enough letters that occur often enough, with their number: word, n."""
    words = runs_of(docs).select(spoilt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def variants(vocabulary: DataFrame) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n: how many words are near, and the usual form."""
    pairs = settled(near_words(vocabulary), "spelling-pairs")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    rows = both.unionByName(vocabulary.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))))
    told = rows.groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("best"))
    usual = -F.col("best.less") >= FACTOR * F.col("n")
    return told.select("word", "n", "n_near", F.when(usual, F.col("best.other")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, form) -> word, root: forms followed to the last, by doubling the way in each round.

    A form is ten times as frequent as its word, so a chain has at most 18 steps and five rounds reach its end.
    """
    now = settled(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    for _ in range(5):
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = now.join(ahead, F.col("root") == F.col("_word"), "left")
        now = settled(further.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            break
    return now.select("word", "root")


def spelling_report(docs: DataFrame) -> DataFrame:
    """Per word of the texts: word, form, root, n, n_near, form_n."""
    told = settled(variants(settled(vocabulary_of(docs), "spelling-words")), "spelling-variants")
    roots = roots_of(told.where("form is not null"))
    known = roots.select(F.col("word").alias("_word"), "root")
    return told.join(known, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
with recursive runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
    from documents) group by all
),
coded as (
  select run, times, list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: unicode(x)::bigint) as points from runs
),
hashed as (
  select run, times, xor(list_reduce(list_concat([4294967295], flatten(list_transform(points, lambda c:
    case when c < 128 then [c] else [192 + (c >> 6), 128 + (c & 63)] end))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
      lambda r, bit: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295) as h from coded
),
vocabulary as (
  select word, sum(times)::bigint as n from (
    select times, case when h % 31 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word
    from hashed) where length(word) >= 7 group by word having sum(times) >= 2
),
holes as (
  select word, n, substring(word, 1, i::int - 1) || '*' || substring(word, i::int + 1) as hole, substring(word, 1, i::int - 1) || substring(word, i::int + 1) as less
  from (select word, n, unnest(range(1, length(word) + 1)) as i from vocabulary)
),
pairs as (
  select a.word, a.n, b.word as other, b.n as other_n from holes a join holes b on a.hole = b.hole and a.word <> b.word
  union select h.word, h.n, v.word, v.n from holes h join vocabulary v on h.less = v.word
  union select v.word, v.n, h.word, h.n from holes h join vocabulary v on h.less = v.word
),
ranked as (
  select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as place from pairs
),
told as (
  select v.word, v.n, coalesce(r.n_near, 0) as n_near, case when r.other_n >= 10 * v.n then r.other end as form,
    case when r.other_n >= 10 * v.n then r.other_n end as form_n
  from vocabulary v left join ranked r on r.word = v.word and r.place = 1
),
ways as (
  select word, word as at_word, form as next_word from told
  union all select w.word, t.word, t.form from ways w join told t on t.word = w.next_word
)
select t.word, t.form, w.at_word as root, t.n, t.n_near, t.form_n from told t join ways w on w.word = t.word and w.next_word is null
"""
