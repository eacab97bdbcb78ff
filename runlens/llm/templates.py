"""Benchmark decontamination by template canonicalisation.

Words lose their punctuation and case; numbers, names (capitalised words inside a sentence) and units after numbers become
typed placeholders; a run of names is one placeholder, and so is a number with its unit. Windows of ``WINDOW`` canonical
words with at least ``LITERALS`` ordinary ones are hashed and joined with the windows of the benchmark items. Windows whose
shifts differ by ``GAP`` words at most, from one to the next, are one alignment, so that words put in or left out do not part it.
What filled the placeholders is then compared: of an alignment those windows count in which each value of the item has
become what it became in more than half of its places, or, if they are more, those with the item's own values. So an item
is recognised as it stands, with other numbers, names or units put in consistently, and with single slips.

Items with fewer than ``WINDOW`` canonical words, or with too many placeholders in more than half of their windows, are also
looked for by their plain words: in windows of ``WINDOW`` words, or in one window as long as the item. Characters of
scripts without spaces are words of their own.

Before the join a Bloom filter of fixed size (``common.FILTER_BITS``) over the benchmark's windows drops nearly all windows of the
documents; its size does not depend on the data, and what it lets through by chance the join removes.

A document is contaminated by an item if the windows that count in one alignment cover ``COVERAGE`` of the item's windows, or
``RUN`` windows of it.

Defined cases: null texts and items have no windows; documents are told apart by doc_id (null is a value) and the
hash of their text; repeated rows are judged alike; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import bloom, filled, for_workers, mixed, packed, passing, settled, slices, span_hashes, text_hashes, unpacked, words_of

WINDOW = 8
LITERALS = 5
COVERAGE = 0.5
RUN = 10
GAP = 16
STEP_BYTES = 1 << 20  # of text worked on at once: its words and windows take many times as much
# fixed values: units of measure and currency, in lower case
UNITS = """mm cm m km in ft yd mi g kg mg lb lbs oz t l ml cl gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week
weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams
kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres dollar dollars euro euros cent cents usd eur gbp percent pct degree degrees
celsius fahrenheit mph kmh km/h m/s hz khz mhz ghz kb mb gb tb watt watts kw volt volts amp amps joule joules meter stunden tage wochen jahre
prozent heures jours semaines ans horas dias semanas""".split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„‘’«»¿¡–—"
_NUMBER = r"^[0-9]+(?:[.,:/-][0-9]+)*$"
_NUMBER_WITH_UNIT = r"^[0-9]+(?:[.,][0-9]+)*[a-zµ°]{1,4}$"
_CAPITAL = r"^[^\p{L}\p{N}]*\p{Lu}"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_PAUSE = r"[,;:.!?…)\]}\"”»]$"
_ENDS = r"[.!?:…][^\p{L}\p{N}]*$"
NUMBER, UNIT, NAME, MEASURE = (np.uint64(x) for x in (0xA1, 0xB2, 0xC3, 0xD4))


class Words:
    """The words of some texts and their canonical form: per canonical word its hash, whether a placeholder, and its words."""

    def __init__(self, texts: pa.StringArray):
        unspaced = pc.match_substring_regex(texts, _UNSPACED)
        if pc.any(unspaced).as_py():
            texts = filled(pc.if_else(unspaced, pc.replace_substring_regex(texts, _UNSPACED, r" \1 "), texts))
        words, firsts = words_of(texts)
        coded = words.dictionary_encode()
        distinct, code = filled(coded.dictionary), coded.indices.to_numpy()
        core = pc.utf8_lower(pc.utf8_trim(distinct, characters=PUNCTUATION))
        flag = lambda found: found.to_numpy(zero_copy_only=False)
        number, measure = flag(pc.match_substring_regex(core, _NUMBER)), flag(pc.match_substring_regex(core, _NUMBER_WITH_UNIT))
        unit = flag(pc.is_in(core, value_set=pa.array(UNITS)))
        capital, ends = flag(pc.match_substring_regex(distinct, _CAPITAL)), flag(pc.match_substring_regex(distinct, _ENDS))
        pause = flag(pc.match_substring_regex(distinct, _PAUSE))
        real = flag(pc.not_equal(core, ""))
        n = len(code)
        heads = firsts[:-1][firsts[:-1] < n]
        first = np.zeros(n, bool)
        first[heads] = True
        start = first.copy()  # of a text or a sentence
        after_number = np.zeros(n, bool)
        if n:
            start[1:] |= ends[code[:-1]]
            after_number[1:] = number[code[:-1]] & ~first[1:]
        name = capital[code] & ~start & real[code]
        unit_here = after_number & unit[code] & ~name
        kept = real[code]
        code, name, unit_here, first = code[kept], name[kept], unit_here[kept], np.concatenate([[0], np.cumsum(kept)])[firsts]
        self.core, self.code, self.firsts = core, code, first
        self.plain = text_hashes(filled(core))[code]
        # words that go on with the placeholder before them
        n = len(code)
        joins = np.zeros(n, bool)
        if n:
            joins[1:] = (name[1:] & name[:-1] & ~pause[code[:-1]]) | (unit_here[1:] & number[code[:-1]])
            joins[first[:-1][first[:-1] < n]] = False
        self.begin = np.flatnonzero(~joins)
        self.end = np.append(self.begin[1:], n) if n else self.begin
        measured = np.zeros(n, bool)
        if n:
            measured[:-1] = joins[1:] & unit_here[1:]
        hashes = self.plain
        kinds = [(name, NAME), (unit_here, UNIT), (measure[code] | measured, MEASURE), (number[code] & ~measured, NUMBER)]
        for where, kind in kinds:
            hashes = np.where(where, kind, hashes)
        slot = np.logical_or.reduce([w for w, _ in kinds])
        self.hashes, self.slot, self.glue = mixed(hashes[self.begin]), slot[self.begin], np.where(measured, "", " ")[self.begin]
        self.moved = np.searchsorted(self.begin, first)  # each text's first canonical word

    def value(self, i: int) -> str:
        return str(self.glue[i]).join(self.core[int(c)].as_py() for c in self.code[self.begin[i] : self.end[i]])


def _within(firsts: np.ndarray, n: int, texts: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of one text start, and the text of each word."""
    owner = np.repeat(np.arange(texts), np.diff(firsts))
    if n < window:
        return np.zeros(0, np.int64), owner
    return np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :]), owner


_MARKS = [("hash", "long"), ("place", "long"), ("literal", "int"), ("of", "long"), ("mask", "long"), ("values", "array<string>")]


def marked(rows: DataFrame, key: str, bits=None, lengths: tuple[int, ...] | None = None, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(key, _text_key, text) -> (key, _text_key, hash, place, literal, of, mask, values): the windows.

    Of documents those that pass the filter ``bits``, and plain ones of the ``lengths`` that the items need. ``literal`` is the
    length of a window of plain words, 0 for canonical ones; ``values`` are the contents of the window's slots, ``mask`` says
    where they stand, and ``of`` is how many windows of its kind the text has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            many, words = batch.num_rows, Words(filled(batch.column("text")))
            parts = []
            starts, owner = _within(words.moved, len(words.hashes), many, window)
            filled_slots = np.concatenate([[0], np.cumsum(words.slot)])
            fit = filled_slots[starts + window] - filled_slots[starts] <= window - literals
            all_windows = np.bincount(owner[starts], minlength=many)
            starts = starts[fit]
            of = np.bincount(owner[starts], minlength=many)
            parts.append((0, owner[starts], starts, starts - words.moved[owner[starts]], span_hashes(words.hashes, starts, starts + window), of))
            plain = mixed(words.plain, 5)
            sizes = np.diff(words.firsts)
            for length in range(1, window + 1) if lengths is None else lengths:
                starts, owner = _within(words.firsts, len(plain), many, length)
                if lengths is None:  # the items that need plain windows
                    dense = (np.minimum(sizes, window) == length) & (2 * of <= all_windows)
                    starts = starts[dense[owner[starts]]]
                hashes = span_hashes(plain, starts, starts + length)
                if lengths is not None and length < window and len(starts):  # one place is enough
                    hit = np.flatnonzero(passing(bits, hashes))
                    once = hit[np.unique(np.rec.fromarrays([owner[starts[hit]], hashes[hit]]), return_index=True)[1]]
                    starts, hashes = starts[once], hashes[once]
                parts.append((length, owner[starts], starts, starts - words.firsts[owner[starts]], hashes, np.bincount(owner[starts], minlength=many)))
            for length, owner, starts, places, hashes, of in parts:
                if bits is not None:
                    hit = passing(bits, hashes)
                    owner, starts, places, hashes = owner[hit], starts[hit], places[hit], hashes[hit]
                if not len(starts):
                    continue
                slots = [[] if length else [i for i in range(window) if words.slot[s + i]] for s in starts.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(owner)), batch.column("_text_key").take(pa.array(owner)), pa.array(hashes.view(np.int64)), pa.array(places),
                     pa.array(np.full(len(starts), length, np.int32)), pa.array(of[owner]), pa.array([sum(1 << i for i in at) for at in slots], pa.int64()),
                     pa.array([[words.value(s + i) for i in at] for s, at in zip(starts.tolist(), slots)], pa.list_(pa.string()))],
                    names=[key, "_text_key", *(name for name, _ in _MARKS)])

    return for_workers(rows.select(key, F.xxhash64("text").alias("_text_key"), "text")).mapInArrow(
        run, f"{key} long, _text_key long, " + ", ".join(f"{name} {kind}" for name, kind in _MARKS))


def judged(found: list[dict], of: int, coverage: float, run: int) -> tuple[int, bool] | None:
    """The windows that count in the best alignment of a document with an item, and whether values are changed there."""
    found = sorted(found, key=lambda m: m["place"] - m["item_place"])
    best, last = None, None
    groups: list[list[dict]] = []
    for m in found:
        shift = m["place"] - m["item_place"]
        if last is None or shift - last > GAP:
            groups.append([])
        groups[-1].append(m)
        last = shift
    for group in groups:
        became: dict[str, dict] = defaultdict(dict)
        for m in group:
            at = [i for i in range(m["mask"].bit_length()) if m["mask"] >> i & 1]
            for i, a, b in zip(at, m["item_values"], m["values"]):
                became[a][m["item_place"] + i, m["place"] + i] = b
        usual = {}
        for a, places in became.items():
            b, times = Counter(places.values()).most_common(1)[0]
            if 2 * times > len(places):
                usual[a] = b
        fitting = [m for m in group if all(usual.get(a) == b for a, b in zip(m["item_values"], m["values"]))]
        equal = [m for m in group if m["item_values"] == m["values"]]
        counts = [(len({m["item_place"] for m in fitting}), any(m["item_values"] != m["values"] for m in fitting)), (len({m["item_place"] for m in equal}), False)]
        for windows, changed in counts:
            if windows and (windows >= of * coverage or windows >= run) and (best is None or (windows, not changed) > (best[0], not best[1])):
                best = windows, changed
    return best


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """Per contaminated document, item and kind of window: doc_id, _text_key, item_id, windows, covered, reparameterised."""
    items = settled(marked(benchmark, "item_id"), "benchmark-windows")
    lengths = tuple(sorted(r[0] for r in items.where("literal > 0").select("literal").distinct().collect()))  # WINDOW at most
    hits = settled(marked(docs, "doc_id", bloom(items, "hash"), lengths), "document-windows").select("doc_id", "_text_key", "hash", "place", "values")
    wanted = items.select("item_id", F.col("_text_key").alias("item_key"), "hash", F.col("place").alias("item_place"), "literal", "of", "mask", F.col("values").alias("item_values"))
    met = F.struct("item_place", "place", "mask", "item_values", "values")
    pairs = hits.join(wanted, "hash").groupBy("doc_id", "_text_key", "item_id", "item_key", "literal").agg(F.first("of").alias("of"), F.collect_set(met).alias("found"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column("of").to_pylist()
            made = [judged(batch.column("found")[i].as_py(), of, coverage, run) for i, of in enumerate(many)]
            good = pa.array([i for i, m in enumerate(made) if m], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(good) for c in ("doc_id", "_text_key", "item_id")), pa.array([m[0] for m in made if m], pa.int64()),
                 pa.array([m[0] / of for m, of in zip(made, many) if m], pa.float64()), pa.array([m[1] for m in made if m], pa.bool_())],
                names=["doc_id", "_text_key", "item_id", "windows", "covered", "reparameterised"])

    return pairs.mapInArrow(judge, "doc_id long, _text_key long, item_id long, windows long, covered double, reparameterised boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated document: doc_id, _text_key, the items, and whether one was re-parameterised."""
    return matches(docs, benchmark).groupBy("doc_id", "_text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("windows").alias("windows"),
        F.round(F.max("covered"), 6).alias("covered"), F.max("reparameterised").alias("reparameterised"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).drop("_text_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, columns unchanged."""
    bad = settled(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), "_text_key"), "contaminated")
    same: Column = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.col("_own_key") == F.col("_text_key"))
    rows = packed(docs, "doc_id", F.xxhash64("text").alias("_own_key"))
    return rows.join(bad, same, "left_anti").select(*unpacked(docs.columns))
