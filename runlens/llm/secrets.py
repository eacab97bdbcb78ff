"""Secret scans: three base patterns, and a battery of randomness tests for what they miss (SQL functions only).

Candidates are runs of 20 or more characters of the usual encodings with a letter and a digit in them. The alphabet
is inferred from the characters that occur. A candidate is tested for uniform use of its alphabet (chi-squared),
for runs above and below the middle of the alphabet, and for serial correlation; all must be compatible with a random
string. How surely it is not ordinary text is the probability that text of that length, whose uneven letters push
chi-squared up in proportion to its length, would look as uniform. Over all candidates of the corpus these
probabilities are cut by the step-up rule for a false-discovery rate, apart for each encoding and length class; the
rule runs on a histogram, so only its few hundred cells leave the executors.

Spans count code points, end exclusive. Defined cases: a null text counts as empty; repeated rows are scanned one by
one; without candidates there is no histogram and only the base spans are reported; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import packed, unpacked

RATE = 0.05  # share of false discoveries
BATTERY = 0.001  # level of the tests, shared by the three
BINS = 20  # histogram cells for each power of ten
LAST_BIN = 400

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]"
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# encoding: the characters it is recognised by, its alphabet, and the excess of ordinary text: size * (sum of squared shares) - 1
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", "0123456789abcdef", 0.6),
    "HEX": (r"^[0-9A-F]+$", "0123456789ABCDEF", 0.6),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    "lower36": (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.2),
    "upper36": (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.2),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 2.9),
}
SPAN = "array<struct<start:bigint,end:bigint,found:string>>"


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(between) - 1), matches,
                       lambda b, m: F.struct(F.length(b).cast("bigint").alias("gap"), m.alias("found")))
    begun = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(done: Column, s: Column) -> Column:
        start = done["at"] + s["gap"]
        end = start + F.length(s["found"])
        one = F.struct(start.alias("start"), end.alias("end"), s["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(one)).alias("spans"))

    return F.when(F.size(matches) > 0, F.aggregate(steps, begun, step)["spans"]).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6),
        "access": F.filter(found(text, ACCESS), lambda s: F.length(s["found"]) >= 20),
        "hex": found(text, HEX + "{24,}"),
    }


def encoding_of(token: Column) -> Column:
    chosen = F.lit("base64")
    for name, (pattern, _, _) in reversed(list(ENCODINGS.items())[:-1]):
        chosen = F.when(token.rlike(pattern), F.lit(name)).otherwise(chosen)
    return chosen


def _by_encoding(encoding: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), encoding)


def _below(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def tested(span: Column) -> Column:
    """A candidate with its encoding, length class, whether it passes the battery, and its histogram cell."""
    token = span["found"]
    encoding = encoding_of(token)
    size = _by_encoding(encoding, {k: float(len(v[1])) for k, v in ENCODINGS.items()})
    excess = _by_encoding(encoding, {k: v[2] for k, v in ENCODINGS.items()})
    alphabet = _by_encoding(encoding, {k: v[1] for k, v in ENCODINGS.items()})
    n = F.length(token).cast("double")
    letters = F.split(token, "")
    values = F.transform(letters, lambda c: F.call_function("instr", alphabet, c).cast("double"))
    squares = F.aggregate(F.transform(F.array_distinct(letters), lambda d: F.size(F.filter(letters, lambda c: c == d)).cast("double")),
                          F.lit(0.0), lambda a, k: a + k * k)
    chi = size / n * squares - n
    free = size - 1
    # the cube root of chi-squared per degree of freedom is nearly normal
    z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    high = F.transform(values, lambda v: (v > (size + 1) / 2).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
    runs = 1 + F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, b: (a != b).cast("int")),
                           F.lit(0), lambda a, v: a + v)
    usual = 2 * n1 * (n - n1) / n + 1
    spread = F.greatest((usual - 1) * (usual - 2) / (n - 1), F.lit(1e-9))
    z_runs = (runs - usual) / F.sqrt(spread)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    power = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) - n * mean * mean
    lagged = F.aggregate(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: (a - mean) * (b - mean)),
                         F.lit(0.0), lambda a, v: a + v)
    z_serial = lagged / F.greatest(power, F.lit(1e-9)) * F.sqrt(n)
    worst = F.least(1 - _below(z_chi), 2 * _below(-F.abs(z_runs)), 2 * _below(-F.abs(z_serial)))
    text_like = free + (n - 1) * excess
    p = _below((chi - text_like) / F.sqrt(2 * free + 4 * n * excess))
    cell = F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS)).cast("int")
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), encoding.alias("encoding"),
                    F.floor(F.log2(n)).cast("int").alias("length_class"), (worst * 3 >= BATTERY).alias("random"), cell.alias("cell"))


def candidates(text: Column) -> Column:
    mixed = F.filter(found(text, CANDIDATE), lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
    return F.transform(mixed, tested)


def discovery_cells(docs: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """Per encoding and length class the first histogram cell that counts as a discovery.

    A cell stands for the largest probability in it, which errs on the safe side. Cells and classes are few.
    """
    rows = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c")).select("c.*").where("random")
    counts = rows.groupBy("encoding", "length_class", "cell").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("encoding", "length_class")
    ranked = counts.withColumn("rank", F.sum("n").over(group.orderBy(F.desc("cell")))).withColumn("all", F.sum("n").over(group))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("cell") / BINS) <= rate * F.col("rank") / F.col("all"))
    return {(r[0], r[1]): r[2] for r in passing.groupBy("encoding", "length_class").agg(F.min("cell")).collect()}


def discovered(text: Column, cells: dict[tuple[str, int], int]) -> Column:
    if not cells:
        return F.filter(candidates(text), lambda c: F.lit(False))
    limits = F.create_map(*(x for (e, k), cell in sorted(cells.items()) for x in (F.lit(f"{e}:{k}"), F.lit(cell))))
    return F.filter(candidates(text), lambda c: c["random"] & (
        c["cell"] >= F.coalesce(limits[F.concat_ws(":", c["encoding"], c["length_class"].cast("string"))], F.lit(LAST_BIN + 1))))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with ``secret_spans``: (start, rank, kind, end), ordered by start, then kind as listed."""
    text = F.coalesce("text", F.lit(""))
    names = [c for c in docs.columns if c != "secret_spans"]
    cells = discovery_cells(docs, rate)

    def tagged(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(*(tagged(spans, rank, kind) for rank, (kind, spans) in enumerate(base_spans(text).items())))
    rows = packed(docs, base.alias("_base"), tagged(discovered(text, cells), len(KINDS), "random").alias("_more"))
    fresh = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select(*unpacked(names), F.array_sort(F.concat("_base", fresh)).alias("secret_spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, a digest of their spans, and all spans."""
    rows = scan(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(KINDS))
    of = lambda rank: F.size(F.filter("secret_spans", lambda s: s["rank"] == rank)).cast("long")
    return rows.select("doc_id", *(of(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)),
                       F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"), of(3).alias("n_random"))
