"""Assembled documents, their delivery, chunks and redaction."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as rules
from runlens.operators.steps import last_finished
from runlens.registry import PIPELINES, steps_table

CHUNK_LIMIT = 4096
TAG_RESERVE = 48
STEP_CHARS = 1 << 20  # of chunks given out at once
MADE_BY = "_Сгенерировано автоматически (версия: {version})._"


def assemble_spec(
    sessions: DataFrame, artifacts: DataFrame, adrs: DataFrame, made_by: str = MADE_BY
) -> DataFrame:
    """The markdown document of each run in blocks: title, steps in pipeline order, then the decisions.

    artifacts: the current one per session and step. A row is one block; in the order of (place, id) and joined by a
    blank line the blocks of a run give its document, whose trailing white space is dropped (``write_spec_texts``). So a run
    may have any number of decisions, and no task holds a whole document.
    """
    runs = sessions.select(F.col("id").alias("session_id"), "slug", "version")
    before, after = made_by.split("{version}")
    head = runs.select(
        "session_id",
        F.lit(-1).cast("bigint").alias("place"),
        F.concat(F.lit("# "), "slug", F.lit(f" — Product Spec\n\n{before}"), "version", F.lit(after)).alias("block"),
    )
    steps = F.broadcast(steps_table(sessions.sparkSession))  # one row per step of the registry
    known = sorted({step[0] for pipeline in PIPELINES.values() for step in pipeline})
    bodies = (
        artifacts.filter((F.col("markdown") != "") & F.col("step_id").isin(known))
        .join(runs.select("session_id", "version"), "session_id")
        .join(steps, ["version", "step_id"])
        .select(
            "session_id",
            F.col("pos").cast("bigint").alias("place"),
            F.concat(
                F.lit("## "), "step_id", F.lit(". "), "title", F.lit("\n\n"), rules.strip(F.col("markdown"))
            ).alias("block"),
        )
    )
    taken = adrs.join(runs.select("session_id"), "session_id", "left_semi")
    decided = taken.select("session_id").distinct().select(
        "session_id", F.lit(100).cast("bigint").alias("place"), F.lit("## Решения (ADR)").alias("block")
    )
    decisions = taken.select(
        "session_id",
        (F.lit(1000) + F.col("n")).cast("bigint").alias("place"),
        "id",
        F.concat(
            F.lit("### ADR-"), F.col("n").cast("string"), F.lit(": "), "title", F.lit("\n\n"),
            rules.strip(F.col("markdown")),
        ).alias("block"),
    )
    blocks = head.unionByName(bodies).unionByName(decided).withColumn("id", F.lit(0).cast("bigint"))
    return blocks.unionByName(decisions).select("session_id", "place", "id", "block")


def spec_redelivery(sessions: DataFrame, artifacts: DataFrame, adrs: DataFrame) -> DataFrame:
    """The blocks of the rebuilt document of each user's latest finished run, ready to send again."""
    runs = last_finished(sessions).select("tg_user_id", "id", "slug", "version")
    wanted = runs.select(F.col("id").alias("session_id"))
    specs = assemble_spec(
        runs,
        artifacts.join(wanted, "session_id", "left_semi"),
        adrs.join(wanted, "session_id", "left_semi"),
    )
    return specs.join(runs.withColumnRenamed("id", "session_id"), "session_id").select(
        "tg_user_id", "session_id", F.concat("slug", F.lit("-spec.md")).alias("file_name"), "place", "id", "block"
    )


def product_names(names: DataFrame) -> DataFrame:
    """The slug of each user's latest accepted name, or a neutral one.

    names: user_id, doc_id (order), name.
    """
    good = rules.product_name_verdict(F.col("name")) == "ok"
    return names.groupBy("user_id").agg(
        F.coalesce(
            F.max_by(F.when(good, rules.slug(F.col("name"))), F.when(good, F.col("doc_id"))),
            F.concat(F.lit("product-"), F.col("user_id").cast("string")),
        ).alias("slug"),
        F.count_if(~good).alias("refused"),
    )


def slug_collisions(names: DataFrame) -> DataFrame:
    """Slugs that more than one text falls on; counts combine before the shuffle."""
    return (
        names.select(rules.slug(F.col("name")).alias("slug"))
        .groupBy("slug")
        .agg(F.count("*").alias("times"))
        .filter("times > 1")
    )


OPEN_TAIL = re.compile(r"(?<=.)<[^<>]*\Z", re.DOTALL)
TAG = re.compile(r"<(/?)([a-zA-Z0-9]+)[^>]*>")


def breaks(text: str, width: int) -> tuple[list[int], list[int]]:
    """Where a chunk may end, and where it must: at line ends, and in lines over ``width`` after every ``width`` characters
    or, where that falls inside a tag, before the tag."""
    may, must, start = [], [], 0
    for end in [*(m.start() for m in re.finditer("\n", text)), len(text)]:
        while end - start > width:
            tail = OPEN_TAIL.search(text[start : start + width])
            start += tail.start() if tail else width
            must.append(start)
        may.append(end)
        start = end + 1
    return may, must


def spans(text: str, width: int) -> list[tuple[int, int]]:
    """The slices of the text that become chunks: each goes from a character that is no line end to the next cut in a line
    or, where none is in reach, to the last line end in reach."""
    may, must = breaks(text, width)
    taken, filled = [], re.compile("[^\n]")
    first = filled.search(text)
    while first:
        start = first.start()
        cut = bisect_right(must, start)
        end = must[cut] if cut < len(must) and must[cut] <= start + width else may[bisect_right(may, start + width) - 1]
        taken.append((start, end))
        first = filled.search(text, end)
    return taken


def chunks_of(text: str, limit: int = CHUNK_LIMIT) -> list[str]:
    """A text in chunks that are valid markup on their own.

    A tag lives from the chunk that opens it to the chunk that closes it, the latest of its name first. It is opened again
    at the start of each later chunk of its life and closed at the end of each but the last.
    """
    if len(text) <= limit:
        return [text]
    chunks = [text[start:end] for start, end in spans(text, max(64, limit - TAG_RESERVE))] or [""]
    lives, latest = [], defaultdict(list)
    for no, chunk in enumerate(chunks):
        for closing, name in TAG.findall(chunk):
            if not closing:
                latest[name.lower()].append(len(lives))
                lives.append([name.lower(), no, len(chunks)])
            elif latest[name.lower()]:
                lives[latest[name.lower()].pop()][2] = no
    before, after = [""] * len(chunks), [""] * len(chunks)
    for name, opened, closed in lives:
        for no in range(opened, min(closed + 1, len(chunks))):
            if no > opened:
                before[no] += f"<{name}>"
            if no < closed:
                after[no] = f"</{name}>" + after[no]
    return list(map("".join, zip(before, chunks, after)))


def chunk_documents(documents: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """(doc_id, chunk_no, chunk) of whole marked-up texts. Row by row, so no text is shuffled.

    A worker holds one text and about ``STEP_CHARS`` characters of chunks beside the batch it is given.
    """
    columns = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.string())])

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), columns)], schema=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                for no, chunk in enumerate(chunks_of(text.as_py(), limit) if text.is_valid else []):
                    rows.append((doc_id.as_py(), no, chunk))
                    size += len(chunk)
                    if size >= STEP_CHARS:
                        yield given(rows)
                        rows, size = [], 0
            pa.default_memory_pool().release_unused()  # a worker is used again and again
        if rows:
            yield given(rows)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_no int, chunk string")


# Keys whose content is private.
CONTENT_KEYS = ("text", "caption", "markdown", "artifact")
SENSITIVE_KEY = re.compile(rf"(?i)({rules.SENSITIVE})")


JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?')


def scrub_event(text: str) -> str:
    """One JSON event: values hidden by their key as objects are read, then the secrets among them in all other strings.

    Characters of a string that any secret covers go; secrets that overlap there give one mark.
    """
    secrets = set()

    def read(pairs):
        secrets.update(v for k, v in pairs if isinstance(v, str) and v and SENSITIVE_KEY.search(k))
        return {k: rules.REDACTED if k in CONTENT_KEYS or SENSITIVE_KEY.search(k) else v for k, v in pairs}

    shown = json.dumps(json.loads(text, object_pairs_hook=read), ensure_ascii=False)
    secrets.discard(rules.REDACTED)
    if not secrets:
        return shown
    # a match at every place, the longest secret there
    anywhere = re.compile("(?=(" + "|".join(map(re.escape, sorted(secrets, key=len, reverse=True))) + "))")

    def clean(token: re.Match) -> str:
        if token[1]:
            return token[0]  # a key
        value, kept, reach = json.loads(token[0]), [], 0
        for hit in anywhere.finditer(value):
            start, end = hit.span(1)
            if start >= reach:
                kept += [value[reach:start], rules.REDACTED]
            reach = max(reach, end)
        return json.dumps("".join(kept) + value[reach:], ensure_ascii=False) if kept else token[0]

    return JSON_STRING.sub(clean, shown)


def redact_events(events: DataFrame, column: str = "event") -> DataFrame:
    """JSON events without secrets, and whether the text was no JSON (then all of it is hidden).

    Events nest to any depth, which JSON functions with fixed paths cannot follow; hence Arrow batches.
    """

    @F.pandas_udf("event string, malformed boolean")
    def scrub(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return (None if text is None else scrub_event(text)), False
            except (ValueError, RecursionError):
                return rules.REDACTED, True

        return pd.DataFrame([one(text) for text in texts], columns=["event", "malformed"])

    done = events.withColumn("_scrubbed", scrub(F.col(column)))
    return done.withColumns({column: F.col("_scrubbed.event"), "malformed": F.col("_scrubbed.malformed")}).drop("_scrubbed")
