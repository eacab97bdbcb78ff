"""Text rules as column expressions: they run inside code generation, on whole texts.

Word characters are letters, digits of any script and the underscore. Line rules see only the line feed as a
line end, which is what the flag ``d`` says in Java patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.registry import DONT_KNOW

# Limits and patterns of the question rules.
MAX_QUESTION, MAX_PREAMBLE, MAX_RENDERED = 400, 1200, 1800
MAX_QUESTION_SENTENCES, MAX_PREAMBLE_SENTENCES = 3, 12
QUESTION_MARKS = "？؟⁇︖﹖"
WORD = r"\p{L}\p{N}_"
LIST_MARK = r"(?dmU)(?:^\s*|\s)(\d+[.)]|[-*•])\s+"
SENTENCE_END = r"(?U)[.!?]+(?:\s|$)"
# only at the start of a sentence: a later start could not match either, and long sentences stay linear
ONE_QUESTION = r"(?<![^.!?\n])([^.!?\n]{3,}+\?)"
REQUESTS = "расскажи|опиши|назови|перечисли|укажи|уточни|дай|напиши|поясни|объясни|сформулируй|ответь"
IMPERATIVE = rf"(?dimuU)(?:^|[\n;]|\d+[.)]\s*|[-*•]\s*)\s*({REQUESTS})(?![{WORD}])"
SENSITIVE = "token|secret|password|api[_-]?key|authorization|dsn"
REDACTED = "«REDACTED»"
MULTI_ASK = (
    r"(?diuU)(зада(й|вай)|спроси|предложи)[^.]{0,40}?\d+\s*[-–—]\s*\d+\s*[^.]{0,20}?(вопрос|метафор)"
)


def strip(text: Column) -> Column:
    """Without white space at both ends. Runs inside the text are passed over once."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def normalize_marks(text: Column) -> Column:
    """All question marks as '?'; null as ''."""
    return F.translate(F.coalesce(text, F.lit("")), QUESTION_MARKS, "?" * len(QUESTION_MARKS))


def count_of(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def question_marks(text: Column) -> Column:
    return count_of(normalize_marks(text), "?")


def sentences(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SENTENCE_END, -1), lambda part: strip(part) != ""))


def list_like(text: Column) -> Column:
    return text.rlike(LIST_MARK) | (count_of(text, ";") >= 2)


def cleaned(text: Column) -> Column:
    """What the text rules judge: one kind of question mark, no white space at the ends, '' for null.

    The rules take a cleaned column, so that several of them share one cleaning.
    """
    return strip(normalize_marks(text))


def question_verdict(t: Column) -> Column:
    """The first rule a question breaks, or 'ok': exactly one short question and no list."""
    marks = count_of(t, "?")
    return (
        F.when(t == "", "empty")
        .when(F.char_length(t) > MAX_QUESTION, "too_long")
        .when(marks == 0, "no_question")
        .when(marks > 1, "several_questions")
        .when(list_like(t), "list")
        .when(sentences(t) > MAX_QUESTION_SENTENCES, "too_many_sentences")
        .otherwise("ok")
    )


def prose_verdict(t: Column) -> Column:
    """Prose asks nothing: no question mark and fewer than two requests. Lists are content."""
    return (
        F.when(F.contains(t, F.lit("?")), "question_in_prose")
        .when(F.regexp_count(t, F.lit(IMPERATIVE)) >= 2, "request_dump")
        .otherwise("ok")
    )


def preamble_verdict(t: Column) -> Column:
    """A lead-in may be missing; it is short and asks nothing."""
    return (
        F.when(F.char_length(t) > MAX_PREAMBLE, "too_long")
        .when(F.contains(t, F.lit("?")), "question_in_preamble")
        .when(sentences(t) > MAX_PREAMBLE_SENTENCES, "too_many_sentences")
        .otherwise("ok")
    )


def rendered(preamble: Column, question: Column) -> Column:
    """What the reader sees: the lead-in, a blank line, the question."""
    lead = strip(preamble)
    return F.when(blank(preamble), strip(question)).otherwise(F.concat_ws("\n\n", lead, strip(question)))


def rendered_verdict(t: Column) -> Column:
    """The whole message the reader gets holds exactly one question."""
    return (
        F.when(t == "", "empty")
        .when(F.char_length(t) > MAX_RENDERED, "too_long")
        .when(count_of(t, "?") != 1, "not_one_question")
        .otherwise("ok")
    )


def first_question(text: Column) -> Column:
    """The first question of a text, without list mark and bold; null if there is none."""
    found = F.when(F.contains(text, F.lit("?")), F.regexp_extract(text, ONE_QUESTION, 1))
    q = strip(F.regexp_replace(found, r"(?U)\s+", " "))
    q = F.regexp_replace(q, r"(?U)^(\d+[.)]|[-*•])\s*", "")
    q = F.regexp_replace(q, r"(?d)\*\*(.+?)\*\*", "$1")
    return F.when(q != "", q)


def plain_reply(text: Column) -> Column:
    """Lower case, every sign a space, no space at the ends. Inner spaces stay as they are."""
    lowered = F.lower(strip(F.coalesce(text, F.lit(""))))
    return strip(F.regexp_replace(lowered, rf"(?U)[^{WORD}\s]", " "))


def is_dont_know(text: Column, phrases: Sequence[str] = DONT_KNOW) -> Column:
    t = plain_reply(text)
    whole = sorted({*phrases, *(p.replace(" ", "") for p in phrases)})
    known = t.isin(whole)
    for phrase in phrases:
        known = known | t.startswith(phrase + " ")
    return known


EDGE = "\u0001"  # stands at both ends of each word


def edged(text: Column) -> Column:
    """White space between edges, so that an option is found only from word end to word end."""
    return F.concat(F.lit(EDGE), F.regexp_replace(text, r"(?U)(\s)", f"{EDGE}$1{EDGE}"), F.lit(EDGE))


def reply_words(text: Column) -> Column:
    """A reply to look for options in; null if nothing is left of it."""
    return F.nullif(edged(plain_reply(text)), F.lit(EDGE * 2))


def option_words(options: Column) -> Column:
    """What to look for in a reply, one string for each option that has words."""
    return F.transform(F.filter(F.transform(options, plain_reply), lambda o: o != ""), edged)


def match_choice(text: Column, options: Column) -> Column:
    """The first option, in list order, that the reply equals or holds as whole words; else null."""

    def fits(t: Column, o: Column) -> Column:
        return (o != "") & F.contains(t, edged(o))

    # the one-element array binds the cleaned reply, so that it is made once and not once per option
    once = F.array(F.when(options.isNotNull(), edged(plain_reply(text))))
    found = F.transform(
        once,
        lambda t: F.when(
            t != EDGE * 2, F.try_element_at(F.filter(options, lambda o: fits(t, plain_reply(o))), F.lit(1))
        ),
    )
    return F.element_at(found, 1)


def slug(text: Column) -> Column:
    """Lower-case file-name form of a text, 40 characters at most, 'product' if nothing is left."""
    dashed = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), rf"[^{WORD}]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"^[-_]+|[-_]+$", ""), 1, 40)
    return F.when(cut == "", "product").otherwise(cut)


def product_name_verdict(name: Column) -> Column:
    raw = strip(F.coalesce(name, F.lit("")))
    made = slug(raw)
    return (
        F.when((raw == "") | (F.char_length(raw) > 120), "length")
        .when((F.char_length(made) < 3) | (made == "product"), "meaningless")
        .otherwise("ok")
    )


def md_to_html(text: Column) -> Column:
    """Markdown as the few tags a chat client takes; escaping comes first."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    # What becomes of each mark, in this order.
    for pattern, tag in (
        (r"(?d)\*\*(.+?)\*\*", "<b>$1</b>"),
        (r"(?dmU)^\s{0,3}#{1,6}\s*(.+?)\s*$", "<b>$1</b>"),
        (r"(?dmU)^(\s*)[-*]\s+", "$1• "),
        (r"(?U)(?<!\*)\*(?!\s)([^*\n]+?)\*(?!\*)", "<i>$1</i>"),
        (rf"(?U)(?<![{WORD}])_(?!\s)([^_\n]+?)_(?![{WORD}])", "<i>$1</i>"),
        (r"`([^`\n]+?)`", "<code>$1</code>"),
    ):
        text = F.regexp_replace(text, pattern, tag)
    return text


NAME = "[A-Za-z0-9_-]*"
SECRET_PAIR = rf"(?i)((?:{SENSITIVE}){NAME}\"?\s*[=:]\s*\"?)([^\s\",;]+)"
SECRET_KINDS = {"token": "token", "secret": "secret", "password": "password", "api_key": "api[_-]?key",
                "authorization": "authorization", "dsn": "dsn"}


def redact_text(text: Column) -> Column:
    """Free text with the values after sensitive names hidden, as in ``name = value``."""
    return F.regexp_replace(text, SECRET_PAIR, f"$1{REDACTED}")


def secret_names(text: Column) -> Column:
    """The sensitive names that are followed by a value, as an array in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(SECRET_PAIR), 1), F.lower)


def secret_kinds(names: Column) -> dict[str, Column]:
    """How many of the names are of each kind."""

    def of_kind(pattern: str) -> Column:
        return F.size(F.filter(names, lambda name: name.rlike(pattern))).cast("bigint")

    return {kind: of_kind(pattern) for kind, pattern in SECRET_KINDS.items()}
