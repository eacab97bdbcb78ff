"""The text rules as DuckDB expressions, for the oracles: RE2 has neither look-around nor Unicode classes."""

from __future__ import annotations

SPACE = r"[\s\p{Z}]"
WORD = r"\p{L}\p{N}_"
REQUESTS = "расскажи|опиши|назови|перечисли|укажи|уточни|дай|напиши|поясни|объясни|сформулируй|ответь"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def marks(x: str) -> str:
    return f"translate(coalesce({x}, ''), '？؟⁇︖﹖', '?????')"


def count(x: str, sign: str) -> str:
    return f"(length({x}) - length(replace({x}, '{sign}', '')))"


def sentences(t: str) -> str:
    return (
        f"len(list_filter(string_split_regex({t}, '[.!?]+({SPACE}|$)'), lambda p: {strip('p')} <> ''))"
    )


def listy(t: str) -> str:
    return rf"(regexp_matches({t}, '(?m)(^{SPACE}*|{SPACE})(\p{{Nd}}+[.)]|[-*•]){SPACE}+') or {count(t, ';')} >= 2)"


def question(t: str, raw: str) -> str:
    """``t``: the normalised, stripped text."""
    return (
        f"case when {strip(f'coalesce({raw}, chr(32))')} = '' then 'empty' when length({t}) > 400 then 'too_long' "
        f"when {count(t, '?')} = 0 then 'no_question' when {count(t, '?')} > 1 then 'several_questions' "
        f"when {listy(t)} then 'list' when {sentences(t)} > 3 then 'too_many_sentences' else 'ok' end"
    )


def prose(t: str) -> str:
    pattern = rf"(?im)(^|[\n;]|\p{{Nd}}+[.)]{SPACE}*|[-*•]{SPACE}*){SPACE}*({REQUESTS})([^{WORD}]|$)"
    return (
        f"case when {t} = '' then 'ok' when contains({t}, '?') then 'question_in_prose' "
        f"when len(regexp_extract_all({t}, '{pattern}')) >= 2 then 'request_dump' else 'ok' end"
    )


def preamble(t: str) -> str:
    return (
        f"case when {t} = '' then 'ok' when length({t}) > 1200 then 'too_long' "
        f"when contains({t}, '?') then 'question_in_preamble' "
        f"when {sentences(t)} > 12 then 'too_many_sentences' else 'ok' end"
    )


def rendered(t: str) -> str:
    return (
        f"case when {t} = '' then 'empty' when length({t}) > 1800 then 'too_long' "
        f"when {count(t, '?')} <> 1 then 'not_one_question' else 'ok' end"
    )


def first_question(x: str) -> str:
    q = f"nullif(regexp_extract({x}, '([^.!?\\n]{{3,}}\\?)', 1), '')"
    q = strip(f"regexp_replace({q}, '{SPACE}+', ' ', 'g')")
    q = f"regexp_replace({q}, '^(\\p{{Nd}}+[.)]|[-*•]){SPACE}*', '')"
    return f"nullif(regexp_replace({q}, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '')"


def plain_reply(x: str) -> str:
    return strip(f"regexp_replace(lower({strip(x)}), '[^{WORD}\\s\\p{{Z}}]', ' ', 'g')")


def dont_know(t: str) -> str:
    phrases = ["не знаю", "незнаю", "не в курсе", "хз", "понятия не имею", "затрудняюсь",
               "не могу сказать", "idk", "dunno", "no idea"]
    tests = [f"{t} = '{p}' or starts_with({t}, '{p} ') or {t} = '{p.replace(' ', '')}'" for p in phrases]
    return "(" + " or ".join(tests) + ")"


def whole_word(t: str, o: str) -> str:
    return f"regexp_matches({t}, concat('(^|[^{WORD}])', {o}, '([^{WORD}]|$)'))"


def slug(x: str) -> str:
    dashed = f"regexp_replace(lower({strip(x)}), '[^{WORD}]+', '-', 'g')"
    return f"coalesce(nullif(left(regexp_replace({dashed}, '^[-_]+|[-_]+$', '', 'g'), 40), ''), 'product')"
