"""Run tables derived from the driver's parquet tables.

Each view is written once, in SQL both Spark and DuckDB accept, so an operator and its oracle read the same
rows. The few words the dialects spell differently are marked: ``div`` (integer division), ``{us}`` (micros
since 1970 of ``ts``), ``{row_json}``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The schemas of the tables the views read, stated so that no job has to look them up.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}
# from the parts of the local time, so that the session's time zone plays no role
SPARK_US = (
    "(unix_date(to_date(ts)) * 86400000000L + (hour(ts) * 60L + minute(ts)) * 60000000L "
    "+ cast(extract(second from ts) * 1000000 as bigint))"
)
DUCK_US = "epoch_us(ts)"


@dataclass(frozen=True)
class View:
    source: str
    columns: tuple[str, ...]
    where: str = ""
    distinct: bool = False

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.over(load(spark, sf_dir, self.source))

    def over(self, df: DataFrame) -> DataFrame:
        """The view on a table or stream of its source."""
        if self.where:
            df = df.filter(self.where)
        df = df.selectExpr(*[c.replace("{us}", SPARK_US) for c in self.columns])
        return df.distinct() if self.distinct else df

    def duck(self) -> str:
        columns = ", ".join(self.columns).replace("{us}", DUCK_US).replace(" div ", " // ")
        where = f" where {self.where.replace(' div ', ' // ')}" if self.where else ""
        return f"select {'distinct ' if self.distinct else ''}{columns} from {self.source}{where}"


KIND = (
    "case event_type when 'signup' then 'start' when 'purchase' then 'pay' when 'click' then 'finish' "
    "when 'error' then 'abandon' else 'message' end as kind"
)
VERSION = "case {0} % 3 when 0 then 'full' when 1 then 'lite' else 'spec_only' end"
RUN = "(doc_id div 13)"
PLACE = f"(case when {RUN} % 5 = 4 then (doc_id % 13) * 7 else doc_id % 13 end)"


VIEWS: dict[str, View] = {
    "v_run_events": View("events", ("event_id", "{us} as us", "user_id", KIND)),
    "v_payments_raw": View(
        "events",
        (
            "event_id",
            "{us} as us",
            "user_id",
            "concat('ch', event_id % (user_id + 90)) as charge_id",
            "case when event_id % 11 = 0 then 'USD' else 'XTR' end as currency",
            "case when event_id % 13 = 0 then 5 else 100 end as amount",
            "concat('run:', case when event_id % 17 = 0 then 0 else user_id end) as payload",
        ),
        "event_type = 'purchase'",
    ),
    "v_owners": View("events", ("user_id",), "user_id % 10 = 0", distinct=True),
    "v_beta": View("events", ("user_id",), "user_id % 3 = 1", distinct=True),
    "v_users": View("events", ("user_id",), distinct=True),
    "v_updates": View(
        "events",
        (
            "event_id",
            "{us} as us",
            "user_id",
            "case when event_type in ('signup', 'click') then 'pick' when event_type = 'error' then 'reset' "
            "else 'message' end as kind",
            "case when event_type in ('signup', 'click') then case event_id % 4 when 0 then 'full' "
            "when 1 then 'lite' when 2 then 'spec_only' else 'pro' end end as version",
        ),
    ),
    "v_id_lists": View(
        "events",
        (
            "event_id",
            "case event_id % 4 when 0 then concat(user_id, ', ', event_id, ',x', user_id) "
            "when 1 then concat(' ', user_id, ' ,,-5') when 2 then 'none' else concat(user_id, ',', user_id) end as csv",
        ),
    ),
    "v_answers": View(
        "events",
        (
            "user_id as session_id",
            "event_id as seq",
            "case event_type when 'click' then 'answer' when 'view' then 'partial' else 'offtopic' end as verdict",
            "case event_type when 'signup' then 'не знаю' when 'purchase' then 'думаю, Скорость!' "
            "else case when event_id % 9 = 0 then 'Незнаю.' when event_id % 9 = 1 then 'хз скорее' "
            "when event_id % 9 = 2 then 'скоростью важен результат' else 'мой ответ' end end as reply",
            "event_id % 2 = 0 as has_options",
            "event_type = 'error' and event_id % 5 = 0 as skipped",
        ),
    ),
    "v_attempts": View(
        "events",
        (
            "event_id div 6 as turn_id",
            "event_id as attempt_id",
            "{us} as us",
            "concat('svc', user_id % 3) as service",
            "case when event_type = 'error' then case event_id % 6 when 0 then 529 when 1 then 429 "
            "when 2 then 503 when 3 then 400 else null end else 200 end as status_code",
            "case when event_type = 'error' then case event_id % 6 when 4 then 'APITimeoutError' "
            "when 5 then 'ValueError' end end as error",
            "case when event_type = 'error' and event_id % 4 = 0 then value end as retry_after",
            "case when event_type = 'error' then event_id % 40 else event_id % 7 end as wait_s",
        ),
        "event_type in ('error', 'view')",
    ),
    "v_metrics": View(
        "events",
        ("concat('app', user_id % 3) as app", "{us} as us", "cast(round(value * 100) as bigint) as cents"),
    ),
    "v_logs": View(
        "events",
        (
            "concat('app', user_id % 3) as app",
            "{us} as us",
            "case when event_type = 'error' then case event_id % 3 when 0 then 'ProbeFailed' "
            "when 1 then 'revisionfailed' else 'Failed' end else 'Started' end as reason",
            "case event_id % 8 when 0 then concat('probe failed for replica ', user_id) "
            "when 1 then 'Traceback (most recent call last)' when 2 then 'subcontainer failedover' "
            "when 3 then 'Container Failed: exit 1' when 4 then 'CRITICAL: second poller' else event_type end as log",
        ),
    ),
    "v_turns": View(
        "events",
        (
            "event_id",
            "case user_id % 3 when 0 then 'full' when 1 then 'lite' else 'spec_only' end as version",
            "case when event_type = 'error' then 'max_tokens' when event_type = 'view' then 'end_turn' "
            "else 'tool_use' end as stop_reason",
        ),
    ),
    "v_tool_calls": View(
        "events",
        (
            "user_id as session_id",
            "event_id as seq",
            "event_id div 400 as turn_id",
            "case event_id % 9 when 0 then 'save_artifact' when 1 then 'assess_answer' when 2 then 'ask_question' "
            "when 3 then 'save_artifact' when 4 then 'set_version' when 5 then 'create_adr' "
            "when 6 then 'set_product_name' when 7 then 'finish' else 'drop_table' end as name",
            "case event_id % 9 "
            "when 0 then concat('{\"step_id\":\"L', 1 + user_id % 4, '\",\"markdown\":\"m', event_id, '\"}') "
            "when 1 then concat('{\"verdict\":\"', case event_type when 'click' then 'answer' when 'view' then 'partial' "
            "when 'error' then 'offtopic' when 'signup' then 'answer' else 'maybe' end, '\"}') "
            "when 2 then concat('{\"question\":\"', event_type, case when event_id % 7 = 0 then '? how' else '' end, '?\"}') "
            "when 3 then concat('{\"step_id\":\"L', 1 + event_id % 4, '\",\"markdown\":', "
            "case when event_id % 5 = 0 then '7' else '\"body\"' end, '}') "
            "when 4 then concat('{\"version\":\"', case event_id % 5 when 0 then 'lite' when 1 then 'full' "
            "when 2 then 'spec_only' when 3 then 'lite' else 'pro' end, '\"}') "
            "when 5 then concat('{\"title\":\"T', event_id, '\"', case when event_id % 4 = 0 then '' "
            "else ',\"markdown\":\"because\"' end, '}') "
            "when 6 then concat('{\"name\":', case when event_id % 5 = 1 then 'null' else concat('\"', event_type, ' ', user_id, '\"') end, '}') "
            "else '{}' end as args",
            "case event_type when 'signup' then 'не знаю' when 'purchase' then 'скорость' else 'мой ответ' end as reply",
        ),
    ),
    # calls with options, lead-ins, remarks and texts over the cap
    "v_rich_calls": View(
        "events",
        (
            "user_id as session_id",
            "event_id as seq",
            "event_id div 400 as turn_id",
            f"{VERSION.format('user_id')} as version",
            "case event_id % 7 when 0 then 'save_artifact' when 1 then 'ask_question' when 2 then 'ask_question' "
            "when 5 then 'create_adr' when 6 then 'set_version' else 'assess_answer' end as name",
            "case event_id % 7 "
            "when 0 then concat('{\"step_id\":\"L', 1 + event_id % 4, '\",\"markdown\":\"', "
            "case when event_id % 5 = 0 then repeat('я', 10001) else 'm' end, '\"}') "
            "when 5 then concat('{\"title\":\"T\",\"markdown\":\"', case when event_id % 3 = 0 then '' else 'b' end, '\"}') "
            "when 6 then concat('{\"version\":\"', case event_id % 3 when 0 then 'full' when 1 then 'lite' else 'pro' end, '\"}') "
            "when 1 then concat('{\"question\":\"', event_type, '?\"', "
            "case event_id % 4 when 0 then ',\"preamble\":\"начнём.\"' when 1 then ',\"preamble\":\"а что?\"' when 2 then ',\"preamble\":7' else '' end, '}') "
            "when 2 then concat('{\"question\":\"', event_type, '?\"', "
            "case event_id % 3 when 0 then ',\"options\":[\"скорость\",\"цена\",7]' when 1 then ',\"options\":\"скорость\"' "
            "else ',\"options\":[\"Цена!\"]' end, '}') "
            "else concat('{\"verdict\":\"', case event_type when 'click' then 'answer' when 'view' then 'partial' else 'offtopic' end, '\"', "
            "case event_id % 5 when 0 then ',\"missing\":\"срок\"' when 1 then ',\"missing\":[\"срок\"]' else '' end, '}') end as args",
            "case event_type when 'signup' then 'не знаю' when 'purchase' then 'Скорость, да' when 'error' then 'цена' else 'мой ответ' end as reply",
        ),
    ),
    "v_messages": View(
        "conversations",
        (
            "conv_id as session_id",
            "turn as id",
            "case when (conv_id + turn) % 5 = 0 then 'user' else role end as role",
            "case when (conv_id + turn) % 3 = 0 then concat(text, '?') "
            "when (conv_id + turn) % 7 = 0 then concat('1) ', text, '? ', text, '？') "
            "when (conv_id + turn) % 11 = 0 then concat('Опиши боль\n2. Назови срок ', text) "
            "when (conv_id + turn) % 13 = 0 then '   ' "
            "when (conv_id + turn) % 17 = 1 then concat(text, '; a; b; **c**?') else text end as text",
        ),
        "role <> 'system'",
    ),
    "v_rounds": View(
        "conversations",
        (
            "conv_id * 1000 + turn div 7 as turn_id",
            "turn % 7 as round",
            "case (conv_id + turn) % 4 when 0 then 'max_tokens' when 1 then 'end_turn' else 'tool_use' end as stop_reason",
            "case when (conv_id * 3 + turn) % 5 = 0 then concat(text, '?') when (conv_id + turn) % 6 = 1 then '' "
            "when (conv_id + turn) % 11 = 3 then null else text end as text",
            "(conv_id + turn * 2) % 3 as tools",
            "(conv_id + turn * 2) % 3 > 0 and (conv_id + turn) % 5 = 2 as asks",
            "(conv_id + turn * 2) % 3 > 0 and (conv_id + turn) % 5 = 2 and conv_id % 2 = 0 as asked",
            "conv_id % 3 > 0 as active",
            "conv_id % 5 = 0 as open",
        ),
    ),
    "v_sessions": View(
        "conversations",
        (
            "conv_id as id",
            "conv_id div 3 as tg_user_id",
            "concat('product-', conv_id) as slug",
            f"{VERSION.format('conv_id')} as version",
            "case when conv_id % 6 = 5 then '_finish' when conv_id % 3 = 1 then concat('L', 1 + conv_id % 4) "
            "when conv_id % 3 = 2 then concat('F', 8 + conv_id % 4) else concat('F', 1 + conv_id % 11) end as current_step",
            "case when conv_id % 23 = 7 then 'paused' when conv_id % 4 = 1 then 'finished' "
            "when conv_id % 4 = 2 then 'abandoned' else 'active' end as status",
            "case when conv_id % 8 in (0, 4, 7) then concat(text, '?') end as current_question",
            "case conv_id % 5 when 0 then 'answer' when 1 then 'partial' when 2 then 'offtopic' "
            "when 4 then 'maybe' end as last_verdict",
            "cast(conv_id % 4 as int) as clarify_count",
            "cast(2 as int) as clarify_budget",
            "case when conv_id % 2 = 0 then '[\"скорость\",\"регулярность\",\"результат\"]' end as current_options",
            "case conv_id % 7 when 0 then 'none' when 1 then 'paid' when 2 then 'gift' else 'free' end as consumed",
            "conv_id % 4 = 2 as refunded",
        ),
        "turn = 1",
    ),
    "v_artifact_writes": View(
        "documents",
        (
            f"{RUN} as session_id",
            f"{VERSION.format(RUN)} as version",
            f"case when doc_id % 29 = 0 then 'Z9' when {RUN} % 3 = 1 then concat('L', 1 + {PLACE} % 4) "
            f"when {RUN} % 3 = 2 then concat('F', 8 + {PLACE} % 4) else concat('F', 1 + {PLACE} % 11) end as step_id",
            "text as markdown",
            "doc_id as write_no",
        ),
    ),
    "v_adrs": View(
        "documents",
        (
            "doc_id as id",
            "doc_id div 9 as session_id",
            "doc_id % 9 % 7 + 1 as n",
            "concat('Decision ', doc_id) as title",
            "text as markdown",
        ),
    ),
    "v_pieces": View(
        "documents",
        (
            "doc_id div 20 as session_id",
            "doc_id div 4 as turn_id",
            "doc_id % 4 as seq",
            "case when doc_id % 10 < 4 then ' \n ' else text end as text",
        ),
    ),
    "v_names": View(
        "documents",
        (
            "doc_id",
            "doc_id div 5 as user_id",
            "case doc_id % 8 when 0 then '' when 1 then concat('  ', source, ' ', lang, ' ') "
            "when 2 then 'Да!' when 3 then 'Product' when 4 then concat('AI-рекрутер ', doc_id % 40) "
            "when 5 then text when 6 then concat('_', source, ' ', text, '_') "
            "else concat('Бот_', source) end as name",
        ),
    ),
    "v_workspace": View(
        "documents",
        (
            "doc_id div 17 as product",
            "case doc_id % 17 when 0 then '01-northern-star.md' when 1 then '02-vision-story.md' "
            "when 2 then '03-vision-contract-draft.md' when 3 then '04-research-brief.md' "
            "when 4 then '05-research-results.md' when 5 then '06-vision-contract-final.md' when 6 then '06-faq.md' "
            "when 7 then '07-story-sync-check.md' when 8 then '08-architecture.md' when 9 then '08-tech-spec.md' "
            "when 10 then '09-CLAUDE.md' when 11 then '09-README-for-repo.md' when 12 then '10-BACKLOG.md' "
            "when 13 then 'notes.txt' else concat('adr/00', doc_id % 17 - 13, '-', lang, '.md') end as file_name",
            "text",
            "doc_id",
        ),
    ),
    "v_contracts": View(
        "documents",
        (
            "doc_id",
            "concat('# Vision Contract Draft: ', source, '\n\n## Блок A. Проблема\n\n', lang, "
            "'\n[NEEDS CLARIFICATION: who pays for ', source, ']\n\n', "
            "case when doc_id % 6 = 0 then '' else '## Блок B. Аудитория\n\nперсона\n\n' end, "
            "'## Блок C. Решение\n\n1. сценарий ', lang, ' [НУЖНО УТОЧНИТЬ: срок ', doc_id % 7, ']\n\n', "
            "'## Блок D. Ограничения\n\n**НЕ делаем:**\n', "
            "case doc_id % 3 when 0 then '- маркет\n- чат\n' else '- маркет\n- чат\n* почта\n- звонки\n- биллинг\n' end, "
            "'\n## Блок E. Успех\n\n', text, '\n') as draft",
            "concat('# Vision Contract: ', source, '\n\n## Блок A. Проблема\n\n', "
            "case when doc_id % 4 = 0 then concat('[NEEDS CLARIFICATION: who pays for ', source, ']') else 'решено' end, "
            "'\n\n## Блок C. Решение\n\n', "
            "case when doc_id % 5 = 0 then concat('[НУЖНО УТОЧНИТЬ: срок ', doc_id % 7, ']') else 'решено' end, '\n', text) as final",
        ),
    ),
    "v_briefs": View(
        "documents",
        (
            "doc_id",
            "concat('# Research Brief: ', source, '\n\n### RQ-01: кто платит за ', lang, '\n\n**Возник из:** Блок A\n', "
            "'**Приоритет:** 🟢 Желательный\n**Способ проверки:**\n- интервью\n- ', replace(text, '\n', ' '), "
            "'\n\n### RQ-02: какой срок\n\n**Приоритет:** ', case when doc_id % 3 = 0 then '🟡 Важный' else '🔴 Критический' end, "
            "'\n', case when doc_id % 4 = 0 then '' else '**Способ проверки:**\n- отзывы\n' end, "
            "'\n### RQ-03: бюджет\n\n**Приоритет:** 🟡 Важный\n**Способ проверки:**\n- счёт\n', "
            "case when doc_id % 7 = 0 then repeat('\n### RQ-09: повтор\n\n**Приоритет:** 🟢\n**Способ проверки:**\n- опрос\n', 13) else '' end) as text",
        ),
    ),
    "v_backlogs": View(
        "documents",
        (
            "doc_id",
            "concat('# BACKLOG: ', source, '\n\n## Задачи\n\n#### T-001: миграция таблицы ', lang, '\n\n**Эпик:** Setup\n"
            "**Размер:** S (≤1 час)\n**Зависимости:** ', case when doc_id % 9 = 0 then 'T-004' else '—' end, "
            "'\n**Можно параллельно с:** T-002\n\n**Definition of Done:**\n\n- [ ] тесты\n- [ ] линтер\n\n', "
            "'#### T-002: ', case when doc_id % 4 = 0 then 'Реализовать модуль ' else 'экран ' end, source, '\n\n**Эпик:** Module: ', lang, "
            "'\n**Размер:** ', case doc_id % 3 when 0 then 'M' when 1 then 'L' else 'XL' end, "
            "'\n**Зависимости:** T-001', case when doc_id % 5 = 0 then ', T-099' else '' end, '\n\n', "
            "case when doc_id % 6 = 0 then '' else '**Definition of Done:**\n\n- [ ] готово\n' end, "
            "'**Связано с ADR:** ADR-00', 1 + doc_id % 3, '\n\n', "
            "'### T-003: проверка\n\n**Эпик:** Testing & QA\n**Размер:** M\n**Зависимости:** T-001, T-002\n\n"
            "**Definition of Done:**\n- [ ] отчёт\n\n', "
            "'### T-004: запуск\n\n**Эпик:** Setup\n**Размер:** S\n**Зависимости:** ', "
            "case when doc_id % 11 = 0 then 'T-004, ' else '' end, 'T-003\n\n**Definition of Done:**\n- [x] ', "
            "replace(replace(text, '#', ''), '\n', ' '), '\n') as text",
        ),
    ),
    "v_adr_files": View(
        "documents",
        (
            "doc_id div 6 as product",
            "doc_id % 6 + 1 as file_no",
            "concat('# ADR-00', doc_id % 6 + 1, ': Выбор ', source, '\n\n**Дата:** 2024-0', 1 + doc_id % 9, '-15\n**Статус:** ', "
            "case doc_id % 4 when 0 then 'Принято' when 1 then 'Пересмотрено' else concat('Заменено на ADR-00', 1 + (doc_id + 2) % 7) end, "
            "'\n**Уровень:** ', case when doc_id % 2 = 0 then 'Продуктовый' else 'Технический' end, "
            "'\n**Связано с:** Vision Contract блок A, ADR-00', 1 + doc_id % 5, '\n\n## Контекст\n\n', text, '\n\n## Решение\n\nберём\n', "
            "case when doc_id % 5 = 0 then '' else '\n## Альтернативы\n\n### Альтернатива A: иначе\n' end, "
            "case when doc_id % 7 = 0 then '' else '\n## Когда пересмотреть\n\n- через год\n' end) as text",
        ),
    ),
    "v_sync_checks": View(
        "documents",
        (
            "doc_id div 6 as product",
            "doc_id as check_no",
            "concat('# Story Sync Check\n\n## Расхождения\n\n- аудитория: сузили, см. ADR-00', 1 + doc_id % 8, '\n', "
            "'- метафора: ', replace(text, '\n', ' '), '\n', "
            "case when doc_id % 3 = 0 then '- скорость пропала из контракта\n- срок сдвинут\n' else '' end, "
            "'\n## Итог\n\n- обновить файл\n') as text",
        ),
    ),
    "v_error_events": View(
        "documents",
        (
            "doc_id",
            "case when doc_id % 11 = 0 then concat('{\"message\": \"tok', doc_id) else "
            "concat('{\"message\": \"boom tok', doc_id, ' and pw', doc_id, 'x\", \"extra\": {\"bot_token\": \"tok', doc_id, "
            "'\", \"user\": {\"Password\": \"pw', doc_id, '\"}, \"text\": \"private\", \"tags\": [\"a_b', doc_id, 'c_d\", "
            "{\"dsn\": \"a_b', doc_id, '\", \"API-key\": \"', doc_id, 'c_\", \"caption\": null}], \"n\": ', doc_id, '}}') end as event",
        ),
    ),
}

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A small file over all cores. A table with a split per core or more is left as it is, so this never
    moves more than one split (spark.sql.files.maxPartitionBytes) per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name].spark(spark, sf_dir)


def duck(views: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views in front, as DuckDB SQL."""
    named = [f"{v} as ({VIEWS[v].duck()})" for v in views.split()]
    return f"with {'recursive ' if recursive else ''}{', '.join(named)}{', ' if body.lstrip().startswith(',') else ' '}{body.lstrip().lstrip(',')}"
