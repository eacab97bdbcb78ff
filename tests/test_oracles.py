"""Every registered query against its SQL on the same tables."""

import pytest
from compare import differences
from conftest import SMALL

import __spark_entry__ as entry

JOBS, SQL = entry.queries(), entry.oracle_sql()
# queries whose rows run through ordered scans or folds
ORDERED = [
    "entitlement_ledger", "ledger_balances", "session_lifecycle", "illegal_transitions", "pending_choice",
    "double_user_rows", "verbatim_reask", "answer_resolution", "skip_handling", "order_gate", "adr_numbering",
    "step_progression", "step_progression_small_caps", "version_change", "tool_replay", "alert_restarts",
    "overload_bursts", "stream_entitlement_ledger", "stream_pending_choice",
]


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query_matches_sql(spark, duck, name):
    rows, diff = differences(spark, duck, name, JOBS[name], SQL.get(name), SMALL)
    assert not diff, diff
    assert rows > 0 or name in {"missing_steps"}


@pytest.mark.parametrize("name", ORDERED)
def test_split_hot_keys_change_nothing(hot, duck, name):
    if name == "tool_replay":
        hot.conf.set("runlens.hotKeyRows", "40")
    rows, diff = differences(hot, duck, name, JOBS[name], SQL[name], SMALL)
    assert not diff, diff


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(JOBS)


VARIETY = {
    "entitlement_ledger": ("outcome", {"free", "paid", "owner", "resumed", "needs_payment", "delivered",
                                       "refunded_free", "refunded_paid", "no_refund", "ignored", "credited"}),
    "valid_payments": ("verdict", {"ok", "currency", "amount", "payload"}),
    "answer_resolution": ("reason", {"need_clarify", "clarify_budget_exhausted", "user_said_unknown",
                                     "deterministic_choice_match", "llm_answer"}),
    "skip_handling": ("reason", {"user_skip"}),
    "step_progression": ("outcome", {"advanced", "overwritten", "skip_ahead", "unknown_step", "question_open"}),
    "step_progression_small_caps": ("outcome", {"session_full", "too_large"}),
    "version_change": ("outcome", {"changed", "has_artifacts", "unknown_version"}),
    "order_gate": ("fate", {"executed", "gated", "skipped"}),
    "retryable_attempts": ("class", {"ok", "retryable", "fatal"}),
    "prose_lint": ("prose", {"ok", "question_in_prose", "request_dump"}),
    "question_lint": ("question", {"ok", "no_question", "several_questions", "too_long"}),
    "unresolved_markers": ("state", {"unresolved", "resolved"}),
    "drift_split": ("kind", {"drift", "evolution"}),
    "artifact_route": ("fate", {"moves", "stays", "unmapped"}),
    "alert_restarts": ("state", {"fired", "resolved"}),
}


@pytest.mark.parametrize("name", sorted(VARIETY))
def test_both_outcomes_occur(duck, name):
    column, wanted = VARIETY[name]
    seen = {r[0] for r in duck.execute(f"select distinct {column} from ({SQL[name]})").fetchall()}
    assert wanted <= seen
