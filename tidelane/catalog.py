"""Every query of the library by name, with its SQL for comparison where SQL can say it."""

from __future__ import annotations

from tidelane.plans import audits, checks, credits, curations, dialogues, hooks, records, replays, rollouts, rows, scores, selections, trials, updates

MODULES = [rollouts, records, credits, selections, updates, trials, rows, curations, dialogues, hooks, scores, audits, replays, checks]


def queries() -> dict:
    return {n: f for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {n: s for m in MODULES for n, s in m.SQL.items()}
