"""Names of the training-data queries, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidelane.llm import chat, decontaminate, html, jaccard, langid, licenses, linededup, mixing, quality, resample, sharding, spelling, warc

MODULES = [quality, decontaminate, linededup, html, langid, warc, chat, mixing, licenses, jaccard, sharding, spelling, resample]


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {n: f for m in MODULES for n, f in vars(m).items() if n.startswith("op") and n[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict:
    return {n: sql for m in MODULES for n, sql in getattr(m, "ORACLE_SQL", {}).items()}
