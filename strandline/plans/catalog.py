"""Every registered query of the library, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from strandline.plans import citations, coverage, evaluation, events, graphs, ingest, linking, links, missions, paths, publication, records, reports, resolution, rows, rules, sources, summaries, texts
from strandline.plans.registry import QUERIES, SQL

MODULES = (rows, summaries, events, citations, coverage, evaluation, texts, graphs, ingest, linking, links, missions, paths, publication, records, rules, resolution, reports, sources)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
