"""All named queries outside the training-data part."""

from __future__ import annotations

from . import artifacts, audit, corpora, decisions, dense, evidence, proposals, reports, resampling, runs

QUERIES = {**audit.QUERIES, **evidence.QUERIES, **reports.QUERIES, **decisions.QUERIES, **artifacts.QUERIES, **resampling.QUERIES, **corpora.QUERIES, **dense.QUERIES, **runs.QUERIES, **proposals.QUERIES}
SQL = {**audit.SQL, **evidence.SQL, **reports.SQL, **decisions.SQL, **artifacts.SQL, **resampling.SQL, **corpora.SQL, **dense.SQL, **runs.SQL, **proposals.SQL}
