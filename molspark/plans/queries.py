"""All registered queries of the engine."""

from __future__ import annotations

from . import queries_alleles, queries_cassette, queries_ibars, queries_options, queries_qc, queries_reads, queries_sources, queries_umi  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
