"""All queries of the library and the SQL that must give the same rows; queries without SQL are held to tests."""

from __future__ import annotations

from corpusmill.plans import file_queries, function_queries, transcript_queries  # noqa: F401  they register their queries beside the others
from corpusmill.plans.corpus_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
