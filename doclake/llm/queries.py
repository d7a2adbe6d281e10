"""All registered queries of this package."""

from __future__ import annotations

from doclake.llm import queries_archives, queries_documents, queries_models, queries_vectors

QUERIES = {**queries_vectors.QUERIES, **queries_documents.QUERIES, **queries_models.QUERIES, **queries_archives.QUERIES}
ORACLES = {**queries_vectors.ORACLES, **queries_documents.ORACLES, **queries_archives.ORACLES}
