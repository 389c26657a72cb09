"""All registered queries of this folder, and their SQL where there is any."""

from __future__ import annotations

from . import queries_bpe, queries_html, queries_idstore, queries_jaccard, queries_media, queries_merkle, queries_quality, queries_resharding, queries_spans, queries_tiling, queries_toxicity, queries_vectors

MODULES = (queries_html, queries_spans, queries_jaccard, queries_resharding, queries_bpe, queries_media, queries_tiling, queries_toxicity, queries_quality, queries_idstore, queries_merkle, queries_vectors)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in MODULES for k, sql in getattr(m, "ORACLE_SQL", {}).items()}
