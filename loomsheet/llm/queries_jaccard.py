"""The registered query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard
from .common import table

WORDS, PERCENT = 3, 90


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), WORDS, PERCENT)


def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4_jaccard, with how many other sets of shingles are similar to the document's."""
    return jaccard.join(table(spark, sf_dir, "documents"), WORDS, PERCENT, count_links=True)


QUERIES = {"op4_jaccard": op4_jaccard, "op4_jaccard_links": op4_jaccard_links}

# All pairs that share a shingle, then what links reach: exact, and only for small tables.
ORACLE_SQL = {
    "op4_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(r) AS component_id FROM sets JOIN reach ON sets.doc_id = reach.doc_id GROUP BY sets.doc_id, s
""",
    "op4_jaccard_links": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), flat AS (
  SELECT doc_id, md5(array_to_string(s, chr(10))) AS h, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.h AS hx, b.h AS hy FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.h, b.h, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), counts AS (
  SELECT x, count(DISTINCT hy) AS n_links FROM links WHERE hx <> hy GROUP BY x
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(r) AS component_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links
FROM sets JOIN reach ON sets.doc_id = reach.doc_id LEFT JOIN counts ON sets.doc_id = counts.x GROUP BY sets.doc_id, s
""",
}
