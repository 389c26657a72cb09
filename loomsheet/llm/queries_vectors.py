"""The registered query of vector codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import vectors
from .common import table


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.encode(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _sql() -> str:
    """All distances of all parts and entries, in each round."""
    steps = ""
    for k in range(vectors.ROUNDS + 1):
        steps += f"""
, far_{k} AS (
  SELECT x.rid, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS d FROM cells x JOIN book_{k} b ON x.part = b.part AND x.place = b.place GROUP BY x.rid, x.part, b.entry
), near_{k} AS (
  SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM far_{k} GROUP BY rid, part
)"""
        if k < vectors.ROUNDS:
            steps += f"""
, mean_{k} AS (
  SELECT x.part, n.entry, x.place, sum(x.x)::HUGEINT AS s, count(*) AS m FROM cells x JOIN near_{k} n ON x.rid = n.rid AND x.part = n.part GROUP BY x.part, n.entry, x.place
), book_{k + 1} AS (
  SELECT part, entry, place, coalesce((s - ((s % m) + m) % m) // m, x)::BIGINT AS x FROM book_{k} LEFT JOIN mean_{k} USING (part, entry, place)
)"""
    last = vectors.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {vectors.PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT rid, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {vectors.PARTS} AS w FROM kept
), cells AS (
  SELECT rid, i // w AS part, i % w AS place, floor({vectors.SCALE} * x::DOUBLE)::BIGINT AS x FROM flat
), book_0 AS (
  SELECT part, rid - 1 AS entry, place, x FROM cells WHERE rid <= {vectors.ENTRIES}
){steps}
, coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near_{last} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book_{last}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


ORACLE_SQL = {"op13_vector_codes": _sql()}
