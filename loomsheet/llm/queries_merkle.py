"""The registered query of the Merkle manifest: each document's proof, tried with its own or a tampered leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle
from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    spoilt = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.translate("text", UPPER, LOWER))
    found = merkle.manifest(merkle.leaves(docs, F.when(hit, spoilt).alias("spoilt")))
    folded = merkle.folded(F.col("path"), F.coalesce("spoilt", "leaf"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op12_merkle": op12_merkle}


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _sql() -> str:
    leaf = lambda text: "sha256(" + " || ".join([*(_field(c) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"
    spoilt = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c, 0 AS bit FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, s, c, 0 AS step FROM bytes
  UNION ALL
  SELECT doc_id, s, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, step + 1
  FROM (SELECT doc_id, s, step, CASE WHEN step % 8 = 0 THEN xor(c, ascii(s[step // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE step < 8 * length(s))
), hit AS (
  SELECT doc_id AS hit_id FROM crc WHERE step = 8 * length(s) AND xor(c, 4294967295::BIGINT) % 3 = 0
), rows AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN hit_id IS NOT NULL THEN {leaf(spoilt)} END AS spoilt FROM documents LEFT JOIN hit ON doc_id = hit_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, CASE WHEN lang IS NULL THEN '' ELSE '.' || lang END AS tree, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS k FROM rows
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8, n
), root AS (
  SELECT h AS root FROM upper WHERE n = 1
), runs AS (
  SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8
), upper_runs AS (
  SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM upper WHERE n > 1 GROUP BY level, pos // 8
), walk AS (
  SELECT k, tree, 0 AS level, pos, coalesce(spoilt, leaf) AS f, '' AS proof FROM placed
  UNION ALL
  SELECT w.k, w.tree, w.level + 1, w.pos // 8, sha256(array_to_string(hs[:w.pos % 8], '') || f || array_to_string(hs[w.pos % 8 + 2:], '')), proof || array_to_string(hs[:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:], '')
  FROM walk w JOIN runs r ON w.tree = r.tree AND w.level = r.level AND w.pos // 8 = r.run
), reached AS (
  SELECT k, tree, f, proof FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1
), walk_up AS (
  SELECT r.k, 0 AS level, s.pos, f, proof FROM reached r JOIN subroots s ON r.tree = s.tree
  UNION ALL
  SELECT w.k, w.level + 1, w.pos // 8, sha256(array_to_string(hs[:w.pos % 8], '') || f || array_to_string(hs[w.pos % 8 + 2:], '')), proof || array_to_string(hs[:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:], '')
  FROM walk_up w JOIN upper_runs r ON w.level = r.level AND w.pos // 8 = r.run
), ended AS (
  SELECT k, f, sha256(proof) AS proof_sha256 FROM walk_up QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1
)
SELECT p.doc_id, p.leaf, s.h AS subroot, root, proof_sha256, f AS folded_root, f = root AS verified
FROM placed p JOIN ended USING (k) JOIN subroots s ON p.tree = s.tree, root
"""


ORACLE_SQL = {"op12_merkle": _sql()}
