"""Registered queries of the duplicate finders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .line_dedup import deduplicate_lines
from .simhash import hex_of, simhash_groups
from .substring_dedup import remove_repeats
from .vector_dedup import near_vectors


def op10_simhash_bktree(spark, sf_dir):
    """One row per document: fingerprint and group."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(out["id"].alias("doc_id"), hex_of(out["fp"]).alias("fingerprint"), "component_id")


def op5_substring_debruijn(spark, sf_dir):
    """One row per document: words, removed words and the digest of what stays."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_line_windows(spark, sf_dir):
    """One row per document: lines, removed lines and the digest of what stays."""
    out = deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB: lines by number, windows of three filled lines, all but the first of equal windows, covered lines out.
OP6_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
filled AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS f
           FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (SELECT doc_id, f, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
        FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY f)),
later AS (SELECT doc_id, f FROM (SELECT doc_id, f, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, f) AS n
          FROM win WHERE c IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT x.doc_id, x.i FROM filled x JOIN later l
         ON x.doc_id = l.doc_id AND x.f BETWEEN l.f AND l.f + 2),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
         FROM line l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN 0 ELSE len(s.lines) END AS n_lines,
       coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""


def op4_embedding_tiles(spark, sf_dir):
    """One row per vector: its links, its component and whether it stays."""
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs of a label in double precision; components by a recursive walk that keeps the smallest id.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN n ON e.vec_id = n.a
"""


#: Windows by their words, occurrences counted, covered places out; ids are unique in the table.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win SEMI JOIN rep ON win.h = rep.h),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t, count(*) AS n
         FROM word ANTI JOIN cov ON word.doc_id = cov.doc_id AND word.i = cov.i GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


QUERIES = {
    "op4_embedding_tiles": op4_embedding_tiles,
    "op5_substring_debruijn": op5_substring_debruijn,
    "op6_line_windows": op6_line_windows,
    "op10_simhash_bktree": op10_simhash_bktree,
}
ORACLES: dict[str, str] = {"op5_substring_debruijn": OP5_SQL, "op4_embedding_tiles": OP4_SQL, "op6_line_windows": OP6_SQL}
