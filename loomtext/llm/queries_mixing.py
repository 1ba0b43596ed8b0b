"""The registered query of mixing, and its SQL."""

from __future__ import annotations

from .common import table
from .mixing import mix_sources


def op9_mixing_sainte_lague(spark, sf_dir):
    """One row per document: its size, its source's size and target, and the words that the mix takes."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select(out["id"].alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS key, md5(coalesce(text, '')) AS tk,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('9:doc:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS seed FROM documents),
src AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY key),
ranked AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS w, row_number() OVER (ORDER BY key) AS rank,
                  source_size * 2 AS cap FROM src),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
                      - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM ranked),
settled AS (SELECT *, (SELECT l.lv FROM levels l WHERE l.lv <= l.cap / l.w ORDER BY l.cap / l.w, l.rank LIMIT 1) AS level FROM levels),
targets AS (SELECT *, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * w) END AS target FROM settled),
seats AS (SELECT *, CAST(floor(sum(target) OVER () / 32 + 0.5) AS BIGINT) AS seats, sum(target) OVER () AS tw, count(*) OVER () AS tn FROM targets),
low AS (SELECT *, CASE WHEN tw > 0 AND seats > tn THEN CAST(floor(target * (seats - tn) / tw + 0.5) AS BIGINT) ELSE 0 END AS low FROM seats),
rest AS (SELECT *, CAST(seats - sum(low) OVER () AS BIGINT) AS rest FROM low),
tried AS (SELECT key, rest, target, unnest(range(low, low + least(rest, CAST(ceil(target / tw * tn * 1.5) AS BIGINT) + 1))) AS k
          FROM rest WHERE target > 0 AND rest > 0),
won AS (SELECT key, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, key, k) AS r FROM tried)
        WHERE r <= rest GROUP BY key),
source AS (SELECT t.key, source_size, target, low + coalesce(won, 0) AS source_quota, CAST(ceil(docs / 1024) AS BIGINT) AS shards
           FROM rest t LEFT JOIN won USING (key)),
dealt AS (SELECT s.*, CAST('0x' || s.seed[1:8] AS BIGINT) % shards AS shard FROM sized s JOIN source USING (key)),
shard0 AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY key, shard),
shard1 AS (SELECT x.*, source_quota, CAST(sum(words) OVER p AS DOUBLE) AS tw, count(*) OVER p AS tn
           FROM shard0 x JOIN source USING (key) WINDOW p AS (PARTITION BY key)),
shard2 AS (SELECT *, CASE WHEN tw > 0 AND source_quota > tn THEN CAST(floor(words * (source_quota - tn) / tw + 0.5) AS BIGINT) ELSE 0 END AS low FROM shard1),
shard3 AS (SELECT *, CAST(source_quota - sum(low) OVER (PARTITION BY key) AS BIGINT) AS rest FROM shard2),
stried AS (SELECT key, shard, rest, words, unnest(range(low, low + least(rest, CAST(ceil(words / tw * tn * 1.5) AS BIGINT) + 1))) AS k
           FROM shard3 WHERE words > 0 AND rest > 0),
swon AS (SELECT key, shard, count(*) AS won FROM (
           SELECT *, row_number() OVER (PARTITION BY key ORDER BY words / (2 * k + 1) DESC, shard, k) AS r FROM stried)
         WHERE r <= rest GROUP BY key, shard),
quota AS (SELECT t.key, t.shard, low + coalesce(won, 0) AS quota, greatest(CAST(ceil(words / 32) AS BIGINT), 1) AS blocks
          FROM shard3 t LEFT JOIN swon USING (key, shard)),
plan AS (SELECT key, shard, blocks, least(quota // blocks, 2) AS times, CASE WHEN quota // blocks >= 2 THEN 0 ELSE quota % blocks END AS extra,
                CAST('0x' || md5('9:block:' || key || ':' || shard)[1:8] AS BIGINT) % blocks AS o FROM quota),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY key, shard ORDER BY seed, tk, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM dealt),
edge AS (SELECT *, b - size AS a, b // 32 AS jb, (b - size) // 32 AS ja FROM laid),
took AS (SELECT e.*, times * size
           + ((((jb + o) * extra) // blocks - (o * extra) // blocks) * 32
              + (((jb + 1 + o) * extra) // blocks - ((jb + o) * extra) // blocks) * (b - jb * 32))
           - ((((ja + o) * extra) // blocks - (o * extra) // blocks) * 32
              + (((ja + 1 + o) * extra) // blocks - ((ja + o) * extra) // blocks) * (a - ja * 32)) AS taken
         FROM edge e JOIN plan USING (key, shard))
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM took JOIN source USING (key)
"""

QUERIES = {"op9_mixing_sainte_lague": op9_mixing_sainte_lague}
ORACLES = {"op9_mixing_sainte_lague": OP9_SQL}
