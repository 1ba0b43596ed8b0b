"""The registered query of decontamination."""

from __future__ import annotations

from .common import table
from .decontaminate import find_leaks


def op3_decontaminate_seeds(spark, sf_dir):
    """One row per contaminated document and item, with the best window."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All aligned windows by counting equal words on the diagonals of each document and item.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
x AS (SELECT doc_id, len(ws) AS nd, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d),
y AS (SELECT item_id, len(ws) AS nb, least(len(ws), 16) AS size, unnest(range(len(ws))) AS j, unnest(ws) AS w FROM b WHERE len(ws) >= 8),
m AS (SELECT doc_id, item_id, i, j, i - j AS diagonal, nd, nb, size FROM x JOIN y ON x.w = y.w),
busy AS (SELECT doc_id, item_id, diagonal FROM m GROUP BY ALL HAVING count(*) >= min(size) - min(size) // 5),
s AS (SELECT doc_id, item_id, diagonal, i, nd, nb, size, unnest(range(i - size + 1, i + 1)) AS start FROM m SEMI JOIN busy USING (doc_id, item_id, diagonal)),
c AS (SELECT doc_id, item_id, start AS doc_word, start - diagonal AS item_word, count(*) AS n_equal, min(size) AS size FROM s
      WHERE start >= 0 AND start - diagonal >= 0 AND start + size <= nd AND start - diagonal + size <= nb GROUP BY doc_id, item_id, diagonal, start)
SELECT doc_id, item_id, doc_word, item_word, n_equal FROM c WHERE n_equal >= size - size // 5
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_word, item_word) = 1
"""

QUERIES = {"op3_decontaminate_seeds": op3_decontaminate_seeds}
ORACLES = {"op3_decontaminate_seeds": OP3_SQL}
