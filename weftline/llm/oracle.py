"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
bits AS (
  SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, i::int + 1, 1)) - 1) AS nibble FROM h
),
d AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}',
      1 + list_sum(list_transform(range(5), lambda j:
        ((nibble[((5 * k + j) // 4)::int + 1] >> (3 - (5 * k + j) % 4)::int) & 1) << (4 - j)::int))::int, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM bits
)
SELECT page_id, payload_bytes::bigint AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents
),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark
),
items AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, whole GROUP BY term, n_docs),
ms AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM lengths, whole),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN ms USING (doc_id) GROUP BY ALL
),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9, "op11_exact_topk": OP11, "op13_ranked_search": OP13}
