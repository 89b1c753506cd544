"""Queries and reference SQL of the training-data operators."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontaminate import op1_decontaminate
from .exact_topk import op13_topk
from .fingerprint import op7_fingerprint
from .html_extract import op5_html_extract
from .near_dup import op10_near_dup
from .pii import op3_pii
from .prefix_trie import op12_prefix_trie
from .quality import op2_quality
from .substring_dedup import op4_substring_dedup
from .token_store import op8_token_store
from .warc import op9_warc
from .whitening import op11_whitening

def pipeline(spark, sf_dir: str):
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extract": op5_html_extract,
    "op6_bpe": op6_bpe,
    "op7_fingerprint": op7_fingerprint,
    "op8_token_store": op8_token_store,
    "op9_warc": op9_warc,
    "op10_near_dup": op10_near_dup,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_topk": op13_topk,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n),
hits AS (
  SELECT s.doc_id, s.i, s.n, g.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM spots) s JOIN grams g ON s.n = g.n AND s.g = g.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN found f ON w.doc_id = f.doc_id
""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(((CAST('0x' || substr(h || '00', CAST(5 * i // 4 + 1 AS BIGINT), 3) AS INTEGER) >> CAST(7 - 5 * i % 4 AS INTEGER)) & 31) + 1 AS BIGINT)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own,
         list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS sizes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)),
heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM turns, bits),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1 : h.h], a.own[h.h + 1 :]) AS path, list_concat(coalesce(b.sizes, [])[1 : h.h], a.sizes[h.h + 1 :]) AS sizes
  FROM turns a JOIN heads h ON a.conv_id = h.conv_id LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100),
spots AS (SELECT conv_id, path, sizes, unnest(range(0, len(path) + 1)) AS d FROM built),
nodes AS (
  SELECT path[1 : d] AS node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(coalesce(sizes[d], 0)) AS size,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = d), '') AS ends
  FROM spots GROUP BY 1, 2),
kids AS (SELECT node[1 : d - 1] AS up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT a.node, a.n, a.size, k.up IS NULL AS leaf, unnest(range(0, a.d + 1)) AS e FROM nodes a LEFT JOIN kids k ON k.up = a.node),
sums AS (SELECT node[1 : e] AS top, sum(CAST(leaf AS BIGINT)) AS leaves, sum((n - 1) * size) AS saved FROM below GROUP BY 1)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN sums s ON s.top = a.node LEFT JOIN kids k ON k.up = a.node LEFT JOIN nodes p ON a.d > 0 AND p.node = a.node[1 : a.d - 1]
""",
    "op13_topk": r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
""",
}
