"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusmill.llm import conversation_repair, decontaminate, embedding_dedup, jaccard_join, license_scan, line_templates, merkle, mixing, quality, substring_dedup, suffix_tree_lm, topk, toxicity

QUERIES = {
    "op1_quality_classifier": quality.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_ngram_jaccard_join": jaccard_join.op3,
    "op4_source_mixing": mixing.op4,
    "op5_benchmark_decontamination": decontaminate.op5,
    "op6_lm_scoring": suffix_tree_lm.op6,
    "op7_line_dedup": line_templates.op7,
    "op8_license_scan": license_scan.op8,
    "op9_exact_topk": topk.op9,
    "op10_toxicity": toxicity.op10,
    "op11_conversation_repair": conversation_repair.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_embedding_dedup": embedding_dedup.op13,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
d AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
x AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL), '') AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

OP5_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
t AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM t WHERE len(ws) > 0)),
z AS (SELECT DISTINCT size FROM i),
d AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, z WHERE len(ws) >= size)),
h AS (SELECT d.doc_id, d.size, d.i, i.item_id FROM d JOIN i ON d.size = i.size AND d.win = i.win),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items, sha256(coalesce(x.items, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""

SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_source_mixing": mixing.OP4_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op7_line_dedup": line_templates.OP7_SQL,
    "op9_exact_topk": topk.OP9_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_embedding_dedup": embedding_dedup.OP13_SQL,
}
