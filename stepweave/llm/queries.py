"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, embedding_dedup, language_id, licenses, mixing, mtree, quality, runs, sentencepiece_nbest, simhash, spelling, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_nbest": sentencepiece_nbest.op1_sentencepiece_nbest,
    "op2_embedding_pca": embedding_dedup.op2_embedding_dedup,
    "op3_warc_bundles": warc.op3_warc_bundles,
    "op4_mix_pivotal": mixing.op4_mix_pivotal,
    "op5_ann_bits": ann.op5_ann_bits,
    "op6_simhash_pivots": simhash.op6_simhash_pivots,
    "op7_toxicity_automata": toxicity.op7_toxicity_automata,
    "op8_license_index": licenses.op8_license_index,
    "op9_language_hd": language_id.op9_language_hd,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_mtree_topk": mtree.op11_mtree_topk,
    "op12_crochemore_runs": runs.op12_crochemore_runs,
    "op13_spelling_grams": spelling.op13_spelling_grams,
}

#: CRC32 in SQL: its table by the rule of its polynomial, then a step a byte.
_CRC = """crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(text: str) -> str:
    """SQL of the CRC32 of a text's UTF-8, crcs being the table."""
    octets = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295)"


#: SQL of the queries whose rows SQL can give. The others rest on trained models, random rounding, XXH64, lattices or
#: approximate search; tests/llm/test_queries.py holds those against plain second versions.
ORACLES: dict[str, str] = {
    "op2_embedding_pca": """WITH RECURSIVE x AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT * FROM x WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(v) AS c) WHERE c IS NULL OR NOT isfinite(c)) AND EXISTS (SELECT 1 FROM (SELECT unnest(v) AS c) WHERE c <> 0)),
p AS (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.label = b.label AND len(a.v) = len(b.v) AND a.k <> b.k
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
r AS (SELECT k AS a, k AS b FROM x UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT r.a, min(x.vec_id) AS component_id FROM r JOIN x ON x.k = r.b GROUP BY r.a),
d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT x.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, x.vec_id = c.component_id AS kept FROM x JOIN c ON c.a = x.k LEFT JOIN d ON d.a = x.k""",
    "op3_warc_bundles": """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1), '' ORDER BY i) FROM (SELECT unnest(range(32)) AS i)) AS payload_digest,
  CASE WHEN holder IS NULL OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM q""",
    "op11_mtree_topk": """WITH x AS (SELECT row_number() OVER () AS k, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS c) WHERE c IS NULL OR NOT isfinite(c))),
p AS (SELECT a.k, a.vec_id AS query_id, b.vec_id AS vec_id, b.k AS o, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM x a JOIN x b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id, o) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_crochemore_runs": f"""WITH {_CRC},
t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws, coalesce({_crc('CAST(doc_id AS VARCHAR)')}, 1) AS h FROM documents, crc_table),
b AS (SELECT row_number() OVER () AS k, *, len(ws) AS n, h // 10 AS g FROM t),
c AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM b),
d AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM c),
w AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM d),
u AS (SELECT k, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
e AS (SELECT x.k, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS isle FROM e),
m AS (SELECT k, min(i) AS s, max(i) - min(i) + 1 + q AS len, q FROM s GROUP BY k, q, isle HAVING max(i) - min(i) + 1 + q >= greatest(24, 3 * q)),
r AS (SELECT k, s, len, min(q) AS q FROM m GROUP BY k, s, len),
j AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY k),
f AS (SELECT a.k, a.s, a.len, a.q FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.k = a.k AND (b.len * a.q > a.len * b.q OR (b.len * a.q = a.len * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
z AS (SELECT u.k, string_agg(word, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = u.k AND u.i >= r.s + r.q AND u.i < r.s + r.len) GROUP BY u.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(f.s AS BIGINT) AS start, CAST(f.len AS BIGINT) AS length, CAST(f.q AS BIGINT) AS period, CAST(1000 * f.len // f.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM w LEFT JOIN j USING (k) LEFT JOIN f USING (k) LEFT JOIN z USING (k)""",
    "op13_spelling_grams": f"""WITH RECURSIVE {_CRC},
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS word FROM documents),
c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word AS tagged, word, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT word, n, {_crc('tagged')} AS h FROM c, crc_table),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
g AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
p AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
o AS (SELECT word, count(*) AS n_near, max(m) AS most FROM p GROUP BY word),
b AS (SELECT p.word, min(p.other) AS best, any_value(o.most) AS most FROM p JOIN o ON o.word = p.word AND p.m = o.most GROUP BY p.word),
f AS (SELECT v.word, v.n, CASE WHEN b.most >= 2 * v.n THEN b.best END AS form, CASE WHEN b.most >= 2 * v.n THEN b.most END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
w AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
r AS (SELECT w.word, w.at FROM w JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.at, f.word) AS root, f.n, coalesce(o.n_near, 0) AS n_near, f.form_n FROM f LEFT JOIN o ON o.word = f.word LEFT JOIN r ON r.word = f.word""",
}
