"""DuckDB SQL for the rows of the corpus queries."""

#: A-Z lower-cased in SQL.
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Marks of a block: begin, says and end have 24 characters, a mark between merged turns has 8.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), l AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS goes_on,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN goes_on THEN 8 ELSE 24 + role_chars END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

#: CRC-32 byte by byte, with the usual table made from its polynomial.
OP6_SQL = """
WITH t AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) AS r(n)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, size, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda x, b: xor(x >> 8, t.crc[(xor(x, b) & 255) + 1])) AS x FROM d, t
), s AS (
  SELECT doc_id, size::BIGINT AS size, xor(x, 4294967295) AS text_crc32,
    least(15, (sum(size) OVER (ORDER BY doc_id) * 2 - size) * 16 // (sum(size) OVER () * 2))::INTEGER AS shard FROM c
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), k AS (SELECT DISTINCT k FROM p
), o AS (SELECT doc_id, i, p.k, item_id FROM d, k, unnest(range(1, len(w) - k.k + 2)) AS t(i)
  JOIN p ON p.k = k.k AND p.g = array_to_string(list_slice(w, i, i + k.k - 1), ' ')
), h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM o, unnest(range(i, i + k)) AS u(j) GROUP BY doc_id
), m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS h FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
), c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]), lambda x, y: x + y) / (a.norm * b.norm) >= 0.93
), r AS (SELECT DISTINCT a AS vec_id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.vec_id WHERE r.root < p.b
), c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id
), l AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN l USING (vec_id) LEFT JOIN c USING (vec_id)
"""

#: Near words share what is left without one code point: at the same place (replaced), or one of them is what is left (inserted).
OP12_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) AS r(n)
), w AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWERED.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) >= 6 GROUP BY ALL
), h AS (
  SELECT w, n, hex(encode(doc_id || ':' || w)) AS h FROM c
), x AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda x, b: xor(x >> 8, t.crc[(xor(x, b) & 255) + 1])), 4294967295) AS h FROM h, t
), s AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM x
), v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS u(i)
), p AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest
), b AS (SELECT word, count(*)::BIGINT AS n_near, max(n) AS form_n, first(other ORDER BY n DESC, other) AS form FROM p GROUP BY word
), f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN b USING (word)
), r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) WHERE r.up IS NULL
"""

ORACLES = {
    "op1_chat_format": OP1_SQL,
    "op6_prefix_sum_shards": OP6_SQL,
    "op7_fm_index_decontamination": OP7_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_vantage_point_search": OP10_SQL,
    "op11_lattice_near_dedup": OP11_SQL,
    "op12_rare_bigram_variants": OP12_SQL,
}
