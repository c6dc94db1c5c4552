"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP2 = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

# The walk's places below 40 and 41 end at the shards; the checksum's table is built by its rule.
OP5 = """
WITH RECURSIVE w(doc_id, key, j) AS (
  SELECT doc_id, doc_id::HUGEINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k, j FROM w WHERE j < 41)
), s AS (
  SELECT doc_id, max(j) FILTER (WHERE j < 40) AS shard, max(j) FILTER (WHERE j < 41) AS grown_shard FROM w GROUP BY doc_id
), t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), c AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         xor(list_reduce(list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT *, hex(coalesce(text, '')) AS h FROM documents), t
)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY c.doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM c JOIN s USING (doc_id)
"""

OP7 = """
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), f AS (
  SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY l.doc_id
"""

OP8 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(5, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM benchmark) WHERE len(w) > 0
), bs AS (
  SELECT item_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS s FROM b
), ds AS (
  SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS s
  FROM d, (SELECT DISTINCT n FROM b)
), q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT ds.doc_id, bs.item_id, count(*) AS n_found FROM ds JOIN bs ON ds.n = bs.n AND ds.s = bs.s GROUP BY ds.doc_id, bs.item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
FROM m JOIN q USING (item_id) WHERE n_found::DOUBLE / n_shingles >= 0.8
"""

# Levels of a document's own tree count from 0, those of the tree of subroots from 1000.
OP11 = """
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), c AS (
  SELECT *, xor(list_reduce(list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ('0x' || substr(hex(doc_id::VARCHAR), 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM documents, t
), d AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         n_chars, CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_found, coalesce(strlen(text) || ':' || text, '-') AS z
  FROM c
), h AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf, sha256(a || coalesce(strlen(n_found::VARCHAR) || ':' || n_found, '-') || z) AS found
  FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h
), tree(lang, lvl, idx, n, h) AS (
  SELECT lang, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 2, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), upper(lvl, idx, n, h) AS (
  SELECT 1000, idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY lvl, idx // 2, n
), steps AS (
  SELECT l.lang, l.idx, v.lvl, (l.idx >> v.lvl) & 1 AS odd, x.h
  FROM leaves l JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN tree x ON x.lang IS NOT DISTINCT FROM l.lang AND x.lvl = v.lvl AND x.idx = xor(l.idx >> v.lvl, 1)
  UNION ALL
  SELECT l.lang, l.idx, v.lvl, (s.idx >> (v.lvl - 1000)) & 1, x.h
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT lvl FROM upper WHERE n > 1) v ON true
  LEFT JOIN upper x ON x.lvl = v.lvl AND x.idx = xor(s.idx >> (v.lvl - 1000), 1)
), paths AS (
  SELECT lang, idx, list(CASE WHEN h IS NULL THEN '-' WHEN odd = 1 THEN 'l' || h ELSE 'r' || h END ORDER BY lvl) AS p FROM steps GROUP BY lang, idx
), o AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, coalesce(p.p, []) AS p, l.found
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(p, lambda e: e <> '-'), lambda e: e[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend(found, p), lambda a, e: CASE WHEN e = '-' THEN sha256(a) WHEN e[1] = 'l' THEN sha256(e[2:] || a) ELSE sha256(a || e[2:]) END) AS folded_root FROM o)
"""

OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike AND anchor_id <> id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op5_jump_shards": OP5, "op7_line_dedup": OP7, "op8_benchmark_leaks": OP8, "op11_merkle_manifest": OP11, "op12_hard_negatives": OP12}
