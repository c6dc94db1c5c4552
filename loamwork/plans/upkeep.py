"""Queries of the operators that keep a base in order, with DuckDB SQL for the same rows.

Parts stand for artifacts, orders and lines for logs and jobs; roles are dealt by their keys. Each query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions import text as tx
from loamwork.operators import dedup, guards, joins, lifecycle, logs, metrics, reads, retrieval, search, segments, store
from loamwork.plans.catalogue import BM25, DENSE, HEBB, NOW, TOKENS, _corpus, _docs, _first_links, _items, _lexical, _link_parts, dense_topk, label_sql
from loamwork.plans.registry import query
from loamwork.sources.capture import page_markdown, table

ARTS = """art AS (SELECT p_partkey AS id, p_size::BIGINT AS corpus_id, CASE WHEN p_partkey % 13 = 0 THEN 'superseded' WHEN p_partkey % 11 = 0 THEN 'deprecated' END AS status,
  CASE WHEN p_partkey % 13 = 0 THEN p_partkey * 3 END AS superseded_by, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 END AS segment_idx, p_partkey % 7 AS ordinal,
  CASE p_partkey % 5 WHEN 0 THEN 'merged' WHEN 1 THEN 'synthesized' WHEN 2 THEN 'passage' ELSE 'captured' END AS provenance,
  CASE p_partkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'embedded' END AS embed_state, (p_partkey * 37) % 1000 AS created_at, p_name AS text, p_brand AS brand FROM part)"""
LIVE = "coalesce(status, 'active') = 'active' AND superseded_by IS NULL"
SOURCES = "src AS (SELECT DISTINCT p_partkey AS child_id, p_partkey // k AS root_id FROM part, (SELECT unnest([2, 3]) AS k) WHERE p_partkey % 5 < 2 AND p_partkey // k > 0)"


def _arts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_size").cast("long").alias("corpus_id"), F.when(k % 13 == 0, "superseded").when(k % 11 == 0, "deprecated").alias("status"), F.when(k % 13 == 0, k * 3).alias("superseded_by"),
        F.when(k % 3 == 0, k % 4).alias("segment_idx"), (k % 7).alias("ordinal"), pick(5, "merged", "synthesized", "passage", "captured", "captured").alias("provenance"),
        pick(4, "pending", "failed", "embedded", "embedded").alias("embed_state"), ((k * 37) % 1000).alias("created_at"), F.col("p_name").alias("text"), F.col("p_brand").alias("brand"),
    )


def _sources(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where("p_partkey % 5 < 2").select(F.col("p_partkey").alias("child_id"), F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    return part.select("child_id", F.floor(F.col("child_id") / F.col("k")).alias("root_id")).where("root_id > 0").distinct()


# Searches ---------------------------------------------------------------------------------------------------------

_SEARCH = r"""docs AS (SELECT doc_id AS id, source AS corpus_id, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id),
q AS (SELECT id AS q_id, substr(text, 1, 80) AS text, v FROM docs WHERE id % 20 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.q_id, docs.id, round(list_cosine_similarity(q.v, docs.v), 6) + 0.0 AS score FROM q, docs)) WHERE rank < 30),
runs AS (SELECT id, unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\-_./]+'), lambda t: lower(trim(t, '-_./')))) AS t FROM docs),
toks AS (SELECT id, t FROM runs WHERE t <> '' AND strlen(t) <= 40 UNION ALL SELECT id, p FROM (SELECT id, unnest(regexp_split_to_array(t, '[\-_./]+')) AS p FROM runs WHERE regexp_matches(t, '[\-_./]')) WHERE p <> '' AND strlen(p) <= 40),
post AS (SELECT id, t AS term, count(*) AS tf FROM toks GROUP BY id, t),
qr AS (SELECT q_id, unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\-_./]+'), lambda t: lower(trim(t, '-_./')))) AS t FROM q),
qt AS (SELECT DISTINCT q_id, t AS term FROM (SELECT q_id, t FROM qr WHERE t <> '' AND strlen(t) <= 40 UNION ALL SELECT q_id, p FROM (SELECT q_id, unnest(regexp_split_to_array(t, '[\-_./]+')) AS p FROM qr WHERE regexp_matches(t, '[\-_./]')) WHERE p <> '' AND strlen(p) <= 40)),
idf AS (SELECT term, ln(((SELECT count(*) FROM docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q_id, id, round(sum(idf * (tf * 2.2 / (tf + 1.2))), 6) AS score FROM post JOIN qt USING (term) JOIN idf USING (term) GROUP BY q_id, id)) WHERE rank < 30),
parts AS (SELECT q_id, id, 1.0::DOUBLE / (rank + 61) AS part FROM dense UNION ALL SELECT q_id, id, 1.0::DOUBLE / (rank + 61) FROM lex),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q_id, id, round(sum(part), 9) AS score FROM parts GROUP BY q_id, id)) WHERE rank < 30),
heard AS (SELECT q_id, id, score FROM fused WHERE q_id IN (SELECT q_id FROM qt) UNION ALL SELECT q_id, id, score FROM dense WHERE q_id NOT IN (SELECT q_id FROM qt)),
final AS (SELECT h.q_id, h.id, d.corpus_id, round(h.score + 0.05 * power(2.0, -(h.id * 3600) / (180 * 86400.0)) + CASE WHEN h.id % 7 = 0 THEN 0.15 ELSE 0 END, 6) AS score FROM heard h JOIN docs d ON d.id = h.id),
placed AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM final),
capped AS (SELECT *, row_number() OVER (PARTITION BY q_id, corpus_id ORDER BY rank) > 3 AS displaced FROM placed),
again AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY displaced, rank) - 1 AS r FROM capped),
cut AS (SELECT q_id, id, score, r AS rank FROM again WHERE (NOT displaced OR r < 30) AND r < 10),
g AS (SELECT *, greatest(round(score - lead(score) OVER (PARTITION BY q_id ORDER BY rank), 9), 0) AS gap FROM cut),
p AS (SELECT q_id, count(*) AS n, max(gap) AS top, sum(gap) AS total, max(CASE WHEN rank = 0 THEN abs(score) END) AS first FROM g GROUP BY q_id),
c AS (SELECT p.q_id, CASE WHEN n >= 3 AND top > 0 AND top > 0.01 * first AND round(top - 3.0 * (total - top) / (n - 2), 9) > 0 THEN (SELECT min(rank) FROM g WHERE g.q_id = p.q_id AND g.gap = p.top) + 1 END AS cliff_at FROM p)"""


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents that have a vector, pinned where seven divides their id, and queries from the beginnings of every twentieth."""
    vectors = _corpus(spark, d).select("id", "vector")
    art = _docs(spark, d).join(vectors, "id").select(
        "id", F.col("source").alias("corpus_id"), "text", "vector", F.when(F.col("id") % 7 == 0, F.array(F.lit("pinned"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.lit(None).cast("string").alias("status"), (NOW - F.col("id") * 3600).alias("verified_at"), F.col("id").alias("ordinal"), F.lit(None).cast("long").alias("superseded_by"),
    )
    return art, art.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.substring("text", 1, 80).alias("text"), "vector")


@query(f"""WITH {_SEARCH} SELECT x.q_id, x.id, x.rank, x.score, s.score AS similarity, coalesce(s.score < 0.35, false) AS weak, coalesce(x.rank >= c.cliff_at, false) AS past_cliff, false AS associated
FROM cut x LEFT JOIN dense s ON s.q_id = x.q_id AND s.id = x.id LEFT JOIN c ON c.q_id = x.q_id""")
def search_pipeline(spark: SparkSession, d: str) -> DataFrame:
    art, queries = _searched(spark, d)
    return search.search(art, queries, NOW, limit=10, cap=3)


_EVERY = "FROM documents JOIN embeddings ON vec_id = doc_id),\nq AS (SELECT id AS q_id, substr(text, 1, 80) AS text, v FROM docs WHERE id % 20 = 0),"
_WHOLE = _SEARCH.replace(
    _EVERY,
    "FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 2 = 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0),\nq AS (SELECT doc_id AS q_id, substr(text, 1, 80) AS text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 20 = 0),",
).replace(
    "cut AS (SELECT q_id, id, score, r AS rank FROM again WHERE (NOT displaced OR r < 30) AND r < 10)",
    """scored AS (SELECT q_id, id, r AS old_rank, round(score * 0.5 + (id % 5) / 10.0, 6) AS score FROM again WHERE NOT displaced OR r < 30),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, old_rank) - 1 AS rank FROM scored) WHERE rank < 10),
shares AS (SELECT *, CASE WHEN max(id % 7) OVER (PARTITION BY q_id) > 0 THEN (id % 7)::DOUBLE / max(id % 7) OVER (PARTITION BY q_id) ELSE 0 END AS share, count(*) OVER (PARTITION BY q_id) AS n FROM top),
acts AS (SELECT *, CASE WHEN id % 17 = 0 THEN greatest(share, 1.0) ELSE share END AS act FROM shares),
beats AS (SELECT *, coalesce(rank >= 2 AND round(act - lag(act, 1) OVER w, 9) > 0.5, false) AS one, coalesce(rank >= 3 AND round(act - lag(act, 2) OVER w, 9) > 0.5, false) AS two FROM acts WINDOW w AS (PARTITION BY q_id ORDER BY rank)),
climbs AS (SELECT *, CASE WHEN n < 3 OR rank < 2 OR NOT one THEN 0 WHEN two THEN 2 ELSE 1 END AS climb FROM beats),
cut AS (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY rank - climb, CASE WHEN climb > 0 THEN 0 ELSE 1 END, rank) - 1 AS rank FROM climbs)""",
)


@query(f"""WITH {_WHOLE}, {HEBB}, lk AS (SELECT a_id AS f, b_id AS o, n_events * 3.0 AS w FROM pairs UNION ALL SELECT b_id, a_id, n_events * 3.0 FROM pairs),
near AS (SELECT q_id, o AS id, max(w) AS w FROM cut JOIN lk ON f = cut.id WHERE cut.rank < 3 GROUP BY q_id, o),
fresh AS (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY w DESC, id) - 1 AS place FROM near WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.q_id = near.q_id AND cut.id = near.id)),
recalled AS (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY place) AS k FROM fresh WHERE place < 3 AND id IN (SELECT id FROM docs)), ends AS (SELECT q_id, max(rank) AS last FROM cut GROUP BY q_id)
SELECT x.q_id, x.id, x.rank, x.score, s.score AS similarity, coalesce(s.score < 0.35, false) AS weak, coalesce(x.rank >= c.cliff_at, false) AS past_cliff, false AS associated FROM cut x LEFT JOIN dense s ON s.q_id = x.q_id AND s.id = x.id LEFT JOIN c ON c.q_id = x.q_id
UNION ALL SELECT r.q_id, r.id, last + k, 0.0, NULL, false, false, true FROM recalled r JOIN ends e ON e.q_id = r.q_id""")
def search_with_everything(spark: SparkSession, d: str) -> DataFrame:
    """The same search with a scorer, activation, links and filters: only documents of even ids are tagged, and some are superseded or deprecated."""
    art, queries = _searched(spark, d)
    status = F.when(F.col("id") % 11 == 0, "deprecated").when(F.col("id") % 13 == 0, "superseded")
    art = art.withColumn("status", status).withColumn("tags", F.when(F.col("id") % 2 == 0, F.array_append("tags", "even")).otherwise(F.col("tags")))
    scorer = F.col("score") * 0.5 + (F.col("id") % 5) / 10.0
    active = art.select("id", (F.col("id") % 7).cast("double").alias("activation"), (F.col("id") % 17 == 0).alias("sitting"))
    links = _first_links(spark, d).withColumn("weight", F.col("weight") * 3.0).withColumn("bumped_at", F.lit(NOW))
    return search.search(art, queries, NOW, limit=10, cap=3, scorer=scorer, activation=active, links=links, tags=("even",))


_ROUNDS = (
    _SEARCH.replace(
        "q AS (SELECT id AS q_id, substr(text, 1, 80) AS text, v FROM docs WHERE id % 20 = 0),",
        "q AS (SELECT * FROM (SELECT id * 16 AS q_id, substr(text, 1, 80) AS text, v FROM docs WHERE id % 20 = 0 UNION ALL SELECT id * 16 + 1, substr(text, 81, 80), v FROM docs WHERE id % 20 = 0) WHERE trim(text, ' ') <> ''),",
    )
    .replace("rank < 30", "rank < 8")
    .replace("cut AS (SELECT q_id, id, score, r AS rank FROM again WHERE (NOT displaced OR r < 30) AND r < 10)", "cut AS (SELECT q_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM final) WHERE rank < 8)")
)


@query(f"""WITH {_ROUNDS}, {HEBB}, above AS (SELECT x.*, c.cliff_at FROM cut x LEFT JOIN c ON c.q_id = x.q_id WHERE c.cliff_at IS NULL OR x.rank < c.cliff_at),
s AS (SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM docs WINDOW w AS (PARTITION BY corpus_id ORDER BY id)), anchors AS (SELECT q_id, rank AS anchor, id AS via FROM above WHERE rank < 3),
beside AS (SELECT q_id, anchor, via, 0 AS way, before AS id FROM anchors JOIN s ON s.id = via WHERE before IS NOT NULL UNION ALL SELECT q_id, anchor, via, 1, after FROM anchors JOIN s ON s.id = via WHERE after IS NOT NULL),
l AS (SELECT a_id AS f, b_id AS o, n_events::DOUBLE AS w FROM pairs UNION ALL SELECT b_id, a_id, n_events FROM pairs),
linked AS (SELECT q_id, anchor, via, 1 + row_number() OVER (PARTITION BY q_id, anchor ORDER BY w DESC, o) AS way, o AS id FROM anchors JOIN l ON l.f = via WHERE w >= 2),
every AS (SELECT * FROM beside UNION ALL SELECT * FROM linked WHERE way <= 7), f AS (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY anchor, way) AS k FROM every),
side AS (SELECT * FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY anchor, way) - 1 AS rank FROM f WHERE k = 1 AND id IN (SELECT id FROM docs) AND NOT EXISTS (SELECT 1 FROM above h WHERE h.q_id = f.q_id AND h.id = f.id)) WHERE rank < 6),
r AS (SELECT q_id, id, rank, 'ranked' AS kind, CASE WHEN rank < coalesce(cliff_at, 3) THEN 0 ELSE 1 END AS phase FROM above UNION ALL SELECT q_id, id, rank, 'reached', 2 FROM side),
n AS (SELECT q_id // 16 AS q_id, q_id % 16 AS part, id, rank AS pos, kind, phase FROM r), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY q_id, id ORDER BY phase, pos, part) = 1)
SELECT q_id, id, kind, row_number() OVER (PARTITION BY q_id ORDER BY phase, pos, part, id) - 1 AS rank FROM m""")
def ask_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Each question plans two queries: its beginning, and what follows that."""
    art, queries = _searched(spark, d)
    later = art.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.lit(1).alias("part"), F.substring("text", 81, 80).alias("text"), "vector")
    links = _first_links(spark, d).withColumn("bumped_at", F.lit(NOW))
    return search.ask_rounds(art, queries.select("q_id", F.lit(0).alias("part"), "text", "vector").unionByName(later), links, NOW)


@query(r"""WITH w AS (SELECT doc_id AS q_id, string_split(text, ' ')[1:5] AS w FROM documents), e AS (SELECT q_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM w),
t AS (SELECT q_id, pos, trim(raw, ' ') AS text FROM e WHERE trim(raw, ' ') <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY q_id, lower(text) ORDER BY pos) AS n FROM t),
r AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY pos) - 1 AS part, text FROM f WHERE n = 1) SELECT * FROM r WHERE part < 3""")
def planned_queries(spark: SparkSession, d: str) -> DataFrame:
    return search.planned(_docs(spark, d).select(F.col("id").alias("q_id"), F.slice(F.split("text", " "), 1, 5).alias("plan")))


@query(f"""WITH {DENSE}, {HEBB}, art AS (SELECT vec_id AS id, label AS corpus_id FROM embeddings), s AS (SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM art WINDOW w AS (PARTITION BY corpus_id ORDER BY id)),
anchors AS (SELECT q_id, rank AS anchor, id AS via FROM dense WHERE rank < 3),
beside AS (SELECT q_id, anchor, via, 0 AS way, before AS id FROM anchors JOIN s ON s.id = via WHERE before IS NOT NULL UNION ALL SELECT q_id, anchor, via, 1, after FROM anchors JOIN s ON s.id = via WHERE after IS NOT NULL),
l AS (SELECT a_id AS f, b_id AS o, n_events::DOUBLE AS w FROM pairs UNION ALL SELECT b_id, a_id, n_events FROM pairs),
linked AS (SELECT q_id, anchor, via, 1 + row_number() OVER (PARTITION BY q_id, anchor ORDER BY w DESC, o) AS way, o AS id FROM anchors JOIN l ON l.f = via WHERE w >= 1),
every AS (SELECT * FROM beside UNION ALL SELECT * FROM linked WHERE way <= 7), f AS (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY anchor, way) AS k FROM every),
r AS (SELECT q_id, id, via, row_number() OVER (PARTITION BY q_id ORDER BY anchor, way) - 1 AS place FROM f WHERE k = 1 AND id IN (SELECT id FROM art) AND NOT EXISTS (SELECT 1 FROM dense h WHERE h.q_id = f.q_id AND h.id = f.id))
SELECT * FROM r WHERE place < 6""")
def reached_sideways(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("superseded_by")
    art = _corpus(spark, d).select("id", F.col("label").alias("corpus_id"), F.col("id").alias("ordinal"), *none)
    return search.reach(dense_topk(spark, d), art, _first_links(spark, d).withColumn("bumped_at", F.lit(NOW)), NOW, show_min=1.0)


@query(f"""WITH {BM25}, have AS (SELECT l.q_id, l.id, count(*) AS n FROM lex l JOIN qt ON qt.q_id = l.q_id JOIN post ON post.id = l.id AND post.term = qt.term GROUP BY l.q_id, l.id), size AS (SELECT q_id, count(*) AS n FROM qt GROUP BY q_id),
s AS (SELECT l.q_id, l.id, l.rank AS old, round(h.n / s.n, 6) AS score FROM lex l JOIN have h USING (q_id, id) JOIN size s ON s.q_id = l.q_id)
SELECT * FROM (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, old) - 1 AS rank FROM s) WHERE rank < 10""")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    hits = _lexical(spark, d).drop("score").join(_docs(spark, d).select("id", "text"), "id").join(_items(spark, d).withColumnRenamed("text", "query"), "q_id")
    return retrieval.rerank(hits, retrieval.overlap_scorer(), 10).select("q_id", "id", "score", "rank")


@query(f"""WITH {BM25}, t AS (SELECT l.q_id, l.rank, sum(length(o.text) * 2 // 7) OVER (PARTITION BY l.q_id ORDER BY l.rank ROWS UNBOUNDED PRECEDING) AS used FROM lex l JOIN documents o ON o.doc_id = l.id)
SELECT q_id, count(*) FILTER (WHERE used <= 2000) AS kept, count(*) FILTER (WHERE used > 2000) AS dropped FROM t GROUP BY q_id""")
def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = _lexical(spark, d).join(_docs(spark, d).select("id", tx.token_estimate(F.col("text")).alias("tokens")), "id")
    return search.excerpt_budget(hits, "tokens", 2000)


@query(f"""WITH {DENSE}, a AS (SELECT q_id, id % 5 = 1 AND score >= 0.9 AS answered FROM dense WHERE rank = 0) SELECT q_id, coalesce(answered, false) AS answered FROM a""")
def answered_queries(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("id") % 5 == 1, "synthesized").otherwise("captured")
    return search.answered(dense_topk(spark, d).withColumn("provenance", made).withColumn("weak", F.col("score") < 0.9))


@query(f"""WITH {DENSE}, n AS (SELECT id, count(*) FILTER (WHERE rank < 8) AS hits FROM dense GROUP BY id) SELECT id, {NOW}::BIGINT AS at, hits, (hits * 0.5)::DOUBLE AS gain FROM n""")
def seen_effects(spark: SparkSession, d: str) -> DataFrame:
    return search.seen_effects(dense_topk(spark, d).withColumn("associated", F.col("rank") >= 8), NOW).withColumn("gain", F.col("gain").cast("double"))


@query("""SELECT p_partkey AS id, CASE WHEN n.k IS NULL THEN p_partkey % 50 ELSE greatest(p_partkey % 50, n.last) END AS last_seen_at, p_size + coalesce(n.k, 0) AS hit_count
FROM part LEFT JOIN (SELECT l_partkey, max(l_linenumber)::BIGINT AS last, count(*) FILTER (WHERE l_returnflag = 'N') AS k FROM lineitem GROUP BY l_partkey) n ON n.l_partkey = p_partkey""")
def touched(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("last_seen_at"), F.col("p_size").cast("long").alias("hit_count"))
    touches = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("long").alias("at"), (F.col("l_returnflag") == "N").alias("retrieved"))
    return retrieval.touch(points, touches)


@query(f"WITH {ARTS} SELECT id, corpus_id FROM art WHERE brand = 'Brand#11' AND coalesce(status, 'active') <> 'superseded'")
def filtered_artifacts(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).withColumn("tags", F.array("brand", "provenance")).withColumn("category", F.lit("concept"))
    return retrieval.filter_artifacts(art, ("Brand#11",), "concept", deprecated=True).select("id", "corpus_id")


# Texts ------------------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, text, (length(text) * 2 // 7)::BIGINT AS n, string_split(text, chr(10)) AS ls, greatest(ceil(length(text) / 70), 1)::BIGINT AS k, sha256(text) AS h FROM documents)
SELECT doc_id, least(greatest(8192 - n - least(greatest(n // 8, 64), 512), 0), 1024)::BIGINT AS ceiling, CASE WHEN len(ls) >= 2 THEN array_to_string(ls[2:3], chr(10)) ELSE '' END AS second,
  md5(array_to_string(list_transform(range(0, k), lambda i: substr(text, i * 70 + 1, 70)), '|')) AS pieces_md5,
  list_sum(list_transform(range(0, 8), lambda i: (instr('0123456789abcdef', substr(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), 8 - i, 1)) - 1) * (16 ** i)))::BIGINT AS number FROM t""")
def text_cuts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    pieces = F.md5(F.array_join(tx.cut_long_line(t, 20), "|"))
    return table(spark, d, "documents").select("doc_id", tx.output_ceiling(F.lit(8192), tx.token_estimate(t), F.lit(1024)).alias("ceiling"), tx.line_range(t, F.lit(2), F.least(F.lit(3), F.size(F.split(t, "\n")))).alias("second"), pieces.alias("pieces_md5"), tx.term_number(t).alias("number"))


@query(r"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS a, lower(trim(regexp_replace(translate(substr(text, 11, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS b FROM documents)
SELECT doc_id, b <> '' AND contains(a, b) AS held FROM n""")
def contained_normal(spark: SparkSession, d: str) -> DataFrame:
    short = F.translate(F.substring("text", 11, 40), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, d, "documents").select("doc_id", tx.contains_normal(F.col("text"), short).alias("held"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' Concept ' WHEN 1 THEN 'SNIPPET' WHEN 2 THEN p_type ELSE 'example' END AS raw, list_distinct(list_filter(string_split(p_name || '  ' || p_name || ' ' || p_brand, ' '), lambda x: x <> '')) AS tags, p_size FROM part)
SELECT id, CASE WHEN lower(trim(raw)) IN ('concept', 'procedure', 'reference', 'snippet', 'configuration', 'definition', 'example', 'other') THEN lower(trim(raw)) ELSE 'other' END AS category, array_to_string(list_sort(tags), ',') AS tags,
  least(power(2, least(greatest(p_size, 1), 16)), 21600)::BIGINT AS backoff, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN NULL ELSE md5(CASE WHEN id % 3 <> 0 THEN 'x' || id ELSE '' END || '|' || CASE WHEN id % 2 <> 0 THEN 'y' ELSE '' END) END AS device, '<' || id || '> {id}!' AS rendered FROM t""")
def cleaned_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, " Concept ").when(k % 4 == 1, "SNIPPET").when(k % 4 == 2, F.col("p_type")).otherwise("example")
    tags = tx.clean_tags(F.split(F.concat_ws(" ", "p_name", F.lit(""), "p_name", "p_brand"), " "))
    device = tx.device_key(F.when(k % 3 != 0, F.concat(F.lit("x"), k.cast("string"))), F.when(k % 2 != 0, F.lit("y")))
    return table(spark, d, "part").select(k.alias("id"), tx.category(raw).alias("category"), F.array_join(F.array_sort(tags), ",").alias("tags"), tx.backoff_seconds(F.col("p_size")).alias("backoff"), device.alias("device"), tx.rendered("<{id}> {raw}!", id=k.cast("string"), raw=F.lit("{id}")).alias("rendered"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[#*_`>|]+', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE regexp_extract(substr(t, 1, 161), '^(.*) ', 1) || '…' END AS snippet FROM f""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("""WITH l AS (SELECT doc_id AS id, string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS ls, CASE WHEN doc_id % 3 <> 0 THEN 2 + doc_id % 3 END AS s FROM documents),
u AS (SELECT id, s, unnest(ls) AS text, generate_subscripts(ls, 1) AS number FROM l) SELECT id, number::BIGINT AS number, text, coalesce(number BETWEEN s AND s + 1, false) AS in_span FROM u WHERE CASE WHEN s IS NULL THEN number <= 40 ELSE number BETWEEN s - 3 AND s + 4 END""")
def corpus_slices(spark: SparkSession, d: str) -> DataFrame:
    start = F.when(F.col("id") % 3 != 0, 2 + F.col("id") % 3)
    return store.corpus_slice(_docs(spark, d).select("id", "text", start.alias("start_line"), (start + 1).alias("end_line")))


@query("""SELECT doc_id AS id, CASE WHEN lang <> 'en' THEN lang ELSE CASE WHEN length(trim(string_split(text, chr(10))[1])) > 70 THEN substr(trim(string_split(text, chr(10))[1]), 1, 70) || '…' ELSE trim(string_split(text, chr(10))[1]) END END AS title FROM documents""")
def offer_titles(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", store.offer_title(F.when(F.col("lang") != "en", F.col("lang")), F.col("text")).alias("title"))


@query()
def page_marks(spark: SparkSession, d: str) -> DataFrame:
    return page_markdown(table(spark, d, "pages"))


@query(r"""WITH l AS (SELECT doc_id AS id, list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '• one' || chr(10) || chr(10) || '▪' || chr(10) || chr(10) || 'two' || chr(10) || '•' || chr(10) || '# three' ELSE '' END, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}\x{85}\x0b]+$', '')) AS ls FROM documents),
k AS (SELECT id, ls, list_transform(ls, lambda x: CASE WHEN x = '' THEN 'b' WHEN regexp_matches(x, '^[\s\p{Z}]*[•‣⁃∙·▪▫■○●◦\p{Co}]$') THEN 'm' ELSE 't' END) AS ks FROM l),
p AS (SELECT id, list_filter(list_zip(ls, ks), lambda z: z[2] = 't') AS t, regexp_extract_all(array_to_string(ks, ''), '[bm]*t') AS gaps FROM k),
i AS (SELECT id, pos, t[pos][1] AS x, gaps[pos] AS gap, regexp_replace(t[pos][1], '^[\s\p{Z}]*([•‣⁃∙·▪▫■○●◦\p{Co}][\s\p{Z}]+)?', '') AS said FROM (SELECT *, unnest(range(1, len(t) + 1)) AS pos FROM p)),
m AS (SELECT *, regexp_matches(x, '^[\s\p{Z}]*[•‣⁃∙·▪▫■○●◦\p{Co}][\s\p{Z}]') OR (regexp_matches(gap, 'mb?t$') AND NOT regexp_matches(said, '^(#|\||```|~~~|> |[-*+] |[0-9]+\. )')) AS item FROM i),
o AS (SELECT *, coalesce(lag(item) OVER (PARTITION BY id ORDER BY pos), false) AS prior FROM m)
SELECT l.id, coalesce(string_agg(CASE WHEN pos > 1 AND gap LIKE '%bt' AND NOT (item AND prior AND NOT contains(gap, 'bb')) THEN chr(10) ELSE '' END || regexp_extract(x, '^[\s\p{Z}]*') || CASE WHEN item THEN '- ' ELSE '' END || said || chr(10), '' ORDER BY pos), chr(10)) AS text
FROM l LEFT JOIN o ON l.id = o.id GROUP BY l.id""")
def normal_exports(spark: SparkSession, d: str) -> DataFrame:
    """Every other document ends in a list as exports have it."""
    tail = F.when(F.col("id") % 2 == 0, "\n• one\n\n▪\n\ntwo\n•\n# three").otherwise("")
    return guards.normal_exports(_docs(spark, d).withColumn("text", F.concat(F.coalesce("text", F.lit("")), tail)))


@query(r"""WITH l AS (SELECT doc_id AS id, n, line, lower(trim(regexp_replace(line, '[\s\p{Z}\x{85}]+', ' ', 'g'))) AS flat FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
f AS (SELECT *, coalesce(sum(length(flat) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l WHERE flat <> ''),
w AS (SELECT id, string_agg(flat, ' ' ORDER BY n) AS whole, max(flat) FILTER (WHERE n % 3 = 2) AS x FROM f GROUP BY id),
at AS (SELECT id, length(x) AS k, instr(whole, x) - 1 AS p FROM w WHERE strlen(x) > 8)
SELECT at.id, 9 + max(n) FILTER (WHERE start <= p) AS start_line, 9 + max(n) FILTER (WHERE start <= p + k - 1) AS end_line FROM at JOIN f ON f.id = at.id GROUP BY at.id""")
def located_spans(spark: SparkSession, d: str) -> DataFrame:
    """The last in order of each document's every third line, looked for in the document, whose lines count from 10."""
    docs = _docs(spark, d).select("id", F.coalesce("text", F.lit("")).alias("window"))
    flat = F.transform(F.split("window", "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    third = F.array_max(F.filter(flat, lambda x, k: (x != "") & (k % 3 == 1)))
    return guards.located(docs.select("id", third.alias("text"), "window", F.lit(10).cast("long").alias("first_line")))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, role, turn, text || ' Call `run-' || turn || '` with --level-' || (conv_id % 4) || '.' AS answer, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' --level-2 `run-3`' AS excerpt FROM conversations),
x AS (SELECT DISTINCT id, excerpt, unnest(list_concat(regexp_extract_all(answer, '`([^`]+)`', 1), regexp_extract_all(answer, '--[a-z]+-[0-9]+'))) AS literal FROM t WHERE role = 'assistant')
SELECT id, literal FROM x WHERE NOT contains(excerpt, literal)""")
def unsupported_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant's turn, with a command and a flag added, against the turn before it, which has one of each."""
    w, n = Window.partitionBy("conv_id").orderBy("turn"), F.col("turn").cast("string")
    answer = F.concat("text", F.lit(" Call `run-"), n, F.lit("` with --level-"), (F.col("conv_id") % 4).cast("string"), F.lit("."))
    before = F.concat(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(" --level-2 `run-3`"))
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("answer"), F.array(before).alias("excerpts"), "role")
    return guards.unsupported(turns.where("role = 'assistant'").drop("role"))


@query("""SELECT item_id AS id, k AS place, trim(text) AS text, CASE WHEN k = 0 THEN 'x' END AS title, CASE WHEN k = 1 THEN 'concept' END AS category, CASE WHEN k = 1 THEN 2 ELSE 0 END AS n_caveats
FROM benchmark, (SELECT unnest([0, 1, 2]) AS k) WHERE trim(text) <> '' AND (item_id % 3 <> 0 OR k < 2)""")
def read_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of the benchmark's items, three artifacts each beside one without a text; every third reply is cut off within its last artifact."""
    item = lambda **more: F.to_json(F.struct("text", *[v.alias(k) for k, v in more.items()]))
    parts = [item(title=F.lit("x")), F.lit('{"title": "no text"}'), item(category=F.lit("concept"), caveats=F.array(F.lit("a "), F.lit(" "), F.lit("b"))), item()]
    whole = F.concat(F.lit('Sure: {"artifacts": ['), F.concat_ws(", ", *parts), F.lit("]} done"))
    reply = F.when(F.col("item_id") % 3 == 0, F.substring(whole, F.lit(1), F.char_length(whole) - 8)).otherwise(whole)
    found = guards.proposals(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), reply.alias("reply")))
    return found.select("id", "place", "text", "title", "category", F.size("caveats").alias("n_caveats"))



CUES = f"""{HEBB}, sh AS (SELECT a.e, a.id AS a_id, b.id AS b_id FROM sets a JOIN sets b ON a.e = b.e AND a.id < b.id), cu AS (SELECT a_id, b_id, o_orderpriority AS q, count(*) AS n FROM sh JOIN orders ON o_orderkey = e GROUP BY 1, 2, 3),
pl AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY n DESC, q) AS p FROM cu)"""


def _cues(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"))
    return logs.link_cues(shown, table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("query")))


@query(f"""WITH {CUES} SELECT a_id, b_id, count(*) AS queries, string_agg(q || '=' || n, ',' ORDER BY p) FILTER (WHERE p <= 3) AS cues FROM pl GROUP BY a_id, b_id""")
def link_cues(spark: SparkSession, d: str) -> DataFrame:
    written = F.array_join(F.transform("cues", lambda x: F.concat(x["query"], F.lit("="), x["n"].cast("string"))), ",")
    return _cues(spark, d).select("a_id", "b_id", "queries", written.alias("cues"))


@query(f"""WITH {CUES}, m AS (SELECT CASE WHEN a_id % 10 = 7 THEN a_id - 7 ELSE a_id END AS x, CASE WHEN b_id % 10 = 7 THEN b_id - 7 ELSE b_id END AS y, q, n FROM pl WHERE p <= 3), f AS (SELECT least(x, y) AS a_id, greatest(x, y) AS b_id, q, max(n) AS n FROM m WHERE x <> y GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY n DESC, q) AS p FROM f) SELECT a_id, b_id, string_agg(q || '=' || n, ',' ORDER BY p) AS cues FROM r WHERE p <= 3 GROUP BY a_id, b_id""")
def carried_cues(spark: SparkSession, d: str) -> DataFrame:
    moved = table(spark, d, "part").where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") - 7).alias("new_id"))
    written = F.array_join(F.transform("cues", lambda x: F.concat(x["query"], F.lit("="), x["n"].cast("string"))), ",")
    return logs.carried_cues(_cues(spark, d), moved, parts=_link_parts(spark, d)).select("a_id", "b_id", written.alias("cues"))


@query()
def pursuit_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The log's last day: views are searches and errors asks, each with the vector that its artifact's number picks; clicks open, purchases pivot."""
    from loamwork.plans.catalogue import _events

    n = _corpus(spark, d).agg(F.count(F.lit(1)).alias("n"))
    ev = _events(spark, d).join(F.broadcast(n)).withColumn("vec", F.col("artifact_id") % F.col("n")).drop("n")
    own = ev.join(_corpus(spark, d).select(F.col("id").alias("vec"), "vector"), "vec").withColumnRenamed("id", "event_id").withColumn("query", F.col("props"))
    no = F.lit(False)
    searches = own.where("kind = 'view'").withColumn("answered", no).withColumn("confirmed", F.when(F.col("value") > 90, F.col("artifact_id")))
    asks = own.where("kind = 'error'").withColumn("abstained", F.col("value") < 10)
    kind = F.when(F.col("kind") == "click", "opened").otherwise("pivoted")
    acts = ev.where("kind in ('click', 'purchase')").select("id", "artifact_id", "scope", kind.alias("kind"), "at", F.lit(0.0).alias("seconds"), (F.col("value") / 100).alias("similarity"), F.lit(True).alias("shown"))
    last = NOW - 86400
    return logs.pursuit_sweep(searches, asks, acts, last, 0, lookback=86400)


# Lists, jobs and logs ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def page_of_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    top = rows.agg(F.max("at")).first()[0]
    return reads.page_after(rows, top, -1, 50)


JOBS = "jobs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'embed' WHEN o_orderkey % 3 = 1 THEN 'relate' ELSE 'dedupe' END AS stage, o_orderkey AS target_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'running' END AS state, o_orderkey % 4 AS attempts, 0::BIGINT AS run_after, o_orderkey % 1000 AS created_at, o_orderkey % 9 AS seq, o_orderkey % 3 AS class, o_orderkey % 2000 AS claimed_at FROM orders)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    stage = F.when(k % 3 == 0, "embed").when(k % 3 == 1, "relate").otherwise("dedupe")
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("running")
    return table(spark, d, "orders").select(k.alias("id"), stage.alias("stage"), k.alias("target_id"), state.alias("state"), (k % 4).alias("attempts"), F.lit(0).cast("long").alias("run_after"), (k % 1000).alias("created_at"), (k % 9).alias("seq"), (k % 3).alias("class"), (k % 2000).alias("claimed_at"))


@query(f"""WITH {JOBS}, aged AS (SELECT *, CASE WHEN created_at < 500 THEN greatest(class - 1, 0) ELSE class END AS c FROM jobs) SELECT id, c AS class, attempts, seq FROM aged WHERE state = 'pending' ORDER BY c, attempts, seq, id LIMIT 40""")
def job_claims(spark: SparkSession, d: str) -> DataFrame:
    aged = reads.aged(_jobs(spark, d).withColumn("queued_at", F.col("created_at")), 1000, 500)
    return reads.pick(aged, ["class", "attempts", "seq", "id"], 40, F.col("state") == "pending").select("id", "class", "attempts", "seq")


@query(f"""WITH {JOBS}, n AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'embed' ELSE 'relate' END AS stage, l_orderkey + l_linenumber * 0 AS target_id, min(l_linenumber)::BIGINT AS seq FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2),
r AS (SELECT coalesce(j.stage, n.stage) AS stage, coalesce(j.target_id, n.target_id) AS target_id, n.target_id IS NOT NULL AND (j.target_id IS NULL OR j.state IN ('done', 'failed')) AS afresh, j.*, n.seq AS nseq FROM jobs j FULL JOIN n ON n.stage = j.stage AND n.target_id = j.target_id)
SELECT r.stage, r.target_id, CASE WHEN afresh THEN 'pending' WHEN state = 'running' AND claimed_at < 1000 - 600 THEN 'pending' ELSE state END AS state, CASE WHEN afresh THEN 0 ELSE attempts END AS attempts, CASE WHEN afresh THEN nseq ELSE seq END AS seq FROM r""".replace("coalesce(j.stage, n.stage) AS stage, coalesce(j.target_id, n.target_id) AS target_id", "coalesce(j.stage, n.stage) AS st, coalesce(j.target_id, n.target_id) AS ti").replace("SELECT r.stage, r.target_id", "SELECT r.st AS stage, r.ti AS target_id"))
def jobs_armed(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "lineitem").where("l_linenumber = 2").select(F.when(F.col("l_orderkey") % 3 == 0, "embed").otherwise("relate").alias("stage"), F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").cast("long").alias("seq"), F.lit(0).cast("long").alias("class")).distinct()
    return store.jobs_reclaimed(store.jobs_armed(_jobs(spark, d), new, 0, closed_only=True), 1000).select("stage", "target_id", "state", "attempts", "seq")


@query(f"""WITH {ARTS}, {JOBS} SELECT 'unrelated' AS what, id FROM art WHERE {LIVE} AND embed_state = 'embedded' AND provenance <> 'passage' AND id NOT IN (SELECT target_id FROM jobs WHERE stage = 'relate')
UNION ALL SELECT 'isolated', id FROM art WHERE embed_state = 'pending' AND id NOT IN (SELECT target_id FROM jobs WHERE stage = 'embed' AND state IN ('pending', 'running'))""")
def never_asked(spark: SparkSession, d: str) -> DataFrame:
    art, jobs = _arts(spark, d), _jobs(spark, d)
    one, two = store.never_related(art, jobs), store.isolated(art, jobs)
    return one.select(F.lit("unrelated").alias("what"), "id").unionByName(two.select(F.lit("isolated").alias("what"), "id"))


@query(f"""WITH {JOBS}, c AS (SELECT c_custkey AS corpus_id, CASE WHEN c_custkey % 3 = 0 THEN 'queued' WHEN c_custkey % 3 = 1 THEN 'processing' ELSE 'ready' END AS status FROM customer), s AS (SELECT o_custkey AS corpus_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT c.corpus_id, CASE WHEN s.n > 0 THEN 'window' ELSE 'segment' END AS missing FROM c LEFT JOIN s USING (corpus_id) WHERE status IN ('queued', 'processing') AND c.corpus_id NOT IN (SELECT target_id FROM jobs WHERE state IN ('pending', 'running'))""")
def unfinished_captures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    corpora = table(spark, d, "customer").select(k.alias("corpus_id"), F.when(k % 3 == 0, "queued").when(k % 3 == 1, "processing").otherwise("ready").alias("status"))
    windows = table(spark, d, "orders").select(F.col("o_custkey").alias("corpus_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"))
    return store.unfinished(corpora, _jobs(spark, d), windows)


PAIRS = "pr AS (SELECT DISTINCT least(l_partkey, l_suppkey * 7 + 1) AS a_id, greatest(l_partkey, l_suppkey * 7 + 1) AS b_id FROM lineitem WHERE l_partkey <> l_suppkey * 7 + 1), pairs2 AS (SELECT a_id * 100000 + b_id AS id, a_id, b_id, ((a_id * 31 + b_id) % 100) / 100.0 AS score, a_id % 3 AS attempts, (a_id + b_id) % 50 AS created_at, CASE WHEN b_id % 4 = 0 THEN 'dismissed' ELSE 'pending' END AS state FROM pr)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey"), F.col("l_suppkey") * 7 + 1
    ends = table(spark, d, "lineitem").where(x != y).select(F.least(x, y).alias("a_id"), F.greatest(x, y).alias("b_id")).distinct()
    a, b = F.col("a_id"), F.col("b_id")
    return ends.select((a * 100000 + b).alias("id"), "a_id", "b_id", (((a * 31 + b) % 100) / 100.0).alias("score"), (a % 3).alias("attempts"), ((a + b) % 50).alias("created_at"), F.when(b % 4 == 0, "dismissed").otherwise("pending").alias("state"))


@query(f"""WITH {ARTS}, {JOBS}, {PAIRS}, f AS (SELECT * FROM pairs2 WHERE state = 'pending' ORDER BY attempts, score DESC, created_at DESC, id LIMIT 200),
b AS (SELECT f.*, NOT (x.l AND y.l) AS dead FROM f JOIN (SELECT id, {LIVE} AS l FROM art) x ON x.id = f.a_id JOIN (SELECT id, {LIVE} AS l FROM art) y ON y.id = f.b_id),
p AS (SELECT *, coalesce(sum(CASE WHEN NOT dead THEN 1 ELSE 0 END) OVER (ORDER BY attempts, score DESC, created_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM b)
SELECT id, CASE WHEN dead THEN 'dismiss' ELSE 'arm' END AS action FROM p WHERE turn < 10""")
def judge_queue(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).withColumn("target_id", -F.col("target_id"))
    return store.judge_queue(_pairs(spark, d), _arts(spark, d), jobs, 10)


@query("""WITH e AS (SELECT o_orderkey AS event_id, o_orderdate, CASE WHEN o_orderkey % 9 = 0 THEN 'judge' ELSE 'ui' END AS door, CASE WHEN o_orderkey % 4 = 0 THEN 'hit' END AS verdict, o_custkey AS expected FROM orders),
s AS (SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS shown FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey)
SELECT e.event_id, s.shown, CASE WHEN verdict = 'hit' THEN expected END AS confirmed FROM e LEFT JOIN s ON s.l_orderkey = e.event_id WHERE event_id >= 100 AND event_id < 9000 AND door <> 'judge'""")
def events_between(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    events = table(spark, d, "orders").select(k.alias("event_id"), k.alias("at"), F.when(k % 9 == 0, "judge").otherwise("ui").alias("door"), F.when(k % 4 == 0, "hit").alias("verdict"), F.col("o_custkey").alias("expected"))
    shown = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") < 4).alias("shown"))
    return store.events_with_candidates(events, shown, 100, 9000).select("event_id", F.array_join(F.col("shown_ids").cast("array<string>"), ",").alias("shown"), "confirmed")


@query("""WITH t AS (SELECT l_orderkey AS event_id, l_linenumber AS n, count(*) % 2 AS odd FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2)
SELECT l_orderkey AS event_id, l_linenumber::BIGINT AS n, CASE WHEN t.odd = 1 THEN NOT (l_returnflag = 'A') ELSE l_returnflag = 'A' END AS carried FROM lineitem LEFT JOIN t ON t.event_id = l_orderkey AND t.n = l_linenumber""")
def carried_citations(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_returnflag") == "A").alias("carried"), "l_quantity")
    asks = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(None).cast("string").alias("verdict"))
    return store.asks_toggled(asks, lines.drop("l_quantity"), lines.where("l_quantity > 40").select("event_id", "n"))[1]


@query("""SELECT event_id AS id, event_type AS kind, CASE WHEN event_type = 'view' THEN least(floor(value * 10)::BIGINT, 600) ELSE floor(value * 10)::BIGINT END AS seconds FROM events""")
def dwells(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "dwell").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), F.floor(F.col("value") * 10).alias("seconds"))
    return store.dwell(rows).withColumn("kind", F.when(F.col("kind") == "dwell", "view").otherwise(F.col("kind")))


EVX = """ev AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS at, user_id AS scope, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS artifact_id FROM events)"""


@query(f"""WITH {EVX}, o AS (SELECT * FROM ev WHERE kind = 'click'), s AS (SELECT * FROM ev WHERE kind = 'view'),
m AS (SELECT o.id, max(s.at) AS t FROM o JOIN s ON s.scope = o.scope AND s.artifact_id % 20 = o.artifact_id % 20 AND o.at - s.at BETWEEN 0 AND 36000 GROUP BY o.id) SELECT o.id, coalesce(m.t, o.at) AS anchor FROM o LEFT JOIN m USING (id)""")
def open_anchors(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.plans.catalogue import _events

    ev = _events(spark, d).withColumn("artifact_id", F.col("artifact_id") % 20)
    seen = ev.where("kind = 'view'")
    return store.open_to_search(ev.where("kind = 'click'").select("id", "artifact_id", "scope", "at"), seen.select(F.col("id").alias("event_id"), "scope", "at"), seen.select(F.col("id").alias("event_id"), "artifact_id"), 36000)


@query(f"""WITH {EVX}, w AS (SELECT * FROM ev WHERE at < {NOW} - 86400) SELECT id, at FROM w WHERE at < (SELECT max(at) FROM w)""")
def watermarked(spark: SparkSession, d: str) -> DataFrame:
    from loamwork.plans.catalogue import _events

    old = logs.before_watermark(_events(spark, d).select("id", "at"), NOW, 86400)
    return logs.complete_seconds(old, 1)


# Links, pairs, gaps -----------------------------------------------------------------------------------------------

LINKS = f"{HEBB}, ln AS (SELECT a_id, b_id, n_events * 2.0 AS weight, {NOW} - 864000 AS bumped_at, CASE WHEN a_id % 9 = 0 THEN 'dismissed' WHEN a_id % 9 = 1 THEN 'related' ELSE 'learning' END AS state, a_id % 5 AS queries FROM pairs)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a_id")
    state = F.when(a % 9 == 0, "dismissed").when(a % 9 == 1, "related").otherwise("learning")
    return _first_links(spark, d).select("a_id", "b_id", (F.col("n_events") * 2.0).alias("weight"), F.lit(NOW - 864000).cast("long").alias("bumped_at"), state.alias("state"), (a % 5).alias("queries"))


@query(f"WITH {LINKS} SELECT count(*) AS links, count(*) FILTER (WHERE state = 'learning') AS learning, count(*) FILTER (WHERE state = 'related') AS related, count(*) FILTER (WHERE state = 'dismissed') AS dismissed FROM ln")
def link_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.link_counts(_links(spark, d))


@query(f"""WITH {LINKS}, b AS (SELECT a_id AS id, b_id AS other, state FROM ln UNION ALL SELECT b_id, a_id, state FROM ln) SELECT b.* FROM b JOIN supplier ON s_suppkey = b.id""")
def links_touching(spark: SparkSession, d: str) -> DataFrame:
    return store.links_touching(_links(spark, d).select("a_id", "b_id", "state"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query(f"""WITH {LINKS} SELECT a_id, b_id, CASE WHEN state = 'dismissed' THEN 'dismissed' WHEN b_id % 6 = 0 THEN 'related' ELSE state END AS state FROM ln""")
def link_states(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    changes = links.where("b_id % 6 = 0").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.lit("related").alias("state"))
    return store.link_states(links, changes).select("a_id", "b_id", "state")


@query(f"""WITH {LINKS}, o AS (SELECT p_partkey AS id, p_size AS c FROM part) SELECT a_id, b_id FROM ln JOIN o x ON x.id = a_id JOIN o y ON y.id = b_id
WHERE state = 'learning' AND queries >= 3 AND weight * power(2.0, -(864000) / (30 * 86400.0)) >= 1.5 AND x.c <> y.c""")
def links_to_judge(spark: SparkSession, d: str) -> DataFrame:
    origins = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_size").alias("corpora"))
    return logs.links_to_judge(_links(spark, d), origins, NOW, least=1.5).select("a_id", "b_id")


@query(f"""WITH {LINKS} SELECT a_id, b_id, CASE WHEN state = 'related' AND (a_id % 4 <> 0 OR b_id % 4 <> 0) THEN 'learning' ELSE state END AS state FROM ln""")
def reopened_links(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d).withColumn("judged_rev_a", F.lit(0).cast("long")).withColumn("judged_rev_b", F.lit(0).cast("long"))
    return logs.reopened(links, table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("rev")), _link_parts(spark, d)).select("a_id", "b_id", "state")


@query("""WITH v AS (SELECT o_orderkey AS event_id, o_custkey AS expected FROM orders), c AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey % 150 AS id FROM lineitem), s AS (SELECT v.* FROM v JOIN c ON c.event_id = v.event_id AND c.id = v.expected)
SELECT least(expected, id) AS a_id, greatest(expected, id) AS b_id, (count(*) * 2.0)::DOUBLE AS gain FROM s JOIN c USING (event_id) WHERE expected <> id GROUP BY 1, 2""")
def verdict_links(spark: SparkSession, d: str) -> DataFrame:
    verdicts = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("expected"), F.lit(0).alias("at"))
    shown = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") % 150).alias("id")).distinct()
    return logs.verdict_bumps(verdicts, shown)[0]


@query(f"""WITH {PAIRS}, m AS (SELECT CASE WHEN a_id % 10 = 7 THEN a_id - 7 ELSE a_id END AS x, CASE WHEN b_id % 10 = 7 THEN b_id - 7 ELSE b_id END AS y, score FROM pairs2)
SELECT least(x, y) AS a_id, greatest(x, y) AS b_id, max(score)::DOUBLE AS score FROM m WHERE x <> y GROUP BY 1, 2""")
def repointed_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = dedup.canonical_pairs(_pairs(spark, d).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "score"))
    moved = pairs.select(F.explode(F.array("a_id", "b_id")).alias("old_id")).distinct().where("old_id % 10 = 7").withColumn("new_id", F.col("old_id") - 7)
    return dedup.repoint_pairs(pairs, moved).withColumn("score", F.col("score").cast("double"))


@query(f"""WITH {ARTS}, {PAIRS} SELECT p.a_id, p.b_id, CASE WHEN x.id IS NOT NULL AND y.id IS NOT NULL AND coalesce(x.status, 'active') = 'active' AND x.superseded_by IS NULL AND coalesce(y.status, 'active') = 'active' AND y.superseded_by IS NULL THEN 'pending'
  WHEN x.superseded_by IS NOT DISTINCT FROM p.b_id OR y.superseded_by IS NOT DISTINCT FROM p.a_id THEN 'settled' ELSE 'dismissed' END AS state FROM pairs2 p LEFT JOIN art x ON x.id = p.a_id LEFT JOIN art y ON y.id = p.b_id""")
def closed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.closed_pairs(_pairs(spark, d).select("a_id", "b_id"), _arts(spark, d))


@query(f"""WITH {ARTS}, {PAIRS}, t AS (SELECT id, segment_idx AS s, lower(CASE WHEN id % 6 = 0 THEN string_split(text, ' ')[1] ELSE text END) AS t FROM art),
b AS (SELECT p.a_id, p.b_id, coalesce(x.s = y.s, false) AS same, y.t <> '' AND contains(x.t, y.t) AS ba, x.t <> '' AND contains(y.t, x.t) AS ab FROM pairs2 p JOIN t x ON x.id = p.a_id JOIN t y ON y.id = p.b_id)
SELECT a_id, b_id, CASE WHEN same THEN 'skip' WHEN ba OR ab THEN 'supersede' ELSE 'file' END AS action, CASE WHEN same THEN NULL WHEN ba THEN b_id WHEN ab THEN a_id END AS obsolete_id FROM b""")
def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    short = F.when(F.col("id") % 6 == 0, F.get(F.split("text", " "), F.lit(0))).otherwise(F.col("text"))
    art = _arts(spark, d).select("id", F.col("segment_idx").alias("segment"), short.alias("text"))
    return dedup.classify_pairs(_pairs(spark, d).select("a_id", "b_id", "score"), art).drop("score")


@query(f"""WITH {PAIRS}, v AS (SELECT a_id, b_id, CASE (a_id + b_id) % 5 WHEN 0 THEN 'replaced' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'distinct' WHEN 3 THEN 'odd' END AS v, a_id % 10 AS ac, b_id % 10 AS bc FROM pairs2)
SELECT a_id, b_id, CASE WHEN v = 'replaced' THEN CASE WHEN a_id = CASE WHEN ac <= bc THEN a_id ELSE b_id END THEN 'settled' ELSE 'conflict' END WHEN v = 'duplicate' THEN CASE WHEN a_id % 2 > 0 THEN 'conflict' ELSE 'mergeable' END WHEN v = 'distinct' THEN 'dismissed' ELSE 'pending' END AS state FROM v""")
def interpreted_verdicts(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a_id"), F.col("b_id")
    k = (a + b) % 5
    verdict = F.when(k == 0, "replaced").when(k == 1, "duplicate").when(k == 2, "distinct").when(k == 3, "odd")
    return lifecycle.interpreted(_pairs(spark, d).select("a_id", "b_id", (a % 10).alias("a_created"), (b % 10).alias("b_created"), verdict.alias("verdict"), a.alias("replaced_id"), (a % 2).alias("n_lost")))


@query(f"""WITH RECURSIVE {PAIRS}, {label_sql("SELECT a_id AS u, b_id AS v FROM pairs2 WHERE state = 'pending'")}
SELECT a_id, b_id FROM pairs2 WHERE state = 'pending' AND a_id IN (SELECT node FROM lab WHERE c IN (SELECT c FROM lab JOIN supplier ON node = s_suppkey))""")
def open_component(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).where("state = 'pending'").select("a_id", "b_id")
    return reads.open_component(pairs, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""WITH cl AS (SELECT c_nationkey::VARCHAR AS key, 'ask' AS kind, c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), op AS (SELECT 'ask' AS kind, o_custkey AS id FROM orders GROUP BY o_custkey)
SELECT key, kind, id FROM cl SEMI JOIN op USING (kind, id) UNION ALL SELECT NULL, kind, id FROM op ANTI JOIN cl USING (kind, id)""")
def gap_rows(spark: SparkSession, d: str) -> DataFrame:
    member = F.struct(F.lit("ask").alias("kind"), F.col("c_custkey").alias("id"))
    clusters = table(spark, d, "customer").where("c_custkey % 3 <> 0").groupBy(F.col("c_nationkey").cast("string").alias("key")).agg(F.collect_list(member).alias("members"))
    return metrics.gap_rows(clusters, table(spark, d, "orders").select(F.lit("ask").alias("kind"), F.col("o_custkey").alias("id")).distinct())


COVER = "cv AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'ask' WHEN 1 THEN 'search' ELSE 'unmatched' END AS kind, o_custkey AS gap_id, o_orderkey AS artifact_id, o_orderkey % 100 AS covered_at FROM orders), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, gap_id ORDER BY covered_at DESC, artifact_id DESC) AS n FROM cv) WHERE n = 1)"


@query(f"""WITH {COVER} SELECT t.kind, t.gap_id, t.artifact_id, t.covered_at, coalesce(a.p_name, s.s_name) AS text FROM top t LEFT JOIN part a ON t.kind = 'ask' AND a.p_partkey = t.gap_id LEFT JOIN supplier s ON t.kind IN ('search', 'unmatched') AND s.s_suppkey = t.gap_id WHERE coalesce(a.p_name, s.s_name) IS NOT NULL""")
def covered_gap_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 3 == 0, "ask").when(k % 3 == 1, "search").otherwise("unmatched").alias("kind"), F.col("o_custkey").alias("gap_id"), k.alias("artifact_id"), (k % 100).alias("covered_at"))
    known = store.covered_upsert(rows.where("artifact_id % 2 = 0"), rows.where("artifact_id % 2 = 1"))
    searches = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return store.gap_texts(known, {"ask": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "search": searches, "unmatched": searches})


@query("""WITH b AS (SELECT l_orderkey AS event_id, max(l_discount * 10) AS best FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS event_id, best FROM orders JOIN b ON b.event_id = o_orderkey WHERE best < 0.35""")
def unmatched_searches(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_discount") * 10).alias("similarity"))
    return metrics.unmatched(table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), shown)


# Artifacts --------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS content_hash FROM part WHERE p_partkey % 3 = 0), n AS (SELECT p_partkey AS id, p_name AS content_hash FROM part WHERE p_partkey % 3 <> 0)
SELECT id, content_hash FROM t UNION ALL SELECT min(id), content_hash FROM n WHERE content_hash NOT IN (SELECT content_hash FROM t) GROUP BY content_hash""")
def inserted_new(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content_hash"))
    return dedup.insert_new(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"))


@query(f"""WITH {ARTS}, {SOURCES}, own AS (SELECT s.child_id AS id, list_sort(list_distinct(list(r.corpus_id))) AS c FROM src s JOIN art r ON r.id = s.root_id GROUP BY s.child_id)
SELECT a.id, CASE WHEN own.c IS NOT NULL THEN array_to_string(own.c, ',') WHEN provenance IN ('merged', 'synthesized') THEN '' ELSE a.corpus_id::VARCHAR END AS corpora FROM art a LEFT JOIN own ON own.id = a.id""")
def origins(spark: SparkSession, d: str) -> DataFrame:
    return dedup.origins(_arts(spark, d), _sources(spark, d)).select("id", F.array_join(F.col("corpora").cast("array<string>"), ",").alias("corpora"))


@query(f"WITH {ARTS} SELECT id, superseded_by FROM art WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM art)")
def unsupported_pointers(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).select("id", "superseded_by")
    return reads.unsupported(art, art, "superseded_by").select("id", "superseded_by")


@query("""WITH p AS (SELECT doc_id * 10 + k AS passage_id, doc_id, k * 4 + 1 AS s, k * 4 + 4 AS e FROM documents, (SELECT unnest([0, 1, 2]) AS k)), a AS (SELECT doc_id * 10 + k AS artifact_id, doc_id, k * 3 + doc_id % 3 AS s, k * 3 + doc_id % 3 + 2 + doc_id % 4 AS e, k AS ordinal FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k)),
o AS (SELECT passage_id, artifact_id, ordinal, least(p.e, a.e) - greatest(p.s, a.s) + 1 AS n, p.e - p.s + 1 AS size FROM p JOIN a USING (doc_id))
SELECT passage_id, artifact_id FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY n DESC, ordinal, artifact_id DESC) AS r FROM o WHERE n * 2 > size) WHERE r = 1""")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    k = lambda n: F.explode(F.array(*[F.lit(x) for x in range(n)]))
    docs = table(spark, d, "documents").select("doc_id")
    passages = docs.select("doc_id", k(3).alias("k")).select((F.col("doc_id") * 10 + F.col("k")).alias("passage_id"), "doc_id", (F.col("k") * 4 + 1).alias("start_line"), (F.col("k") * 4 + 4).alias("end_line"))
    first = F.col("k") * 3 + F.col("doc_id") % 3
    spans = docs.select("doc_id", k(4).alias("k")).select((F.col("doc_id") * 10 + F.col("k")).alias("artifact_id"), "doc_id", first.alias("start_line"), (first + 2 + F.col("doc_id") % 4).alias("end_line"), F.col("k").alias("ordinal"))
    return joins.best_overlap(passages, spans)


@query("SELECT p_partkey AS id, 'no_point' AS side FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'no_row' FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)")
def drift(spark: SparkSession, d: str) -> DataFrame:
    return dedup.drift(table(spark, d, "part").select(F.col("p_partkey").alias("id")), _corpus(spark, d).select("id"))


@query(f"""WITH {ARTS} SELECT corpus_id, CASE WHEN count(*) FILTER (WHERE embed_state = 'pending') > 0 THEN 'pending' WHEN count(*) FILTER (WHERE embed_state = 'failed') > 0 THEN 'partial' ELSE 'ready' END AS state, count(*) AS total, count(*) FILTER (WHERE embed_state = 'embedded') AS embedded FROM art GROUP BY corpus_id""")
def settled_corpora(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d)
    return lifecycle.settled_corpora(art).join(store.progress(art, "corpus_id", "embed_state", ("embedded",)), "corpus_id")


@query(f"""WITH {ARTS} SELECT id, ordinal + CASE WHEN corpus_id % 2 = 0 AND ordinal > 3 THEN 5 ELSE 0 END AS ordinal FROM art""")
def room_made(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d)
    after = art.where("corpus_id % 2 = 0").select("corpus_id", F.lit(3).alias("position"), F.lit(5).alias("n")).distinct()
    return lifecycle.make_room(art, after).select("id", "ordinal")


@query(f"""WITH {ARTS} SELECT id, CASE WHEN id % 6 = 0 AND superseded_by IS NULL THEN 'deprecated' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 77 ELSE created_at END AS verified_at, CASE WHEN id % 4 = 0 THEN 0 ELSE 9 END AS hit_count FROM art""")
def deprecated_and_verified(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).withColumn("verified_at", F.col("created_at")).withColumn("hit_count", F.lit(9))
    out = lifecycle.verify(lifecycle.deprecate(art, art.where("id % 6 = 0").select("id")), art.where("id % 4 = 0").select("id"), 77)
    return out.select("id", "status", "verified_at", "hit_count")


@query("""WITH c AS (SELECT c_custkey AS id, 'needs_review' AS status FROM customer), x AS (SELECT c_custkey AS id, c_custkey - 1 AS near_id, CASE c_custkey % 30 WHEN 0 THEN 'replace' WHEN 10 THEN 'discard' ELSE 'keep_both' END AS action FROM customer WHERE c_custkey % 10 = 0),
g AS (SELECT near_id AS id FROM x WHERE action = 'replace' UNION SELECT id FROM x WHERE action = 'discard') SELECT c.id, CASE WHEN f.id IS NOT NULL THEN 'queued' ELSE c.status END AS status FROM c LEFT JOIN x f ON f.id = c.id AND f.action <> 'discard' WHERE c.id NOT IN (SELECT id FROM g)""")
def resolved_near(spark: SparkSession, d: str) -> DataFrame:
    corpora = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("needs_review").alias("status"))
    action = F.when(F.col("id") % 30 == 0, "replace").when(F.col("id") % 30 == 10, "discard").otherwise("keep_both")
    return lifecycle.resolve_near_duplicates(corpora, corpora.where("id % 10 = 0").select("id", (F.col("id") - 1).alias("near_id"), action.alias("action")))


@query("""WITH t AS (SELECT l_orderkey AS draft_id, l_linenumber AS place, l_returnflag AS a, l_linestatus AS b FROM lineitem), e AS (SELECT draft_id, place, a, b, 0 AS k, a AS tag FROM t UNION ALL SELECT draft_id, place, a, b, 1, b FROM t), f AS (SELECT draft_id, tag, min((place, a, b, k)) AS first FROM e GROUP BY draft_id, tag)
SELECT draft_id, string_agg(tag, ',' ORDER BY first) AS tags FROM f GROUP BY draft_id""")
def carried_tags(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("place"), F.array("l_returnflag", "l_linestatus").alias("tags"))
    return lifecycle.carried_tags(drafts).select("draft_id", F.array_join("tags", ",").alias("tags"))


@query("""WITH v AS (SELECT o_orderkey AS event_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'hit' WHEN '2-HIGH' THEN 'gap' WHEN '3-MEDIUM' THEN 'undo' WHEN '5-LOW' THEN 'skip' END AS v FROM orders)
SELECT event_id, CASE WHEN v IN ('hit', 'gap') THEN v WHEN v = 'undo' THEN NULL ELSE 'discard' END AS verdict, CASE WHEN v = 'hit' THEN event_id * 2 WHEN v IN ('gap', 'undo') THEN NULL ELSE event_id END AS expected, 1 + CASE WHEN v = 'skip' THEN 1 ELSE 0 END AS skips FROM v""")
def judged_events(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    verdict = F.when(p == "1-URGENT", "hit").when(p == "2-HIGH", "gap").when(p == "3-MEDIUM", "undo").when(p == "5-LOW", "skip")
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("discard").alias("verdict"), F.col("o_orderkey").alias("expected"), F.lit(1).alias("skips"))
    given = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), verdict.alias("verdict"), (F.col("o_orderkey") * 2).alias("expected")).where("verdict is not null")
    return reads.with_verdicts(events, given)


@query(f"""WITH {ARTS}, {SOURCES}, h AS (SELECT child_id AS id, count(DISTINCT root_id) AS n FROM src GROUP BY child_id) SELECT a.id, 2 AS source_count, coalesce(h.n, 0) AS n FROM art a LEFT JOIN h ON h.id = a.id WHERE provenance IN ('merged', 'synthesized') AND coalesce(h.n, 0) < 2""")
def stranded_merges(spark: SparkSession, d: str) -> DataFrame:
    return reads.stranded_merges(_arts(spark, d).withColumn("source_count", F.lit(2)), _sources(spark, d))


@query(f"""WITH {ARTS}, {SOURCES}, m AS (SELECT id FROM art WHERE {LIVE} AND provenance = 'merged' AND id % 3 = 0),
roots AS (SELECT s.root_id AS id, s.child_id AS w FROM src s JOIN m ON m.id = s.child_id JOIN art r ON r.id = s.root_id AND {LIVE.replace("status", "r.status").replace("superseded_by", "r.superseded_by")}),
others AS (SELECT id FROM art WHERE {LIVE} AND provenance = 'merged'), size AS (SELECT child_id, count(*) AS n FROM src JOIN others ON others.id = child_id GROUP BY child_id),
sub AS (SELECT y.child_id AS id, x.child_id AS w FROM src x JOIN m ON m.id = x.child_id JOIN src y ON y.root_id = x.root_id AND y.child_id <> x.child_id JOIN size z ON z.child_id = y.child_id GROUP BY y.child_id, x.child_id, z.n HAVING count(*) = z.n),
hid AS (SELECT id, min(w) AS w FROM (SELECT * FROM roots UNION ALL SELECT * FROM sub) WHERE id NOT IN (SELECT id FROM m) GROUP BY id)
SELECT a.id, CASE WHEN h.id IS NOT NULL THEN 'superseded' ELSE a.status END AS status, CASE WHEN h.id IS NOT NULL THEN h.w ELSE coalesce(g.w, a.superseded_by) END AS superseded_by FROM art a LEFT JOIN hid h ON h.id = a.id LEFT JOIN hid g ON g.id = a.superseded_by""")
def merges_finished(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d)
    return store.merge_finished(art, _sources(spark, d), art.where("id % 3 = 0").select("id")).select("id", "status", "superseded_by")


@query(f"""WITH {ARTS}, u AS (SELECT id FROM art WHERE provenance = 'merged' AND id % 2 = 0) SELECT id, CASE WHEN lost THEN 'deprecated' ELSE status END AS status, superseded_by FROM (
SELECT a.id, CASE WHEN a.id IN (SELECT id FROM u) THEN 'deprecated' WHEN a.superseded_by IN (SELECT id FROM u) THEN 'active' ELSE a.status END AS status, CASE WHEN a.superseded_by IN (SELECT id FROM u) THEN NULL ELSE a.superseded_by END AS superseded_by,
  coalesce(CASE WHEN a.id IN (SELECT id FROM u) THEN 'deprecated' WHEN a.superseded_by IN (SELECT id FROM u) THEN 'active' ELSE a.status END, 'active') = 'active' AND (a.superseded_by IS NULL OR a.superseded_by IN (SELECT id FROM u)) AND provenance = 'merged' AND embed_state = 'failed' AS lost FROM art a)""")
def merges_undone(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d)
    return store.merges_reaped(store.merge_undone(art, art.where("id % 2 = 0").select("id"))).select("id", "status", "superseded_by")


@query(f"""WITH {ARTS}, {SOURCES}, w AS (SELECT DISTINCT c_custkey AS need, coalesce(s.root_id, n.id) AS m FROM (SELECT c_custkey, unnest([c_custkey, c_custkey // 3]) AS id FROM customer) n LEFT JOIN src s ON s.child_id = n.id), z AS (SELECT need, count(*) AS n FROM w GROUP BY need),
t AS (SELECT child_id AS id, root_id AS m FROM src JOIN art ON art.id = child_id AND provenance = 'synthesized') SELECT need, min(id) AS covering FROM (SELECT w.need, t.id FROM w JOIN t USING (m) JOIN z USING (need) GROUP BY w.need, t.id, z.n HAVING count(*) = z.n) GROUP BY need""")
def needs_covered(spark: SparkSession, d: str) -> DataFrame:
    needs = table(spark, d, "customer").select(F.col("c_custkey").alias("need"), F.explode(F.array(F.col("c_custkey"), F.floor(F.col("c_custkey") / 3))).alias("id"))
    return store.already_covered(needs, _sources(spark, d), _arts(spark, d))


@query(f"""WITH {ARTS}, {SOURCES}, known AS (SELECT child_id, root_id FROM src WHERE child_id % 2 = 0), n AS (SELECT id, id // 4 AS via FROM art WHERE id % 2 = 1 AND id // 4 > 0)
SELECT child_id, root_id, child_id AS via FROM known UNION ALL SELECT n.id, coalesce(k.root_id, n.via), n.via FROM n LEFT JOIN known k ON k.child_id = n.via""")
def sources_inserted(spark: SparkSession, d: str) -> DataFrame:
    known = _sources(spark, d).where("child_id % 2 = 0").withColumn("via", F.col("child_id"))
    art = _arts(spark, d).select("id")
    new = art.where("id % 2 = 1 and id >= 4").withColumn("via", F.array(F.floor(F.col("id") / 4)))
    return store.inserted(art.where("id % 2 = 0"), known, new)[1]


@query(f"""WITH {ARTS} SELECT id, CASE WHEN id % 6 = 0 THEN 'b,a' WHEN id % 6 = 1 THEN '' ELSE 'old' END AS flags, CASE WHEN id % 6 = 0 THEN 'n' WHEN id % 6 = 1 THEN NULL ELSE 'was' END AS note FROM art""")
def flagged(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).select("id", F.array(F.lit("old")).alias("flags"), F.lit("was").alias("note"))
    given = F.when(F.col("id") % 6 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    flags = art.where("id % 6 < 2").select("id", given.alias("flags"), F.lit("n").alias("note"))
    return store.flagged(art, flags).select("id", F.array_join("flags", ",").alias("flags"), "note")


@query(f"""WITH {ARTS} SELECT id, CASE WHEN id % 5 = 0 AND (status IS DISTINCT FROM 'deprecated') THEN true ELSE false END AS dirty FROM art""")
def dirtied(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).withColumn("dirty", F.lit(False))
    after = store.set_where(art, art.where("id % 5 = 0").select("id"), status=F.lit("deprecated"))
    return store.dirtied(art, after).select("id", "dirty")


@query(f"""WITH {ARTS}, o AS (SELECT p_partkey AS corpus_id, p_partkey % 3 AS idx, CASE WHEN p_partkey % 4 = 0 THEN 'done' ELSE 'pending' END AS state FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey AS corpus_id, 9 AS idx, 'pending' AS state FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT * FROM n WHERE corpus_id NOT IN (SELECT corpus_id FROM o WHERE state = 'done') AND corpus_id NOT IN (SELECT corpus_id FROM art WHERE segment_idx IS NOT NULL AND corpus_id % 5 = 0)) SELECT * FROM o WHERE corpus_id NOT IN (SELECT corpus_id FROM f) UNION ALL SELECT * FROM f""")
def segments_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Corpora are numbered as parts, every seventh has no window yet, and every other one is cut anew."""
    k = F.col("p_partkey")
    old = table(spark, d, "part").where("p_partkey % 7 <> 0").select(k.alias("corpus_id"), (k % 3).alias("idx"), F.when(k % 4 == 0, "done").otherwise("pending").alias("state"))
    new = table(spark, d, "part").where("p_partkey % 2 = 0").select(k.alias("corpus_id"), F.lit(9).cast("long").alias("idx"), F.lit("pending").alias("state"))
    return store.segments_replaced(old, new, _arts(spark, d).where("corpus_id % 5 = 0"))


@query("""SELECT l_orderkey AS event_id, l_linenumber::BIGINT AS n, CASE l_returnflag WHEN 'A' THEN 'unknown' WHEN 'R' THEN 'dropped' ELSE
  CASE WHEN l_linenumber = 7 THEN 'missed' WHEN l_linenumber * 2 >= 10 THEN 'misplaced' WHEN l_linenumber > 1 THEN 'low' ELSE 'top' END END AS diagnosis FROM lineitem""")
def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    rank = F.when(n == 1, 0).when(n != 7, n * 2)
    verdict = F.when(F.col("l_returnflag") == "A", "gap").when(F.col("l_returnflag") == "R", "discard").otherwise("hit")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), n.cast("long").alias("n"), store.diagnosis(rank, verdict).alias("diagnosis"))


@query(f"""WITH {ARTS}, c AS (SELECT id AS passage_id, id // 3 AS artifact_id FROM art WHERE id >= 3 AND id % 2 = 0), a AS (SELECT id, (id % 9) * power(2.0, -(864000 * (id % 3)) / (14 * 86400.0)) AS v FROM art WHERE id % 4 <> 1)
SELECT c.artifact_id AS id, round(greatest(max(a.v), coalesce(any_value(o.v), 1.0)), 6) AS activation FROM c JOIN a ON a.id = c.passage_id LEFT JOIN a o ON o.id = c.artifact_id GROUP BY c.artifact_id""")
def carried_activation(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).select("id")
    covered = art.where("id >= 3 and id % 2 = 0").select(F.col("id").alias("passage_id"), F.floor(F.col("id") / 3).alias("artifact_id"))
    known = art.where("id % 4 <> 1").select("id", (F.col("id") % 9).cast("double").alias("value"), (NOW - 864000 * (F.col("id") % 3)).alias("since"))
    return store.carried_activation(covered, known, NOW)


@query(f"""WITH {ARTS} SELECT DISTINCT corpus_id, segment_idx FROM art WHERE {LIVE} AND provenance = 'passage' AND (id % 9) * power(2.0, -864000 / (14 * 86400.0)) >= 4""")
def promoted(spark: SparkSession, d: str) -> DataFrame:
    art = _arts(spark, d).withColumn("activation", (F.col("id") % 9).cast("double")).withColumn("activated_at", F.lit(NOW - 864000))
    return logs.to_promote(art, NOW)


@query("""WITH s AS (SELECT l_partkey AS id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS c FROM lineitem GROUP BY l_partkey) SELECT p_partkey AS id FROM part JOIN s ON s.id = p_partkey WHERE s.n >= 20 AND s.c <= 4""")
def resynthesised(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n_shown"), F.when(F.count_if(F.col("l_returnflag") == "A") > 4, 1).otherwise(0).alias("n_confirmed"))
    return reads.to_resynthesise(table(spark, d, "part").select(F.col("p_partkey").alias("id")), shown, 20)


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey % 20 AS want FROM orders), c AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 20 AS got FROM lineitem), k AS (SELECT q.id, count(c.got) FILTER (WHERE c.got = q.want) > 0 AS ok FROM q LEFT JOIN c ON c.id = q.id GROUP BY q.id) SELECT round(avg(ok::INT), 6) AS citation_recall FROM k""")
def citation_recall(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 20).alias("cited"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") % 20).alias("expected"))
    return metrics.citation_recall(asked.join(cited, "id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<bigint>"))))


@query("""WITH c AS (SELECT l_orderkey AS a, l_linenumber <= 4 OR l_suppkey % 7 BETWEEN 1 AND 4 AS ok FROM lineitem), p AS (SELECT a, count(*) AS n, count(*) FILTER (WHERE ok) AS s FROM c GROUP BY a) SELECT count(*) FILTER (WHERE n = s) AS fully_supported, round(1 - sum(s) / sum(n), 6) AS unsupported_rate FROM p""")
def support_rates(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 7).alias("sources"), F.lit(4).alias("n_sources"))
    return metrics.support_rates(claims)


@query(f"""WITH {TOKENS} SELECT id, md5(string_agg(term, ' ' ORDER BY term)) AS terms_md5 FROM post GROUP BY id""")
def token_columns(spark: SparkSession, d: str) -> DataFrame:
    """The column form of the tokenizer."""
    terms = F.array_sort(F.array_distinct(tx.lexical_tokens(F.coalesce("text", F.lit("")))))
    return _docs(spark, d).select("id", F.md5(F.array_join(terms, " ")).alias("terms_md5")).where(F.size(tx.lexical_tokens(F.lit("x"))) > 0).join(retrieval.postings(_docs(spark, d)).select("id").distinct(), "id", "left_semi")


@query(r"""SELECT item_id AS q_id, text, length(t)::DOUBLE AS whole, length(string_split(t, ' ')[1])::DOUBLE AS first FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM benchmark)""")
def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of query texts by a stand-in for a model: lengths of the text and of its first word."""
    embed = lambda t: F.array(F.char_length(t).cast("double"), F.char_length(F.get(F.split(t, " "), F.lit(0))).cast("double"))
    return search.query_vectors(_items(spark, d), embed).select("q_id", "text", F.get("vector", F.lit(0)).alias("whole"), F.get("vector", F.lit(1)).alias("first"))
