"""Queries over the standard tables, one per operator or small group, with DuckDB SQL for the same rows.

Each runs over its whole tables. Retrieval queries take as their query set the rows whose id
20 divides, or the benchmark items. Doubles are rounded; ids are the last sort key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions import text as tx
from loamwork.functions.vectors import cosine, norm
from loamwork.operators import context, dedup, joins, lifecycle, logs, metrics, reads, retrieval, segments
from loamwork.operators.dealing import parts_of
from loamwork.operators.graph import connected_components
from loamwork.plans.registry import QUERIES, SQL, query
from loamwork.sources.capture import captured_pages, table

#: The end of the event log's month, as epoch seconds.
NOW = 1706745600
IDLE = 21600


# Shared inputs ------------------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("id") % 20 == 0).select(F.col("id").alias("q_id"), "vector")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), "text")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Event log: scope is the user, the artifact is in the properties."""
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), at.alias("at"), F.col("user_id").alias("scope"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("artifact_id"), "props"
    )


EV = """ev AS (
  SELECT event_id AS id, floor(epoch(ts))::BIGINT AS at, user_id AS scope, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS artifact_id, props
  FROM events
)"""
COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0"
DENSE = f"""scored AS (
  SELECT a.vec_id AS q_id, b.vec_id AS id, {COS} AS score, b.label FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
), dense AS (
  SELECT * FROM (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM scored) WHERE rank < 10
)"""
TOKENS = r"""runs AS (
  SELECT doc_id AS id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\-_./]+'), lambda t: lower(trim(t, '-_./')))) AS t FROM documents
), toks AS (
  SELECT id, t FROM runs WHERE t <> '' AND strlen(t) <= 40
  UNION ALL
  SELECT id, p AS t FROM (SELECT id, unnest(regexp_split_to_array(t, '[\-_./]+')) AS p FROM runs WHERE regexp_matches(t, '[\-_./]')) WHERE p <> '' AND strlen(p) <= 40
), post AS (SELECT id, t AS term, count(*) AS tf FROM toks GROUP BY id, t)"""
BM25 = TOKENS + r""", qruns AS (
  SELECT item_id AS q_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\-_./]+'), lambda t: lower(trim(t, '-_./')))) AS t FROM benchmark
), qt AS (
  SELECT DISTINCT q_id, term FROM (
    SELECT q_id, t AS term FROM qruns WHERE t <> '' AND strlen(t) <= 40
    UNION ALL
    SELECT q_id, p FROM (SELECT q_id, unnest(regexp_split_to_array(t, '[\-_./]+')) AS p FROM qruns WHERE regexp_matches(t, '[\-_./]')) WHERE p <> '' AND strlen(p) <= 40)
), df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1) AS idf FROM df),
lex AS (
  SELECT * FROM (
    SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank FROM (
      SELECT q_id, id, round(sum(idf * (tf * 2.2 / (tf + 1.2))), 6) AS score FROM post JOIN qt USING (term) JOIN idf USING (term) GROUP BY q_id, id))
  WHERE rank < 20
)"""


def _lexical(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieval.bm25_topk(_docs(spark, d).select("id", "text"), _items(spark, d), k)


# Vectors and retrieval ------------------------------------------------------------------------------------


@query(f"WITH {DENSE} SELECT q_id, id, rank, score FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return retrieval.dense_topk(corpus, _asked(corpus), 10)


@query(f"""WITH {DENSE}
SELECT * FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank, score FROM scored WHERE label = 3) WHERE rank < 5""")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return retrieval.dense_topk(corpus.where("label = 3"), _asked(corpus), 5)


@query(f"""WITH {DENSE}, near AS (
  SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS n FROM scored WHERE q_id <> id AND score >= 0.3)
SELECT DISTINCT least(q_id, id) AS a_id, greatest(q_id, id) AS b_id, score FROM near WHERE n <= 5""")
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return retrieval.neighbour_pairs(corpus, _asked(corpus), 5, 0.3)


@query("""WITH s AS (SELECT a.vec_id AS q_id, b.label AS id, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.label)
SELECT * FROM (SELECT q_id, id::BIGINT AS id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank, score FROM s) WHERE rank < 3""")
def max_similarity(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return retrieval.max_similarity(corpus.select(F.col("label").cast("long").alias("id"), "vector"), _asked(corpus), 3)


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding)::BIGINT AS size FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("id", F.round(norm(F.col("vector")), 6).alias("norm"), F.size("vector").cast("long").alias("size"))


@query(f"WITH {BM25} SELECT q_id, id, rank, score FROM lex")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


@query(f"""WITH {BM25}, short AS (
  SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY n_chars, id) - 1 AS rank FROM lex JOIN documents ON doc_id = id),
parts AS (SELECT q_id, id, 1.0::DOUBLE / (rank + 61) AS part FROM lex UNION ALL SELECT q_id, id, 1.0::DOUBLE / (rank + 61) FROM short),
f AS (SELECT q_id, id, round(sum(part), 9) AS score FROM parts GROUP BY q_id, id)
SELECT * FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank, score FROM f) WHERE rank < 10""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    lexical = _lexical(spark, d)
    short = retrieval.ranked(lexical.drop("rank", "score").join(_docs(spark, d).select("id", "n_chars"), "id"), "n_chars", "id")
    return retrieval.rrf_fusion([lexical, short], limit=10)


@query(f"""WITH {DENSE}, s AS (
  SELECT q_id, id, round(score + 0.05 * power(2.0, -(id * 86400) / (180 * 86400.0)) + CASE WHEN id % 7 = 0 THEN 0.15 ELSE 0 END, 6) AS score FROM dense)
SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) - 1 AS rank, score FROM s""")
def recency_pinned_score(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("id") % 7 == 0, F.array(F.lit("pinned"))).otherwise(F.array(F.lit("x")))
    hits = dense_topk(spark, d).withColumn("verified_at", NOW - F.col("id") * 86400).withColumn("tags", tags)
    return retrieval.final_score(hits, NOW).select("q_id", "id", "rank", "score")


@query(f"""WITH {BM25}, g AS (SELECT l.q_id, l.id, l.rank, l.score, o.source FROM lex l JOIN documents o ON o.doc_id = l.id),
m AS (SELECT *, row_number() OVER (PARTITION BY q_id, source ORDER BY rank) > 1 AS displaced FROM g),
r AS (SELECT q_id, id, source, score, displaced, row_number() OVER (PARTITION BY q_id ORDER BY displaced, rank) - 1 AS rank FROM m)
SELECT * FROM r WHERE NOT displaced OR rank < 12""")
def diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    hits = _lexical(spark, d).join(_docs(spark, d).select("id", "source"), "id")
    return retrieval.diversity_cap(hits, "source", most=1, target=12).select("q_id", "id", "source", "score", "displaced", "rank")


@query(f"""WITH {BM25}, g AS (SELECT q_id, rank, score, greatest(round(score - lead(score) OVER (PARTITION BY q_id ORDER BY rank), 9), 0) AS gap FROM lex),
p AS (SELECT q_id, count(*) AS n, max(gap) AS top, sum(gap) AS total, max(CASE WHEN rank = 0 THEN abs(score) END) AS first FROM g GROUP BY q_id),
a AS (SELECT g.q_id, min(g.rank) AS at FROM g JOIN p ON g.q_id = p.q_id AND g.gap = p.top GROUP BY g.q_id),
c AS (SELECT p.q_id, CASE WHEN n >= 3 AND top > 0 AND top > 0.01 * first AND round(top - 3.0 * (total - top) / (n - 2), 9) > 0 THEN at + 1 END AS cliff_at FROM p LEFT JOIN a USING (q_id))
SELECT l.q_id, l.id, l.rank, l.score, coalesce(l.rank >= c.cliff_at, false) AS past_cliff FROM lex l LEFT JOIN c USING (q_id)""")
def cliff_flags(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.mark_past_cliff(_lexical(spark, d)).select("q_id", "id", "rank", "score", "past_cliff")


@query(f"""WITH {DENSE}, h AS (SELECT q_id, id, rank, (id % 11)::DOUBLE AS activation, id % 17 = 0 AS sitting FROM dense),
a AS (SELECT *, max(activation) OVER (PARTITION BY q_id) AS top, count(*) OVER (PARTITION BY q_id) AS n FROM h),
b AS (SELECT *, CASE WHEN sitting THEN greatest(CASE WHEN top > 0 THEN activation / top ELSE 0 END, 1) WHEN top > 0 THEN activation / top ELSE 0 END AS act FROM a),
l AS (SELECT *, lag(act, 1) OVER w AS p1, lag(act, 2) OVER w AS p2 FROM b WINDOW w AS (PARTITION BY q_id ORDER BY rank)),
c AS (SELECT *, CASE WHEN n < 3 OR rank < 2 OR NOT round(act - p1, 9) > 0.5 THEN 0 WHEN rank >= 3 AND round(act - p2, 9) > 0.5 THEN 2 ELSE 1 END AS climb FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank - climb, CASE WHEN climb > 0 THEN 0 ELSE 1 END, rank) - 1 AS new FROM c)
SELECT q_id, id, new AS rank, new < rank AS primed FROM o""")
def prime_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = dense_topk(spark, d).drop("score").withColumn("activation", (F.col("id") % 11).cast("double")).withColumn("sitting", F.col("id") % 17 == 0)
    return retrieval.prime(hits).select("q_id", "id", "rank", "primed")


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, value LIMIT 20")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.facets(_docs(spark, d), "lang")


@query(f"""WITH {DENSE}, r AS (
  SELECT q_id, 0 AS part, rank, id, 'ranked' AS kind, CASE WHEN q_id % 40 = 0 THEN 4 END AS cliff_at FROM dense
  UNION ALL
  SELECT q_id, 1, row_number() OVER (PARTITION BY q_id ORDER BY score, id) - 1, id, 'ranked', NULL FROM dense
), k AS (SELECT *, CASE WHEN rank < coalesce(cliff_at, 3) THEN 0 ELSE 1 END AS phase FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY phase, rank, part) AS n FROM k)
SELECT q_id, id, kind, row_number() OVER (PARTITION BY q_id ORDER BY phase, rank, part, id) - 1 AS rank FROM f WHERE n = 1""")
def merge_rounds(spark: SparkSession, d: str) -> DataFrame:
    one = dense_topk(spark, d)
    back = retrieval.ranked(one.drop("rank"), "score", "id")
    shape = lambda h, part, cut: h.select("q_id", F.lit(part).alias("part"), "rank", "id", F.lit("ranked").alias("kind"), cut.alias("cliff_at"))
    cut = F.when(F.col("q_id") % 40 == 0, 4)
    return retrieval.merge_rounds(shape(one, 0, cut).unionByName(shape(back, 1, F.lit(None).cast("int"))))


HEBB = """tops AS (SELECT l_orderkey, l_partkey FROM (
    SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 20),
sets AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS id FROM tops),
pairs AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS n_events FROM sets a JOIN sets b ON a.e = b.e AND a.id < b.id GROUP BY a.id, b.id)"""


TOGETHER = """sets AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS id FROM lineitem),
pairs AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS n_events FROM sets a JOIN sets b ON a.e = b.e AND a.id < b.id GROUP BY a.id, b.id)"""


@query(f"WITH {TOGETHER} SELECT a_id, b_id, n_events::DOUBLE AS weight, n_events FROM pairs")
def hebbian_links(spark: SparkSession, d: str) -> DataFrame:
    return logs.hebbian_links(_shown(spark, d))


def _first_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the first candidates of each event, as ``HEBB`` has them."""
    return logs.hebbian_links(_shown(spark, d), most=logs.CANDIDATES)


def _link_parts(spark: SparkSession, d: str) -> int:
    return parts_of(spark, _shown(spark, d).count())


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"))


@query(f"""WITH {HEBB}, hits AS (
  SELECT c_custkey AS q_id, p AS id, rank FROM (SELECT c_custkey, unnest([c_custkey, c_custkey + 1, c_custkey + 2, c_custkey + 3]) AS p, unnest([0, 1, 2, 3]) AS rank FROM customer WHERE c_custkey % 20 = 0)),
near AS (SELECT h.q_id, l.o AS id, max(round(l.w * power(2.0, -(864000) / (30 * 86400.0)), 6)) AS weight
  FROM hits h JOIN (SELECT a_id AS f, b_id AS o, n_events::DOUBLE AS w FROM pairs UNION ALL SELECT b_id, a_id, n_events FROM pairs) l ON l.f = h.id WHERE h.rank < 3 GROUP BY h.q_id, l.o),
ok AS (SELECT * FROM near n WHERE weight >= 0.5 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.q_id = n.q_id AND h.id = n.id))
SELECT * FROM (SELECT q_id, id, weight, row_number() OVER (PARTITION BY q_id ORDER BY weight DESC, id) - 1 AS place FROM ok) WHERE place < 3""")
def associated(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("q_id"))
    hits = asked.select("q_id", F.posexplode(F.array(*[F.col("q_id") + k for k in range(4)])).alias("rank", "id"))
    links = _first_links(spark, d).withColumn("bumped_at", F.lit(NOW - 864000))
    return retrieval.associated(hits, links, NOW, show_min=0.5).select("q_id", "id", "weight", "place")


@query(f"""WITH {BM25}, t AS (SELECT l.q_id, l.id, l.rank, (length(o.text) * 2 // 7)::BIGINT AS tokens FROM lex l JOIN documents o ON o.doc_id = l.id),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t)
SELECT * FROM u WHERE used <= 4000""")
def pack_by_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = _lexical(spark, d).drop("score").join(_docs(spark, d).select("id", tx.token_estimate(F.col("text")).alias("tokens")), "id")
    return retrieval.pack_by_budget(hits, "tokens", 4000).select("q_id", "id", "rank", "tokens", "used")


@query("""SELECT conv_id * 1000 + turn AS id, lag(conv_id * 1000 + turn) OVER w AS before, lead(conv_id * 1000 + turn) OVER w AS after
FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, conv_id * 1000 + turn)""")
def adjacent_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    status = F.when(F.col("role") == "system", "deprecated")
    return retrieval.adjacent(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("corpus_id"), F.col("turn").alias("ordinal"), status.alias("status")))


@query("""WITH p AS (SELECT *, CASE WHEN turn = lag(turn) OVER w + 1 THEN 0 ELSE 1 END AS b FROM conversations WHERE role <> 'system' AND turn % 5 <> 3
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT 0::BIGINT AS q_id, conv_id AS corpus_id, min(turn) AS start_line, max(turn) AS end_line, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, i""")
def stitch_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role <> 'system' and turn % 5 <> 3")
    hits = turns.select(F.lit(0).cast("long").alias("q_id"), F.col("conv_id").alias("corpus_id"), F.lit(0).alias("segment"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"), F.col("turn").alias("rank"), "text")
    return retrieval.stitch(hits).select("q_id", "corpus_id", "start_line", "end_line", "text")


# Text ---------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, (length(text) * 2 // 7)::BIGINT AS tokens, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 80) AS title,
  md5(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS normal_md5, sha256(text) AS content_hash FROM documents""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(t).alias("tokens"), tx.title(t).alias("title"), F.md5(tx.normal_query(t)).alias("normal_md5"), F.sha2(t, 256).alias("content_hash"))


@query(f"WITH {TOKENS} SELECT id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS top FROM post GROUP BY id")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_docs(spark, d).select("id", "text")).groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("top"))


@query(f"WITH {TOKENS} SELECT id, term, round(tf * 2.2 / (tf + 1.2), 6)::DOUBLE AS weight FROM post")
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_docs(spark, d).select("id", "text")).select("id", "term", F.round(tx.saturated(F.col("tf")), 6).alias("weight"))


SIGN = r"""w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sig AS (SELECT id, CASE WHEN len(w) = 0 THEN [] ELSE
  list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: md5(array_to_string(w[k:k + 4], ' ')))))[1:128] END AS s FROM w)"""


@query(f"WITH {SIGN} SELECT id, len(s)::BIGINT AS size, md5(array_to_string(s, ',')) AS signature_md5 FROM sig")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return dedup.signatures(_docs(spark, d)).select("id", F.size("sig").cast("long").alias("size"), F.md5(F.array_join("sig", ",")).alias("signature_md5"))


@query(f"""WITH RECURSIVE {SIGN}, h AS (SELECT id, unnest(s) AS x FROM sig),
cand AS (SELECT DISTINCT a.id AS i, b.id AS j FROM h a JOIN h b ON a.x = b.x AND a.id < b.id),
k AS (SELECT i, j, a.s AS sa, b.s AS sb, least(128, len(a.s), len(b.s)) AS k FROM cand JOIN sig a ON a.id = i JOIN sig b ON b.id = j),
e AS (SELECT i, j FROM k WHERE len(list_intersect(list_sort(list_distinct(list_concat(sa, sb)))[1:k], list_intersect(sa, sb))) / k >= 0.9),
r(id, c) AS (SELECT id, id FROM sig UNION SELECT e2.y, r.c FROM r JOIN (SELECT i AS x, j AS y FROM e UNION ALL SELECT j, i FROM e) e2 ON e2.x = r.id AND r.c < e2.y)
SELECT id, min(c) AS class_id FROM r GROUP BY id""")
def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates(_docs(spark, d).select("id", "text"))


@query("SELECT doc_id AS id, sha256(text) AS content_hash, min(doc_id) OVER w AS first_id, doc_id = min(doc_id) OVER w AS is_first, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY sha256(text))")
def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of_content(_docs(spark, d).select("id", "text"))


@query(r"""WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM pages WHERE regexp_matches(lower(url), '^https?://[^/]'))
SELECT page_id, url, text, length(text) AS n_chars FROM t WHERE length(text) >= 200""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return captured_pages(table(spark, d, "pages"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS w FROM documents),
b AS (SELECT doc_id, lower(regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '^[vV]([0-9])', '\1')) AS f FROM w)
SELECT DISTINCT doc_id, f AS fact FROM b WHERE regexp_matches(f, '^[0-9]+([-.:/_].*|(UNITS))$')""".replace("UNITS", "|".join(tx.UNITS)))
def fact_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(tx.fact_tokens(F.coalesce("text", F.lit("")))).alias("fact"))


@query(r"""WITH w AS (SELECT source, lower(x) AS w FROM (SELECT source, unnest(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+')) AS x FROM documents) WHERE strlen(x) > 2),
c AS (SELECT source, w, count(*) AS n FROM w WHERE w NOT IN (STOPS) GROUP BY source, w),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS k FROM c)
SELECT source, string_agg(w, ' · ' ORDER BY k) AS label FROM r WHERE k <= 3 GROUP BY source""".replace("STOPS", ", ".join(f"'{w}'" for w in tx.STOP_WORDS)))
def terms_label(spark: SparkSession, d: str) -> DataFrame:
    return metrics.terms_label(table(spark, d, "documents"), "source")


@query(r"""WITH l AS (SELECT doc_id, u.line, u.t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x, LATERAL (SELECT unnest(ls) AS t, generate_subscripts(ls, 1) AS line) u),
d AS (SELECT doc_id, line, list_distinct(list_filter(list_transform(regexp_extract_all(t, '[\p{L}\p{N}\-_./=]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda x: strlen(x) > 3)) AS k, trim(t, ' ' || chr(9) || chr(13)) = '' AS blank FROM l),
w AS (SELECT doc_id, (line - 1) // 4 AS idx, flatten(list(k)) AS k FROM d WHERE line % 2 = 1 GROUP BY doc_id, (line - 1) // 4),
c AS (SELECT d.doc_id, CASE WHEN w.idx IS NULL THEN false WHEN len(d.k) = 0 THEN true ELSE len(list_intersect(d.k, w.k)) >= 0.5 * len(d.k) END AS c FROM d LEFT JOIN w ON w.doc_id = d.doc_id AND w.idx = (d.line - 1) // 4 WHERE NOT d.blank)
SELECT doc_id, round(avg(c::INT), 6) AS coverage FROM c GROUP BY doc_id""")
def line_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each document by windows of four lines that keep every other line."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    own = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line"), tx.distinctive_tokens(F.col("t")).alias("tokens"), (F.btrim("t", F.lit(" \t\r")) == "").alias("blank"))
    idx = F.floor((F.col("line") - 1) / 4)
    windows = own.where("line % 2 = 1").groupBy("doc_id", idx.alias("idx")).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return joins.content_coverage(own, windows.withColumn("start_line", F.col("idx") * 4 + 1).withColumn("end_line", F.col("idx") * 4 + 4))


@query()
def segment_documents(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_documents(table(spark, d, "documents"), 384)


@query()
def passage_documents(spark: SparkSession, d: str) -> DataFrame:
    return segments.passage_documents(table(spark, d, "documents"), 1024, 128)


@query()
def document_literals(spark: SparkSession, d: str) -> DataFrame:
    """Of the pages' markup, where paths stand in attributes; the documents' prose has none."""
    return segments.document_literals(table(spark, d, "pages"), "page_id", "html")


# Logs ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT artifact_id AS id, round(sum(CASE kind WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 3.0 END * power(2.0, -greatest({NOW} - at, 0) / (14 * 86400.0))), 6) AS activation
FROM ev WHERE kind IN ('view', 'click', 'purchase') GROUP BY artifact_id""")
def activation_decay(spark: SparkSession, d: str) -> DataFrame:
    gain = F.when(F.col("kind") == "view", 1.0).when(F.col("kind") == "click", 0.5).otherwise(3.0)
    bumps = _events(spark, d).where("kind in ('view', 'click', 'purchase')").select(F.col("artifact_id").alias("id"), "at", gain.alias("gain"))
    return logs.activation(bumps, NOW)


@query(f"""WITH {EV}, s AS (SELECT *, CASE WHEN at - lag(at) OVER w > {IDLE} THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY scope ORDER BY at, id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY scope ORDER BY at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s)
SELECT scope, session, min(at) AS opened_at, max(at) AS last_at, count(*) AS n FROM n GROUP BY scope, session""")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return logs.sessions(_events(spark, d), IDLE).groupBy("scope", "session").agg(F.min("at").alias("opened_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, m AS (SELECT c.id, v.id AS right_id, v.at AS right_at, row_number() OVER (PARTITION BY c.id ORDER BY v.at DESC, v.id DESC) AS n
  FROM ev c JOIN ev v ON v.scope = c.scope AND v.kind = 'view' AND c.at - v.at BETWEEN 0 AND {IDLE} WHERE c.kind = 'click')
SELECT c.id, c.scope, m.right_id, m.right_at FROM ev c LEFT JOIN m ON m.id = c.id AND m.n = 1 WHERE c.kind = 'click'""")
def asof_attach(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).select("id", "at", "scope", "kind")
    return joins.asof_backward(ev.where("kind = 'click'").drop("kind"), ev.where("kind = 'view'").drop("kind"), "scope", IDLE).select("id", "scope", "right_id", "right_at")


@query(f"""WITH {EV}, m AS (SELECT c.id, v.id AS right_id, abs(v.at - c.at) AS distance, row_number() OVER (PARTITION BY c.id ORDER BY abs(v.at - c.at), v.id) AS n
  FROM ev c JOIN ev v ON v.scope = c.scope AND v.kind = 'signup' AND abs(v.at - c.at) <= {IDLE} WHERE c.kind = 'purchase')
SELECT c.id, m.right_id, m.distance FROM ev c LEFT JOIN m ON m.id = c.id AND m.n = 1 WHERE c.kind = 'purchase'""")
def nearest_context(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).select("id", "at", "scope", "kind")
    return joins.nearest(ev.where("kind = 'purchase'").drop("kind"), ev.where("kind = 'signup'").drop("kind"), "scope", IDLE).select("id", "right_id", "distance")


PURSUIT = f"""{EV}, s0 AS (SELECT *, CASE WHEN at - lag(at) OVER w > {IDLE} THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY scope ORDER BY at, id)),
s AS (SELECT *, scope * 1000000 + sum(new) OVER (PARTITION BY scope ORDER BY at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS need FROM s0),
sr0 AS (SELECT need, id AS event_id, at, CASE WHEN value > 90 THEN artifact_id END AS confirmed FROM s WHERE kind = 'view'),
sr AS (SELECT *, lead(event_id) OVER (PARTITION BY need ORDER BY at, event_id) IS NOT NULL AS followed FROM sr0),
act AS (SELECT x.need, x.id, x.at, x.artifact_id, x.kind, (SELECT max(v.event_id) FROM sr v WHERE v.need = x.need AND (v.at, v.event_id) <= (x.at, x.id) AND NOT EXISTS (SELECT 1 FROM sr u WHERE u.need = x.need AND (u.at, u.event_id) <= (x.at, x.id) AND (u.at, u.event_id) > (v.at, v.event_id))) AS event_id, x.value
  FROM s x WHERE x.kind IN ('click', 'purchase')),
a AS (SELECT *, lag(artifact_id) OVER (PARTITION BY need ORDER BY at, id) AS p, row_number() OVER (PARTITION BY need, artifact_id ORDER BY at, id) AS k FROM act WHERE event_id IS NOT NULL),
ba AS (SELECT need, sum(CASE WHEN kind = 'purchase' THEN 1.5 ELSE 1.0 END + CASE WHEN k > 1 AND p <> artifact_id THEN 2 ELSE 0 END) AS acted, count(*) FILTER (WHERE kind = 'purchase') AS pivots,
  count(*) FILTER (WHERE k > 1 AND p <> artifact_id) AS returns, bool_or(value / 100 >= 0.35) AS strong FROM a GROUP BY need),
ar AS (SELECT need, count(DISTINCT x) AS engaged FROM (SELECT need, artifact_id AS x FROM a UNION ALL SELECT need, confirmed FROM sr WHERE confirmed IS NOT NULL) GROUP BY need),
t AS (SELECT sr.*, confirmed IS NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.event_id = sr.event_id) AS empty FROM sr),
bs AS (SELECT need, count(*) AS n_searches, 3.0 * count(confirmed) AS cw, count(*) FILTER (WHERE empty AND followed) AS refined, bool_or(empty AND NOT followed) AS abandoned FROM t GROUP BY need),
f AS (SELECT bs.need, n_searches, refined, abandoned, coalesce(engaged, 0) AS engaged, coalesce(pivots, 0) AS pivots, coalesce(returns, 0) AS returns, coalesce(strong, false) OR cw > 0 AS strong_engaged,
  round(coalesce(acted, 0) + cw, 6)::DOUBLE AS engagement FROM bs LEFT JOIN ba USING (need) LEFT JOIN ar USING (need)),
u AS (SELECT *, NOT strong_engaged OR refined >= 2 OR abandoned AS unmet FROM f)"""


@query(f"""WITH {PURSUIT} SELECT need, n_searches, refined, abandoned, engaged, pivots, returns, strong_engaged, engagement,
  CASE WHEN engaged = 1 THEN 'promote' WHEN engaged < 2 THEN CASE WHEN unmet THEN 'unsatisfied' ELSE 'satisfied' END
       WHEN engagement >= 3 AND (unmet OR pivots + returns > 0) THEN 'generate' WHEN unmet THEN 'unsatisfied' ELSE 'satisfied' END AS decision FROM u""")
def pursuit_decision(spark: SparkSession, d: str) -> DataFrame:
    """Views are searches (confirmed above a value of 90), clicks openings, purchases pivots; a pause of six hours ends a need."""
    ev = logs.sessions(_events(spark, d), IDLE).withColumn("need", F.col("scope") * 1000000 + F.col("session"))
    no = F.lit(False)
    searches = ev.where("kind = 'view'").select("need", F.col("id").alias("event_id"), "at", no.alias("is_ask"), no.alias("answered"), no.alias("abstained"), F.when(F.col("value") > 90, F.col("artifact_id")).alias("confirmed"))
    w = Window.partitionBy("need").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "view", F.col("id")), ignorenulls=True).over(w)
    acts = ev.withColumn("event_id", last).where("kind in ('click', 'purchase')").select(
        "need", "event_id", "id", "artifact_id", F.when(F.col("kind") == "click", "opened").otherwise("pivoted").alias("kind"), "at", F.lit(0.0).alias("seconds"), (F.col("value") / 100).alias("similarity"), F.lit(True).alias("shown")
    )
    features = logs.need_features(acts, searches)
    return features.select("need", "n_searches", "refined", "abandoned", "engaged", "pivots", "returns", "strong_engaged", "engagement", logs.decide().alias("decision"))


@query(f"""WITH {EV}, s AS (SELECT *, CASE WHEN at - lag(at) OVER w <= 86400 AND (starts_with(scope::VARCHAR || kind, lag(scope::VARCHAR || kind) OVER w)) THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY scope ORDER BY at, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY scope ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS run FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY scope, run ORDER BY at DESC, id DESC) AS n FROM r)
SELECT id, scope, at, kind AS query FROM l WHERE n = 1""")
def coalesced_queries(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).select("id", F.lit("ui").alias("door"), "scope", "at", F.col("kind").alias("query"), F.lit(1).alias("pool"))
    return logs.coalesce_queries(ev, 86400).select("id", "scope", "at", "query")


@query(f"""WITH {EV}, s0 AS (SELECT *, CASE WHEN at - lag(at) OVER w > {IDLE} THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY scope ORDER BY at, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY scope ORDER BY at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s0),
l AS (SELECT scope, session, artifact_id, max((at, id)) AS t FROM s GROUP BY scope, session, artifact_id),
r AS (SELECT scope, session, artifact_id, row_number() OVER (PARTITION BY scope, session ORDER BY t DESC) - 1 AS place FROM l)
SELECT * FROM r WHERE place < 20""")
def sitting_memory(spark: SparkSession, d: str) -> DataFrame:
    return logs.sittings(logs.sessions(_events(spark, d), IDLE))


POINTS = f"""{EV}, p AS (SELECT artifact_id AS id, min(at) AS created_at, max(at) AS last_seen_at, max(CASE WHEN kind = 'purchase' THEN at END) AS verified_at, count(*) FILTER (WHERE kind = 'click') AS hit_count FROM ev GROUP BY artifact_id)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.col("kind") == k
    return _events(spark, d).groupBy(F.col("artifact_id").alias("id")).agg(
        F.min("at").alias("created_at"), F.max("at").alias("last_seen_at"), F.max(F.when(kind("purchase"), F.col("at"))).alias("verified_at"), F.count_if(kind("click")).alias("hit_count"), F.lit(None).cast("string").alias("status")
    )


@query(f"WITH {POINTS} SELECT id, verified_at, hit_count FROM p WHERE verified_at < {NOW - 3 * 86400} AND hit_count <= 30")
def stale_candidates(spark: SparkSession, d: str) -> DataFrame:
    return logs.stale(_points(spark, d), NOW - 3 * 86400, 30).select("id", "verified_at", "hit_count")


@query(f"WITH {POINTS} SELECT id, created_at, last_seen_at FROM p WHERE created_at < {NOW - 20 * 86400} AND last_seen_at < {NOW - 2 * 86400}")
def forgotten(spark: SparkSession, d: str) -> DataFrame:
    return logs.forgotten(_points(spark, d), NOW - 20 * 86400, NOW - 2 * 86400).select("id", "created_at", "last_seen_at")


@query(f"WITH {EV} SELECT id, kind, at FROM ev WHERE kind = 'purchase' OR at >= {NOW} - CASE kind WHEN 'view' THEN 10 WHEN 'click' THEN 20 ELSE 400 END * 86400")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(_events(spark, d), NOW, {"view": 10, "click": 20, "purchase": 0}).select("id", "kind", "at")


@query(f"""WITH {TOGETHER} SELECT a_id, b_id, round(n_events * power(2.0, -((a_id % 90) * 86400) / (30 * 86400.0)), 6) AS weight FROM pairs
WHERE n_events * power(2.0, -((a_id % 90) * 86400) / (30 * 86400.0)) >= 0.5""")
def pruned_links(spark: SparkSession, d: str) -> DataFrame:
    links = hebbian_links(spark, d).withColumn("bumped_at", NOW - (F.col("a_id") % 90) * 86400).withColumn("state", F.lit(None).cast("string"))
    left = logs.prune_links(links, NOW)
    return left.select("a_id", "b_id", F.round(tx.decayed(F.col("weight"), F.col("bumped_at"), NOW, 30), 6).alias("weight"))


# Graphs, sets and lifecycle -------------------------------------------------------------------------------------


def label_sql(edges: str, rounds: int = 12) -> str:
    """CTE ``lab`` (node, c): the smallest node that each reaches within so many steps; more than any path of these tables needs."""
    return f"""ed AS (SELECT u, v FROM ({edges}) UNION SELECT v, u FROM ({edges}) UNION SELECT u, u FROM ({edges}) UNION SELECT v, v FROM ({edges})),
step(k, node, c) AS (SELECT 0, u, min(v) FROM ed GROUP BY u UNION ALL SELECT k + 1, ed.v, min(c) FROM step JOIN ed ON ed.u = step.node WHERE k < {rounds} GROUP BY k, ed.v), lab AS (SELECT node, c FROM step WHERE k = {rounds})"""


@query(f"""WITH RECURSIVE {label_sql("SELECT o_custkey AS u, l_suppkey + 1000000 AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey")} SELECT node, c AS component FROM lab""")
def components(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v"))
    return connected_components(edges)


@query(f"""WITH RECURSIVE {label_sql("SELECT l_partkey AS u, l_suppkey + 1000000 AS v FROM lineitem")}, b AS (SELECT c, max((node % 97, node)) AS k FROM lab GROUP BY c)
SELECT node AS id, k[2] AS keeper_id, node <> k[2] AS superseded FROM lab JOIN b USING (c)""")
def keepers(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a_id"), (F.col("l_suppkey") + 1000000).alias("b_id"))
    art = pairs.select(F.col("a_id").alias("id")).union(pairs.select("b_id")).distinct().withColumn("created_at", F.col("id") % 97)
    return dedup.keepers(pairs, art)


@query("""WITH RECURSIVE s AS (SELECT DISTINCT p_partkey AS child_id, p_partkey // 2 AS root_id FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 5 = 0),
r(root, node, parent, depth) AS (SELECT p_partkey, p_partkey, NULL::BIGINT, 0 FROM part WHERE p_partkey % 20 = 0
  UNION SELECT r.root, s.root_id, r.node, r.depth + 1 FROM r JOIN s ON s.child_id = r.node WHERE r.depth < 6),
f AS (SELECT root, node, depth, min(parent) AS parent FROM r GROUP BY root, node, depth), g AS (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth) AS n FROM f)
SELECT root, node, parent, depth FROM g WHERE n = 1""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("child_id"))
    half = part.select("child_id", F.floor(F.col("child_id") / 2).alias("root_id"))
    third = part.where("child_id % 5 = 0").select("child_id", F.floor(F.col("child_id") / 3).alias("root_id"))
    return dedup.lineage(half.union(third).distinct(), part.where("child_id % 20 = 0").select(F.col("child_id").alias("id")))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS m FROM lineitem), n AS (SELECT id, count(*) AS n FROM s GROUP BY id)
SELECT left_id, right_id FROM (SELECT a.id AS left_id, b.id AS right_id, count(*) AS k FROM s a JOIN s b ON a.m = b.m AND a.id <> b.id GROUP BY a.id, b.id) JOIN n ON n.id = right_id WHERE k = n.n""")
def set_containment(spark: SparkSession, d: str) -> DataFrame:
    """Orders of whose parts another order has all."""
    sets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("member"))
    return joins.set_containment(sets, sets)


@query("""SELECT o_custkey AS corpus_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE - DATE '1970-01-01', o_orderkey) - 1 AS ordinal FROM orders""")
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "orders").select(F.col("o_custkey").alias("corpus_id"), F.col("o_orderkey").alias("id"), F.lit(None).cast("int").alias("segment_idx"), F.expr("datediff(o_orderdate, date'1970-01-01')").alias("ordinal"))
    return lifecycle.renumbered(art).select("corpus_id", "id", "ordinal")


ART = "art AS (SELECT p_partkey AS id, p_size AS corpus_id, CASE WHEN p_partkey % 13 = 0 THEN 'superseded' WHEN p_partkey % 11 = 0 THEN 'deprecated' END AS status, CASE WHEN p_partkey % 13 = 0 THEN p_partkey * 3 END AS superseded_by FROM part)"


def _art(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    status = F.when(key % 13 == 0, "superseded").when(key % 11 == 0, "deprecated")
    return table(spark, d, "part").select(key.alias("id"), F.col("p_size").alias("corpus_id"), status.alias("status"), F.when(key % 13 == 0, key * 3).alias("superseded_by"))


@query(f"""WITH {ART}, c AS (SELECT id, id + 1 AS winner_id FROM art WHERE id % 10 = 1),
v AS (SELECT c.* FROM c JOIN art w ON w.id = c.winner_id AND coalesce(w.status, 'active') = 'active' AND w.superseded_by IS NULL)
SELECT a.id, CASE WHEN v.id IS NOT NULL AND coalesce(a.status, 'active') = 'active' AND a.superseded_by IS NULL THEN 'superseded' ELSE a.status END AS status,
  CASE WHEN v.id IS NOT NULL AND coalesce(a.status, 'active') = 'active' AND a.superseded_by IS NULL THEN v.winner_id ELSE a.superseded_by END AS superseded_by FROM art a LEFT JOIN v ON v.id = a.id""")
def superseded(spark: SparkSession, d: str) -> DataFrame:
    art = _art(spark, d)
    return lifecycle.supersede(art, art.where("id % 10 = 1").select("id", (F.col("id") + 1).alias("winner_id"))).select("id", "status", "superseded_by")


@query(f"""WITH {ART}, k AS (SELECT a.*, superseded_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM art b WHERE b.id = a.superseded_by AND b.corpus_id % 5 <> 0) AS lost FROM art a WHERE corpus_id % 5 <> 0)
SELECT id, CASE WHEN lost THEN 'active' ELSE status END AS status, CASE WHEN NOT lost THEN superseded_by END AS superseded_by FROM k""")
def deleted_and_healed(spark: SparkSession, d: str) -> DataFrame:
    art = _art(spark, d)
    return lifecycle.without_corpora(art, art.where("corpus_id % 5 = 0").select(F.col("corpus_id").alias("id")).distinct()).select("id", "status", "superseded_by")


@query("""SELECT coalesce(n.p_partkey, o.p_partkey) AS id, coalesce(CASE WHEN n.p_partkey % 3 <> 0 THEN 'new' END, o.p_name) AS title
FROM (SELECT * FROM part WHERE p_partkey % 2 = 0) o FULL JOIN (SELECT * FROM part WHERE p_partkey % 5 = 0) n ON n.p_partkey = o.p_partkey""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    new = part.where("id % 5 = 0").select("id", F.when(F.col("id") % 3 != 0, F.lit("new")).alias("title"))
    return lifecycle.upsert(part.where("id % 2 = 0"), new)


@query(f"""WITH {HEBB}, m AS (SELECT CASE WHEN a_id % 10 = 7 THEN a_id - 7 ELSE a_id END AS x, CASE WHEN b_id % 10 = 7 THEN b_id - 7 ELSE b_id END AS y, round(n_events * power(2.0, -864000 / (30 * 86400.0)), 6) AS w, CASE WHEN a_id % 9 = 0 THEN 'dismissed' ELSE 'learning' END AS s FROM pairs)
SELECT least(x, y) AS a_id, greatest(x, y) AS b_id, max(w) AS weight, min(s) AS state FROM m WHERE x <> y GROUP BY 1, 2""")
def carried_links(spark: SparkSession, d: str) -> DataFrame:
    links = _first_links(spark, d).withColumn("bumped_at", F.lit(NOW - 864000)).withColumn("state", F.when(F.col("a_id") % 9 == 0, "dismissed").otherwise("learning"))
    moved = table(spark, d, "part").where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") - 7).alias("new_id"))
    return lifecycle.carry_links(links, moved, NOW, parts=_link_parts(spark, d))


# Evaluation, gaps and offers ------------------------------------------------------------------------------------


@query(f"""WITH {BM25}, r AS (SELECT q.item_id, min(l.rank) AS rank FROM benchmark q LEFT JOIN (SELECT l.* FROM lex l JOIN documents d ON d.doc_id = l.id WHERE d.lang = 'en') l ON l.q_id = q.item_id GROUP BY q.item_id)
SELECT count(*) AS n, round(avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(coalesce(1.0 / (rank + 1), 0)), 6) AS mrr FROM r""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    english = _lexical(spark, d).join(_docs(spark, d).where("lang = 'en'").select("id"), "id", "left_semi")
    first = english.groupBy("q_id").agg(F.min("rank").alias("rank"))
    return metrics.retrieval_metrics(_items(spark, d).join(first, "q_id", "left"))


LOG = """e AS (SELECT o_orderkey AS event_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'hit' WHEN '2-HIGH' THEN 'gap' WHEN '3-MEDIUM' THEN 'discard' END AS verdict, o_orderkey % 50 AS expected FROM orders),
c AS (SELECT l_orderkey AS event_id, l_partkey % 50 AS id, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2)"""


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("o_orderpriority")
    verdict = F.when(p == "1-URGENT", "hit").when(p == "2-HIGH", "gap").when(p == "3-MEDIUM", "discard")
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), verdict.alias("verdict"), (F.col("o_orderkey") % 50).alias("expected"))
    shown = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") % 50).alias("id")).agg(F.min("l_linenumber").alias("rank"))
    return events, shown


@query(f"""WITH {LOG} SELECT count(*) AS captured, count(*) FILTER (WHERE verdict IS NULL) AS pending, count(*) FILTER (WHERE verdict = 'hit') AS hits, count(*) FILTER (WHERE verdict = 'gap') AS gaps, count(*) FILTER (WHERE verdict = 'discard') AS discards,
  count(*) FILTER (WHERE verdict = 'hit' AND rank IS NOT NULL) AS finds, round(coalesce(avg(CASE WHEN verdict = 'hit' THEN CASE WHEN rank < 10 THEN 1.0 ELSE 0.0 END END), 0), 6) AS recall_at_k,
  round(coalesce(avg(CASE WHEN verdict = 'hit' THEN coalesce(1.0 / (rank + 1), 0) END), 0), 6) AS mrr FROM e LEFT JOIN c ON c.event_id = e.event_id AND c.id = e.expected""")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.feedback_stats(*_log(spark, d))


@query(f"WITH {LOG} SELECT e.event_id, e.verdict, c.rank FROM e LEFT JOIN c ON c.event_id = e.event_id AND c.id = e.expected WHERE verdict = 'hit' AND (rank IS NULL OR rank >= 2)")
def judged_misses(spark: SparkSession, d: str) -> DataFrame:
    return metrics.misses(*_log(spark, d), k=2)


@query("""SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS rightly, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS made_up, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS held_back, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS answered FROM labels""")
def confusion_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.abstention_table(table(spark, d, "labels").select((F.col("toxic") == 1).alias("should_abstain"), (F.col("quality") == 0).alias("abstained")))


@query(r"""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, starts_with(lower(regexp_replace(text, '^[\s*_#>`\-+•·"]*', '')), 'not in the knowledge base') AS abstained,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda n: n::BIGINT), lambda n: n BETWEEN 1 AND 8)))::BIGINT AS n_cited FROM a""")
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "conversations").where("role = 'assistant'")
    return answers.select("conv_id", "turn", tx.abstained(F.col("text")).alias("abstained"), F.size(tx.citations(F.col("text"), F.lit(8))).cast("long").alias("n_cited"))


@query("""SELECT conv_id, turn, text AS question, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations QUALIFY role = 'user'""")
def ask_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("answer", F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(w))
    return turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer", "role")


@query("""SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS rung, count(*) FILTER (WHERE event_type = 'view') AS shown, count(*) FILTER (WHERE event_type = 'click') AS opened FROM events GROUP BY 1""")
def offer_rates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "recommended_shown").when(F.col("event_type") == "click", "recommended_open")
    detail = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("rung")))
    return metrics.offer_rates(table(spark, d, "events").select(kind.alias("kind"), detail.alias("detail")))


@query(f"""WITH {EV}, g AS (SELECT kind, id, artifact_id::VARCHAR AS text, at FROM ev WHERE kind IN ('error', 'signup')), o AS (SELECT * FROM g WHERE id % 7 <> 0)
SELECT * FROM (SELECT kind, id, text, at, row_number() OVER (PARTITION BY kind ORDER BY at DESC, id DESC) - 1 AS place FROM o) WHERE place < 500""")
def open_gaps_union(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).withColumn("text", F.col("artifact_id").cast("string"))
    covered = ev.where("id % 7 = 0").select("kind", "id")
    return metrics.open_gaps({k: ev.where(F.col("kind") == k) for k in ("error", "signup")}, covered)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS s FROM v a JOIN v b ON a.vec_id < b.vec_id),
r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM c)
SELECT least(greatest(ceil(round(s * 100, 4)) / 100, 0.55), 0.90)::DOUBLE AS threshold FROM r WHERE k = floor((n - 1) * 0.99 + 0.5)""")
def link_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Over all pairs of the table."""
    return metrics.link_threshold(_corpus(spark, d).select("id", "vector"))


def _situations(spark: SparkSession, d: str) -> DataFrame:
    bundle = context.parsed(F.to_json(F.struct(F.lit(1440.0).alias("viewport_w"), F.lit(900.0).alias("viewport_h"), F.when(F.col("id") % 3 == 0, "wifi").alias("network"), F.when(F.col("id") % 2 == 0, "dark").otherwise("light").alias("color_scheme"))))
    return _events(spark, d).withColumn("vector", context.encode(F.col("at"), F.col("scope").cast("string"), bundle))


@query(f"""WITH {EV}, t AS (SELECT id, make_timestamp(at * 1000000) AS t FROM ev)
SELECT id, round(sin(2 * pi() * (hour(t) + minute(t) / 60.0 + second(t) / 3600.0) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * (hour(t) + minute(t) / 60.0 + second(t) / 3600.0) / 24), 6) + 0.0 AS hour_cos,
  (isodow(t) - 1)::BIGINT AS weekday, CASE WHEN isodow(t) >= 6 THEN 0.3 ELSE 0.0 END::DOUBLE AS weekend, 53::BIGINT AS size FROM t""")
def context_encoding(spark: SparkSession, d: str) -> DataFrame:
    v = lambda k: F.element_at("vector", k)
    day = F.array_position(F.slice("vector", 11, 7), F.lit(1.0)) - 1
    return _situations(spark, d).select("id", (F.round(v(9), 6) + 0.0).alias("hour_sin"), (F.round(v(10), 6) + 0.0).alias("hour_cos"), day.alias("weekday"), F.round(v(19), 6).alias("weekend"), F.size("vector").cast("long").alias("size"))


@query()
def context_profiles(spark: SparkSession, d: str) -> DataFrame:
    clicks = _situations(spark, d).where("kind = 'click'")
    weighted = clicks.select("artifact_id", "scope", "id", "at", tx.decayed(F.lit(1.0), F.col("at"), NOW, 45).alias("weight"), "vector")
    return context.profiles(weighted, least=0.0)


@query()
def context_offers(spark: SparkSession, d: str) -> DataFrame:
    now = _situations(spark, d).where("kind = 'view' and id % 20 = 0").select(F.col("id").alias("now_id"), "scope", "vector")
    return context.offers(now, context_profiles(spark, d))


@query("""WITH l AS (SELECT doc_id, u.line, trim(u.t, ' ' || chr(9) || chr(13)) = '' AS blank FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x, LATERAL (SELECT unnest(ls) AS t, generate_subscripts(ls, 1) AS line) u),
sp AS (SELECT DISTINCT doc_id, doc_id % 3 + k AS id, k * 2 + 1 AS s, k * 2 + 1 + doc_id % 4 AS e FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k)),
h AS (SELECT l.doc_id, l.line, l.blank, coalesce(string_agg(DISTINCT sp.id::VARCHAR, ',' ORDER BY sp.id::VARCHAR), '') AS own FROM l LEFT JOIN sp ON sp.doc_id = l.doc_id AND l.line BETWEEN sp.s AND sp.e GROUP BY l.doc_id, l.line, l.blank),
n AS (SELECT doc_id, line, coalesce(last_value(CASE WHEN NOT blank THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), own) AS ids FROM h),
t AS (SELECT *, CASE WHEN ids = lag(ids) OVER (PARTITION BY doc_id ORDER BY line) THEN 0 ELSE 1 END AS turn FROM n),
b AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS band FROM t)
SELECT doc_id, band, min(line) AS first, max(line) AS last, ids FROM b GROUP BY doc_id, band, ids""")
def coverage_bands(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), (F.btrim("t", F.lit(" \t\r")) == "").alias("blank"))
    k = docs.select("doc_id", F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("k"))
    spans = k.select("doc_id", (F.col("doc_id") % 3 + F.col("k")).cast("string").alias("id"), (F.col("k") * 2 + 1).alias("start_line"), (F.col("k") * 2 + 1 + F.col("doc_id") % 4).alias("end_line"))
    return reads.bands(lines, spans)


@query("SELECT count(*) AS asked, count(*) FILTER (WHERE l_tax = 0) AS abstained, count(*) FILTER (WHERE l_returnflag = 'N') AS pending, count(*) FILTER (WHERE l_returnflag = 'A') AS right, count(*) FILTER (WHERE l_returnflag = 'R') AS wrong, 0::BIGINT AS nothing_here FROM lineitem".replace(" right,", ' "right",'))
def ask_stats(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "A", "right").when(F.col("l_returnflag") == "R", "wrong")
    return reads.ask_stats(table(spark, d, "lineitem").select((F.col("l_tax") == 0).alias("abstained"), verdict.alias("verdict")))


@query("SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS at")
def newest_event(spark: SparkSession, d: str) -> DataFrame:
    return reads.newest_event(table(spark, d, "orders").select(F.col("o_orderdate").alias("at")), table(spark, d, "lineitem").select(F.col("l_shipdate").alias("at")))


@query("""SELECT o_custkey AS scope, o_orderkey AS id, o_orderdate AS at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5""")
def newest_per_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return reads.newest_per_group(rows, "scope", 5)


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4),
r(id, node) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.node), c AS (SELECT id, min(node) AS c FROM r GROUP BY id)
SELECT sha256(string_agg(id, ',' ORDER BY id)) AS key, count(*) AS n FROM c GROUP BY c""")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    gaps = _corpus(spark, d).select("id", F.lit("the open gap").alias("text"), "vector")
    return reads.gap_clusters(gaps, 0.4).select("key", "n")


@query(f"""WITH s AS (SELECT a.vec_id AS q_id, b.vec_id AS id, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) <= 5)
SELECT DISTINCT least(q_id, id) AS a_id, greatest(q_id, id) AS b_id, score FROM n""")
def neighbours_of_all(spark: SparkSession, d: str) -> DataFrame:
    """All rows against all."""
    corpus = _corpus(spark, d).select("id", "vector")
    return retrieval.neighbour_pairs(corpus, corpus.withColumnRenamed("id", "q_id"), 5, 0.2)


@query("""WITH s AS (SELECT g.vec_id AS gap_id, a.vec_id AS id, round(list_cosine_similarity(g.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings g, embeddings a WHERE g.vec_id % 20 = 0 AND a.vec_id % 20 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, id) AS n FROM s WHERE score >= 0.35) SELECT gap_id, id, score FROM r WHERE n = 1""")
def covered_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = _corpus(spark, d)
    return reads.covered_gaps(rows.where("id % 20 = 0"), rows.where("id % 20 <> 0"))


@query("""SELECT l_orderkey AS event_id, l_linenumber::BIGINT AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey || '|' || l_linenumber), l_linenumber) - 1 AS place FROM lineitem""")
def judging_order(spark: SparkSession, d: str) -> DataFrame:
    return reads.judging_order(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("long").alias("id")))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS text, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS embed_rev, CASE WHEN p_partkey % 4 = 0 THEN 'pending' WHEN p_partkey % 3 = 0 THEN 'done' ELSE 'failed' END AS embed_state FROM part""")
def edited_artifacts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit("t").alias("title"), F.lit(1).alias("embed_rev"), F.lit("failed").alias("embed_state"))
    edits = part.where("id % 4 = 0").select("id", F.upper("text").alias("text"), F.lit(None).cast("string").alias("title"))
    done = part.where("id % 3 = 0").select("id", F.lit(1).alias("rev"))
    return reads.embedded(reads.edited(part, edits), done).select("id", "text", "embed_rev", "embed_state")


# Plain relational work -------------------------------------------------------------------------------------------


def _sql(name: str, text: str, *tables: str) -> None:
    """The same text in both engines, over views of its own."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = text
        for t in tables:
            out = out.replace(f"{{{t}}}", f"parquet.`{d}/{t}.parquet`")
        return spark.sql(out)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = text.replace("{", "").replace("}", "")


_sql("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", "lineitem")
_sql("nation_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name""", "customer", "orders", "lineitem", "nation")
_sql("orders_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_sql("parts_rollup", "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY ROLLUP (p_brand, p_size)", "part")
_sql("customers_without_orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", "customer", "orders")
_sql("set_operations", """SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier})
UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier})""", "customer", "supplier")
_sql("top_orders", """SELECT o_custkey, o_orderkey, o_totalprice, r FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) t WHERE r <= 3""", "orders")
_sql("status_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean FROM {events} GROUP BY event_type", "events")
