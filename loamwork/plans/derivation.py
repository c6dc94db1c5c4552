"""Queries of work derived from sources, with DuckDB SQL for the same rows. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import derived
from loamwork.operators.dealing import parts_of
from loamwork.plans.registry import query
from loamwork.sources.capture import table

_SOURCES = """src AS (SELECT DISTINCT l_partkey AS child_id, -l_suppkey AS root_id FROM lineitem UNION SELECT p_partkey, p_partkey // k FROM part, (SELECT unnest([2, 3]) AS k) WHERE p_partkey % 5 < 2 AND p_partkey // k > 0)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Parts were written from the suppliers of their lines, whose ids are negative, and some from two smaller parts as well."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("child_id"), (-F.col("l_suppkey")).alias("root_id"))
    part = table(spark, d, "part").where("p_partkey % 5 < 2").select(F.col("p_partkey").alias("child_id"), F.explode(F.array(F.lit(2), F.lit(3))).alias("k"))
    return lines.union(part.select("child_id", F.floor(F.col("child_id") / F.col("k"))).where("floor(child_id / k) > 0")).distinct()


@query(f"""WITH RECURSIVE {_SOURCES}, roots AS (SELECT -s_suppkey AS id FROM supplier WHERE s_suppkey % 4 < 3),
gone(id) AS (SELECT id FROM roots UNION SELECT child_id FROM src JOIN gone ON root_id = id),
back(id) AS (SELECT child_id FROM src WHERE child_id IN (SELECT id FROM gone) AND root_id NOT IN (SELECT id FROM gone) UNION SELECT child_id FROM src JOIN back ON root_id = id WHERE child_id IN (SELECT id FROM gone))
SELECT id, CASE WHEN id IN (SELECT id FROM back) AND id NOT IN (SELECT id FROM roots) THEN 'rederive' ELSE 'forgotten' END AS fate FROM gone""")
def undone_work(spark: SparkSession, d: str) -> DataFrame:
    """Three of four suppliers go."""
    roots = table(spark, d, "supplier").where("s_suppkey % 4 < 3").select((-F.col("s_suppkey")).alias("id"))
    return derived.fates(_sources(spark, d), roots)


def _tree_sql(most: int, depth: int) -> str:
    levels = ["""WITH src AS (SELECT 'n' || c_nationkey AS child_id, 'l' || l_orderkey || '-' || l_linenumber AS root_id, 'c' || c_custkey AS via FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'c' || o_custkey, 'l' || l_orderkey || '-' || l_linenumber, 'o' || o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber, NULL FROM lineitem),
k AS (SELECT DISTINCT child_id, coalesce(via, root_id) AS node, (via IS NOT NULL)::INT AS via FROM src),
s0 AS (SELECT id AS root, id AS node, NULL::VARCHAR AS parent, 0 AS depth, 0::BIGINT AS place, 1 AS via, false AS cut FROM (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 20 = 0)), t0 AS (SELECT * FROM s0)"""]
    for d in range(1, depth + 2):
        levels.append(f"""m{d} AS (SELECT f.root, k.node, k.child_id AS parent, f.place AS above, k.via FROM t{d - 1} f JOIN k ON k.child_id = f.node WHERE f.via = 1 AND NOT f.cut AND NOT EXISTS (SELECT 1 FROM s{d - 1} s WHERE s.root = f.root AND s.node = k.node AND k.via = 1)),
t{d} AS (SELECT root, node, parent, {d} AS depth, place, via, place > {most} OR {d} > {depth} AS cut FROM (SELECT o.root, node, parent, via, used + row_number() OVER (PARTITION BY o.root ORDER BY above, via, node) - 1 AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY root, node, via, CASE WHEN via = 0 THEN parent END ORDER BY above) AS n FROM m{d}) o JOIN (SELECT root, max(place) + 1 AS used FROM s{d - 1} GROUP BY root) u ON u.root = o.root WHERE n = 1) WHERE place <= {most + 1}),
s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM t{d})""")
    last = f"s{depth + 1}"
    return ",\n".join(levels) + f"\nSELECT root, node, parent, depth, place, bool_or(cut) OVER (PARTITION BY root) AS truncated FROM {last} QUALIFY NOT cut AND depth > 0"


@query(_tree_sql(200, 6).replace("QUALIFY NOT cut AND depth > 0", "").replace("SELECT root, node, parent, depth, place, bool_or", "SELECT root, node, parent, depth, place, truncated FROM (SELECT *, bool_or") + ") WHERE NOT cut AND depth > 0")
def lineage_trees(spark: SparkSession, d: str) -> DataFrame:
    """Nations are written from lines through customers, and these through orders; a nation has thousands of nodes."""
    line, orders, customer = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    root = F.concat(name("l", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string"))
    few, parts = parts_of(spark, orders.count()), parts_of(spark, 3 * line.count())
    placed = orders.select("o_orderkey", "o_custkey").repartition(few, "o_custkey").join(customer.select("c_custkey", "c_nationkey").repartition(few, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    # dealt while rows are two numbers: a scan's task has as many lines as its file split
    line = line.select("l_orderkey", "l_linenumber").repartition(parts, "l_orderkey")
    owned = line.join(placed.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    far = owned.where("c_custkey is not null").select(name("n", "c_nationkey").alias("child_id"), root.alias("root_id"), name("c", "c_custkey").alias("via"))
    sources = far.union(owned.select(name("c", "o_custkey"), root, name("o", "o_orderkey"))).union(line.select(name("o", "l_orderkey"), root, F.lit(None).cast("string")))
    roots = table(spark, d, "nation").select(name("n", "n_nationkey").alias("id")).union(customer.where("c_custkey % 20 = 0").select(name("c", "c_custkey")))
    return derived.lineage_tree(sources, roots, parts=parts)


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, k AS part, CASE WHEN l_linenumber % 3 = 0 THEN 'part ' || k END AS text FROM lineitem, (SELECT unnest(range(3)) AS k) WHERE l_linenumber % 3 = 0 OR (l_quantity < 10 AND k = 0)),
m AS (SELECT l_orderkey AS list_id, l_linenumber AS at, r.id, p.part, CASE WHEN p.id IS NOT NULL THEN r.id END AS origin, CASE WHEN p.id IS NULL THEN l_returnflag ELSE p.text END AS text
  FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem) r LEFT JOIN p ON p.id = r.id WHERE p.id IS NULL OR p.text IS NOT NULL)
SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY at, id, part, text) - 1 AS ordinal, id, part, origin, text FROM m""")
def spliced_lists(spark: SparkSession, d: str) -> DataFrame:
    """Orders are lists of lines; every third line was cut into three parts, and others of small quantities went."""
    line = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    three = line.where("l_linenumber % 3 = 0").select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("part")).withColumn("text", F.concat(F.lit("part "), F.col("part").cast("string")))
    gone = line.where("l_linenumber % 3 <> 0 and l_quantity < 10").select("id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("text"))
    return derived.spliced(line.select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("ordinal"), "id", F.col("l_returnflag").alias("text")), three.union(gone))


@query("""WITH r AS (SELECT doc_id AS id, lang AS corpus_id, CASE WHEN floor(length(coalesce(text, '')) * 2 / 7) > 384 THEN 'split' ELSE 'batch' END AS route FROM documents)
SELECT id, corpus_id, route, CASE WHEN route = 'batch' THEN (row_number() OVER (PARTITION BY corpus_id, route ORDER BY id) - 1) // 32 END AS batch FROM r""")
def embed_routes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus_id"), F.col("doc_id").alias("ordinal"), "text")
    return derived.embed_routes(docs, 384)


def _cut_sql(budget: int, end: bool) -> str:
    lines = r"string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n')"
    lines = f"list_reverse({lines})" if end else lines
    most = max(16, budget * 7 // 2)
    n = f"len(list_filter(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) * 2 // 7 + 1)) <= {budget}))"
    kept, cut = ("list_reverse(l[1:n])", f"right(text, {most})") if end else ("l[1:n]", f"left(text, {most})")
    return f"(SELECT doc_id, idx, CASE WHEN text = '' THEN NULL WHEN n > 0 THEN array_to_string({kept}, chr(10)) ELSE {cut} END AS cut FROM (SELECT *, {n} AS n FROM (SELECT *, {lines} AS l FROM w)))"


@query(rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), w AS (SELECT doc_id, idx, array_to_string(l[idx * 6 + 1 : idx * 6 + 6], chr(10)) AS text FROM (SELECT doc_id, l, unnest(range((len(l) - 1) // 6 + 1)) AS idx FROM d)),
o AS {_cut_sql(60, False)}, h AS {_cut_sql(25, False)}, e AS {_cut_sql(25, True)}
SELECT w.doc_id, w.idx, CASE WHEN w.idx > 0 THEN o.cut END AS opening, e.cut AS before, h.cut AS after FROM w
LEFT JOIN o ON o.doc_id = w.doc_id AND o.idx = 0 LEFT JOIN e ON e.doc_id = w.doc_id AND e.idx = w.idx - 1 LEFT JOIN h ON h.doc_id = w.doc_id AND h.idx = w.idx + 1""")
def window_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Windows are six lines of a document each."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    each = docs.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 6).cast("int"))).alias("k"))
    windows = each.select("doc_id", F.col("k").cast("long").alias("idx"), F.array_join(F.slice("l", F.col("k") * 6 + 1, F.lit(6)), "\n").alias("text"))
    return derived.window_context(windows, 60, 25)
