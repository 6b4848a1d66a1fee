"""Queries over the driver's tables: each operator on data that exercises it, beside the DuckDB SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.functions import html as H
from quillstone.functions import structured as S
from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators import chunking, constraints, evaluation, graph, relational, retrieval, temporal
from quillstone.plans.registry import query
from quillstone.streaming import queue, windows

WORDS = ("with", "this", "from")
VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]
_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
_TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_LEXICAL = f"""
  SELECT doc_id, {" + ".join(f"tf{i} / (tf{i} + 1.0)" for i in range(len(WORDS)))} AS score
  FROM (SELECT doc_id, {", ".join(f"len(list_filter(l, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(WORDS))} FROM (SELECT doc_id, {_TOKENS} AS l FROM documents))
  WHERE {" + ".join(f"tf{i}" for i in range(len(WORDS)))} > 0"""
_VECTOR = f"SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_VEC}) AS score FROM embeddings"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(column: str = "text"):
    return F.filter(F.split(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "), " "), lambda x: x != "")


# ---------------------------------------------------------------- retrieval


@query("lexical_topk", f"SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM ({_LEXICAL}) ORDER BY score DESC, doc_id LIMIT 40")
def lexical_topk(spark, d):
    return retrieval.lexical_top_k(read(spark, d, "documents"), "doc_id", tokens(), WORDS).withColumn("score", F.round("score", 6))


@query(
    "lexical_bm25",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS l FROM documents),
c AS (SELECT doc_id, len(l) AS n, {", ".join(f"len(list_filter(l, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(WORDS))} FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(WORDS)))} FROM c),
r AS (SELECT doc_id, {" + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(WORDS)))} AS score FROM c, s WHERE {" + ".join(f"tf{i}" for i in range(len(WORDS)))} > 0)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY score DESC, doc_id LIMIT 40""",
)
def lexical_bm25(spark, d):
    return retrieval.lexical_top_k(read(spark, d, "documents"), "doc_id", tokens(), WORDS, mode="bm25").select("doc_id", F.round("score", 6).alias("score"))


@query("vector_topk", f"SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM ({_VECTOR}) ORDER BY score DESC, vec_id LIMIT 40")
def vector_topk(spark, d):
    return retrieval.vector_top_k(read(spark, d, "embeddings"), "vec_id", "embedding", VECTOR).withColumn("score", F.round("score", 6))


_RRF = f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_LEXICAL}) ORDER BY score DESC, doc_id LIMIT 40),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_VECTOR}) ORDER BY score DESC, vec_id LIMIT 40)
SELECT id, a.r::INT AS rank_0, b.r::INT AS rank_1, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS rrf_score FROM a FULL JOIN b USING (id)"""


def _fused(spark, d):
    lex = retrieval.lexical_top_k(read(spark, d, "documents"), "doc_id", tokens(), WORDS).withColumnRenamed("doc_id", "id")
    vec = retrieval.vector_top_k(read(spark, d, "embeddings"), "vec_id", "embedding", VECTOR).withColumnRenamed("vec_id", "id")
    return retrieval.fuse([lex, vec], ["id"])


@query("rrf_fusion", _RRF)
def rrf_fusion(spark, d):
    return _fused(spark, d).withColumn("rrf_score", F.round("rrf_score", 9))


@query("rrf_incomplete_gate", f"SELECT coalesce(max(rrf_score) < 0.005, true) AS incomplete FROM ({_RRF})")
def rrf_incomplete_gate(spark, d):
    return retrieval.search_is_incomplete(_fused(spark, d))


@query(
    "hybrid_with_status_join",
    f"SELECT doc_id, round(score, 6) AS score FROM ({_LEXICAL}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic <> 1) ORDER BY score DESC, doc_id LIMIT 40",
)
def hybrid_with_status_join(spark, d):
    status = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "superseded").otherwise("current").alias("status"))
    alive = retrieval.without_superseded(read(spark, d, "documents"), status, "doc_id", "id")
    return retrieval.lexical_top_k(alive, "doc_id", tokens(), WORDS).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "occurrence_topk",
    """SELECT doc_id, (len(regexp_extract_all(lower(text), '(^|[^a-z0-9])(wh)')) )::DOUBLE AS score FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 6""",
)
def occurrence_topk(spark, d):
    return retrieval.occurrence_top_k(read(spark, d, "documents"), "doc_id", "text", ["wh"]).select("doc_id", "score")


@query(
    "gold_pool_ranks",
    """WITH pool AS (SELECT conv_id AS case_id, 'lexical' AS arm, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations
UNION ALL SELECT conv_id, 'vector', turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) FROM conversations WHERE role = 'user'),
gold AS (SELECT DISTINCT conv_id AS case_id, 2::BIGINT AS id FROM conversations)
SELECT case_id, id, min(rank) FILTER (arm = 'lexical')::INT AS rank_lexical, min(rank) FILTER (arm = 'vector')::INT AS rank_vector, count(rank) > 0 AS in_pool
FROM gold LEFT JOIN pool USING (case_id, id) GROUP BY case_id, id""",
)
def gold_pool_ranks(spark, d):
    c = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id")
    lex = c.select(F.col("conv_id").alias("case_id"), F.lit("lexical").alias("arm"), F.col("turn").alias("id"), F.row_number().over(w.orderBy(F.length("text").desc(), "turn")).alias("rank"))
    vec = c.where("role = 'user'").select(F.col("conv_id").alias("case_id"), F.lit("vector").alias("arm"), F.col("turn").alias("id"), F.row_number().over(w.orderBy(F.col("turn").desc())).alias("rank"))
    gold = c.select(F.col("conv_id").alias("case_id"), F.lit(2).cast("long").alias("id")).distinct()
    return retrieval.gold_ranks(gold, lex.unionByName(vec), ["id"])


# ---------------------------------------------------------------- joins


@query(
    "asof_last_purchase",
    """SELECT event_id, user_id, ts, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS paid FROM events""",
)
def asof_last_purchase(spark, d):
    e = read(spark, d, "events")
    versions = e.where("event_type = 'purchase'").select("user_id", F.struct("ts", "event_id").alias("since"), F.round("value", 6).alias("paid"))
    left = e.select("event_id", "user_id", "ts", F.struct("ts", "event_id").alias("at"))
    return relational.as_of_join(left, versions, "user_id", "at", "since").select("event_id", "user_id", "ts", "paid")


@query(
    "asof_order_at_date",
    """WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate FROM v WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND (e IS NULL OR TIMESTAMP '1998-01-01' < e)""",
)
def asof_order_at_date(spark, d):
    o = read(spark, d, "orders")
    v = relational.neighbour(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderdate", "until")
    return relational.as_of_rows(v, "o_custkey", F.lit("1998-01-01").cast("timestamp"), "o_orderdate", "until").select("o_custkey", "o_orderkey", "o_orderdate")


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi(read(spark, d, "customer"), big, "c_custkey").select("c_custkey", "c_name")


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.anti(read(spark, d, "customer"), big, "c_custkey").select("c_custkey", "c_name")


@query(
    "prepend_anchors",
    """WITH a AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
SELECT o_orderkey, 0 AS part FROM a UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)""",
)
def prepend_anchors(spark, d):
    o = read(spark, d, "orders")
    return relational.prepend(o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select("o_orderkey"), o.select("o_orderkey"), "o_orderkey")


@query("follow_reference", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')")
def follow_reference(spark, d):
    recent = read(spark, d, "orders").where("o_orderdate >= '2001-06-01'")
    return relational.follow_reference(recent, read(spark, d, "customer"), "o_custkey", "c_custkey").select("c_custkey", "c_nationkey")


@query(
    "nested_join",
    "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def nested_join(spark, d):
    r = read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return relational.nested_join(read(spark, d, "nation"), r, "n_regionkey", "region").select("n_nationkey", "n_name", F.col("region.r_name").alias("r_name"))


@query(
    "lookup_floor",
    "SELECT o_orderkey, (SELECT max(y) FROM (VALUES (1995), (1997), (2000)) t(y) WHERE y <= year(o_orderdate))::INT AS edition FROM orders",
)
def lookup_floor(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    editions = spark.createDataFrame([(1995,), (1997,), (2000,)], "edition int").select(F.col("edition").alias("o"), F.col("edition"))
    return relational.lookup_floor(o, editions, "y", "o", "edition").select("o_orderkey", "edition")


_OWNERS = [("https_any", "https://", 9), ("doc", "regex:/(doc|docs|page)", 2), ("digits", "regex:[0-9]+$", 1), ("http_any", "http://", 9)]


@query(
    "owner_by_pattern",
    """SELECT page_id, url, CASE WHEN regexp_matches(url, '[0-9]+$') THEN 'digits' WHEN regexp_matches(url, '/(doc|docs|page)') THEN 'doc' WHEN starts_with(url, 'http://') THEN 'http_any' WHEN starts_with(url, 'https://') THEN 'https_any' END AS source_id FROM pages""",
)
def owner_by_pattern(spark, d):
    return relational.first_owner(read(spark, d, "pages").select("page_id", "url"), spark.createDataFrame(_OWNERS, "source_id string, pattern string, priority int"))


@query(
    "remap_references",
    "SELECT o_orderkey, coalesce(m.keep, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keep FROM customer) m ON m.c_custkey = o_custkey",
)
def remap_references(spark, d):
    c = relational.keeper(read(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", F.col("c_custkey"))
    return relational.remap(read(spark, d, "orders").select("o_orderkey", "o_custkey"), c.select(F.col("c_custkey").alias("old"), F.col("keeper_id").alias("new")), "o_custkey")


@query(
    "unique_best_partner",
    """WITH r AS (SELECT l_orderkey, l_partkey, l_quantity, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS k FROM lineitem)
SELECT l_orderkey, l_partkey, l_quantity FROM r WHERE k = 1 AND l_orderkey IN (SELECT l_orderkey FROM r WHERE k = 1 GROUP BY 1 HAVING count(*) = 1)""",
)
def unique_best_partner(spark, d):
    pairs = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return relational.unique_best(pairs, "l_orderkey", "l_quantity", "l_partkey")


@query(
    "recursive_ancestors",
    """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS n, 'n' || c_nationkey AS p FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
t(start, node_id, distance) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT start, p, distance + 1 FROM t JOIN e ON node_id = n)
SELECT start, node_id, distance FROM t""",
)
def recursive_ancestors(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = c.select(key("c", "c_custkey").alias("node_id"), key("n", "c_nationkey").alias("parent_id")).unionByName(n.select(key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id")))
    return graph.ancestors(nodes, c.where("c_acctbal > 9000").select(key("c", "c_custkey").alias("node_id")))


@query(
    "crawl_levels",
    """SELECT 'r' || r_regionkey AS url, 0 AS depth FROM region WHERE r_regionkey < 2
UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey < 2
UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2""",
)
def crawl_levels(spark, d):
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    links = read(spark, d, "nation").select(key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target")).unionByName(read(spark, d, "supplier").select(key("n", "s_nationkey").alias("source"), key("s", "s_suppkey").alias("target")))
    visited, _ = graph.crawl(links, read(spark, d, "region").where("r_regionkey < 2").select(key("r", "r_regionkey").alias("url")), 5)
    return visited


@query(
    "tree_preorder",
    """SELECT id, depth, row_number() OVER (ORDER BY a, b)::INT AS place FROM (SELECT 'r' || r_regionkey AS id, 0 AS depth, r_regionkey AS a, -1 AS b FROM region UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey, n_nationkey FROM nation)""",
)
def tree_preorder(spark, d):
    r = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("position"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_nationkey").alias("position"))
    return graph.preorder(r.unionByName(n)).select(F.col("node_id").alias("id"), "depth", "place")


# ---------------------------------------------------------------- aggregates and windows


@query("dedup_keep_latest", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_keep_latest(spark, d):
    return relational.latest(read(spark, d, "orders"), "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_orderdate")


@query("content_hash_dups", "SELECT md5(text) AS hash, count(*) AS n, count(*) - 1 AS excess FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return relational.duplicate_groups(read(spark, d, "documents").select(F.md5("text").alias("hash")), "hash")


@query(
    "keeper_rows",
    "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keeper_id FROM documents",
)
def keeper_rows(spark, d):
    df = read(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("hash"))
    return relational.keeper(df, "hash", "doc_id", F.col("n_chars"), F.col("doc_id")).select("doc_id", "keeper_id")


@query("anchors_distinct_key_topn", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def anchors_distinct_key_topn(spark, d):
    return relational.distinct_top(read(spark, d, "orders"), "o_custkey", 10, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("top_per_key", "SELECT o_custkey, o_orderkey, row_number() OVER w::INT AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank <= 3")
def top_per_key(spark, d):
    return relational.top_per_key(read(spark, d, "orders"), "o_custkey", 3, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query(
    "corroborated_value",
    """WITH c AS (SELECT l_partkey, l_discount, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT l_partkey, max(n) AS documents, count(*) AS "values", min(l_discount) AS lo, max(l_discount) AS hi, arg_max(l_discount, n) AS v, list_sort(list(n), 'DESC') AS c FROM c GROUP BY 1)
SELECT l_partkey, CASE WHEN "values" > 1 AND (c[1] = c[2] OR (lo > 0 AND hi / lo > 1.5)) THEN NULL ELSE v END AS l_discount, documents, "values" FROM p""",
)
def corroborated_value(spark, d):
    return relational.corroborated(read(spark, d, "lineitem"), "l_partkey", "l_discount", "l_suppkey")


@query("value_agreement", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) <= 1)")
def value_agreement(spark, d):
    return relational.agreed(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "mode_min_tie",
    "SELECT l_partkey, l_quantity AS quantity FROM (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_quantity) = 1",
)
def mode_min_tie(spark, d):
    return relational.mode_smallest(read(spark, d, "lineitem"), "l_partkey", "l_quantity", "quantity")


@query("conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS last_order FROM orders GROUP BY 1")
def conditional_counts(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.countDistinct("o_custkey").alias("customers"), F.max("o_orderdate").alias("last_order"))


@query(
    "conversation_context",
    """SELECT conv_id, turn, role, lag(text) OVER w AS before, lead(role) OVER w AS next_role, row_number() OVER w::INT AS sequence FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def conversation_context(spark, d):
    c = read(spark, d, "conversations")
    order = [F.col("turn")]
    out = relational.neighbour(relational.neighbour(c, "conv_id", order, "text", "before", -1), "conv_id", order, "role", "next_role")
    return out.select("conv_id", "turn", "role", "before", "next_role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("sequence"))


@query("page_texts", "SELECT conv_id, turn // 4 AS page_no, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY ALL")
def page_texts(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 4).cast("long").alias("page_no"), F.col("turn").alias("reading_order_index"), "text")
    return relational.page_texts(c, "conv_id")


@query(
    "overlap_flags",
    """SELECT l_orderkey, l_linenumber, coalesce(l_partkey <= lag(l_partkey + 50) OVER w, false) AS overlap_prev, coalesce(lead(l_partkey) OVER w <= l_partkey + 50, false) AS overlap_next
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_partkey + 50, l_linenumber)""",
)
def overlap_flags(spark, d):
    li = read(spark, d, "lineitem").withColumn("e", F.col("l_partkey") + 50)
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "e", "l_linenumber")
    return li.select("l_orderkey", "l_linenumber", F.coalesce(F.col("l_partkey") <= F.lag("e").over(w), F.lit(False)).alias("overlap_prev"), F.coalesce(F.lead("l_partkey").over(w) <= F.col("e"), F.lit(False)).alias("overlap_next"))


@query("set_operations", "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def set_operations(spark, d):
    both = relational.distinct_union(read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return relational.anti(both, read(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")), "k")


@query("merged_intervals", "SELECT l_orderkey, count(*) AS stretches, sum(e - s)::BIGINT AS covered FROM (SELECT l_orderkey, g, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM (SELECT l_orderkey, l_linenumber, l_partkey AS s, l_partkey + 100 AS e FROM lineitem))) GROUP BY ALL) GROUP BY 1")
def merged_intervals(spark, d):
    spans = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + 100).alias("end"))).alias("spans"))
    m = spans.select("l_orderkey", S.merged_intervals(F.col("spans")).alias("m"))
    return m.select("l_orderkey", F.size("m").cast("long").alias("stretches"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("covered"))


@query("ordered_collect", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_collect(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(S.ordered_collect(F.col("turn"), F.col("role")), ">").alias("roles"))


# ---------------------------------------------------------------- versions


@query(
    "scd2_from_orders",
    """WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders QUALIFY lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS DISTINCT FROM o_orderstatus)
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, lead(o_orderdate) OVER w AS superseded_date, lead(o_orderdate) OVER w IS NULL AS is_current FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def scd2_from_orders(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return temporal.history(o, "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")


@query(
    "hard_version_filter",
    """SELECT o_orderkey, o_custkey, bool_or(o_orderstatus <> 'O') OVER w AND bool_or(o_orderstatus = 'O') OVER w AS has_history FROM orders WINDOW w AS (PARTITION BY o_custkey)
QUALIFY o_orderstatus = 'O' OR NOT bool_or(o_orderstatus = 'O') OVER w""",
)
def hard_version_filter(spark, d):
    o = read(spark, d, "orders").withColumn("is_current", F.col("o_orderstatus") == "O")
    return temporal.hard_version_filter(o, [], "o_custkey").select("o_orderkey", "o_custkey", "has_history")


@query("removed_nodes", "SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'O') AND bool_or(o_orderstatus <> 'O')")
def removed_nodes(spark, d):
    return temporal.removed_nodes(read(spark, d, "orders").withColumn("is_current", F.col("o_orderstatus") == "O"), "o_custkey")


@query("superseded_from_peer", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN max(o_orderdate) FILTER (o_orderstatus = 'O') OVER (PARTITION BY o_custkey) END AS superseded_date FROM orders")
def superseded_from_peer(spark, d):
    o = read(spark, d, "orders").withColumn("is_current", F.col("o_orderstatus") == "O")
    return temporal.superseded_date_from_peer(o, "o_custkey", date_col="o_orderdate").select("o_orderkey", "superseded_date")


@query("exists_stale", "SELECT o_orderkey FROM orders a WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate)")
def exists_stale(spark, d):
    o = read(spark, d, "orders").withColumn("is_current", F.col("o_orderstatus") == "O")
    return temporal.stale_current(o, "o_custkey", date_col="o_orderdate").select("o_orderkey")


@query(
    "history_repair",
    """WITH k AS (SELECT doc_id, source, md5(text) AS h, first_value(doc_id) OVER (PARTITION BY source, md5(text) ORDER BY n_chars, doc_id) AS keep, n_chars FROM documents),
r AS (SELECT * FROM k WHERE doc_id = keep)
SELECT doc_id, source, n_chars, lead(n_chars) OVER w AS superseded_date, lead(doc_id) OVER w IS NULL AS is_current FROM r WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)""",
)
def history_repair(spark, d):
    df = read(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("h"), F.lit(True).alias("is_current"))
    fixed, _ = temporal.repair_history(df, "source", "h", "doc_id", "n_chars")
    return fixed.select("doc_id", "source", "n_chars", "superseded_date", "is_current")


@query(
    "history_repair_counts",
    """WITH g AS (SELECT source, md5(text) AS h, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1)
SELECT (SELECT count(*) FROM g) AS groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS rows, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM g) AS excess,
(SELECT count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) FILTER (lang = 'es') = 0)) AS without_current, (SELECT count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) FILTER (lang = 'es') > 1)) AS many_current""",
)
def history_repair_counts(spark, d):
    df = read(spark, d, "documents").select("source", F.md5("text").alias("h"), (F.col("lang") == "es").alias("is_current"))
    return temporal.repair_counts(df, "source", "h")


@query(
    "scd2_upsert",
    """WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
i AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
j AS (SELECT i.*, t.o_orderstatus AS s FROM i LEFT JOIN t USING (o_custkey))
SELECT t.o_custkey, t.o_orderstatus, t.o_orderdate, j.o_orderdate AS superseded_date, j.o_orderdate IS NULL AS is_current FROM t LEFT JOIN j ON j.o_custkey = t.o_custkey AND j.o_orderstatus <> t.o_orderstatus
UNION ALL SELECT o_custkey, o_orderstatus, o_orderdate, NULL, true FROM j WHERE s IS NULL OR s <> o_orderstatus""",
)
def scd2_upsert(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    old = relational.latest(o.where("o_orderdate < '1999-01-01'"), "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).drop("o_orderkey").withColumn("superseded_date", F.lit(None).cast("timestamp")).withColumn("is_current", F.lit(True))
    new = relational.latest(o.where("o_orderdate >= '1999-01-01'"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")).drop("o_orderkey")
    kept = old.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return temporal.upsert_versions(kept, new, "o_custkey", "o_orderstatus", "o_orderdate").select("o_custkey", "o_orderstatus", "o_orderdate", "superseded_date", "is_current")


# ---------------------------------------------------------------- writes as rewrites


@query("upsert_rows", "SELECT c_custkey, round(CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END, 4) AS c_acctbal FROM customer")
def upsert_rows(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    fresh = c.where("c_nationkey = 3").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    return relational.upsert(c, fresh, "c_custkey").select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("insert_if_absent", "SELECT c_custkey, c_nationkey >= 5 AS fresh FROM customer")
def insert_if_absent(spark, d):
    c = read(spark, d, "customer")
    return relational.insert_if_absent(c.where("c_nationkey < 5").select("c_custkey", F.lit(False).alias("fresh")), c.select("c_custkey", F.lit(True).alias("fresh")), "c_custkey")


@query("update_from_join", "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_mktsegment END AS c_mktsegment, n_regionkey = 1 AND n_name IS DISTINCT FROM c_mktsegment AS changed FROM customer JOIN nation ON c_nationkey = n_nationkey")
def update_from_join(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    src = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    return relational.update_from(c, src, "c_nationkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "changed")


@query("cascading_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def cascading_delete(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    _, left = relational.delete_with_children(c, c.where("c_nationkey = 7"), "c_custkey", {"orders": (o, "o_custkey")})
    return left["orders"].select("o_orderkey")


@query("retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS")
def retention(spark, d):
    return relational.retain(read(spark, d, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 24).select("event_id")


@query("constraint_report", """SELECT * FROM (VALUES ('orders.customer exists', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))), ('orders.status is known', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))), ('customer.balance is positive', (SELECT count(*) FROM customer WHERE NOT c_acctbal > 0)), ('documents.text is unique', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)))) t(rule, violations)""")
def constraint_report(spark, d):
    o, c, x = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "documents")
    return constraints.report(**{"orders.customer exists": constraints.dangling(o, "o_custkey", c, "c_custkey"), "orders.status is known": constraints.not_in(o, "o_orderstatus", ("O", "F")), "customer.balance is positive": constraints.breaking(c, F.col("c_acctbal") > 0), "documents.text is unique": constraints.repeated(x, "text")})


# ---------------------------------------------------------------- text, dates, JSON, HTML


@query("normalized_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents""")
def normalized_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalized_text(F.col("text"))).alias("digest"))


@query("query_terms", r"""SELECT doc_id, len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND x NOT IN ('a','an','and','are','at','county','current','currently','different','for','in','is','it','latest','now','of','rate','the','this','today','value','was','what','whats','year') AND NOT regexp_full_match(x, '(19|20)[0-9]{2}'))))::INT AS terms FROM documents""")
def query_terms(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.query_terms(F.col("text"))).alias("terms"))


@query("token_estimate", r"""SELECT doc_id, ceil(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) * 1.3)::INT AS tokens FROM documents""")
def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("sentence_count", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{2,}'), lambda x: trim(x, E' \t\n\r\x0b\x0c') <> ''))::INT AS sentences FROM documents""")
def sentence_count(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(
    "jaccard_near_dups",
    """WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS a FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS b FROM benchmark),
x AS (SELECT doc_id, len(a) AS na, unnest(a) AS w FROM t), y AS (SELECT item_id, len(b) AS nb, unnest(b) AS w FROM b),
p AS (SELECT doc_id, item_id, na, nb, count(*) AS n FROM x JOIN y USING (w) GROUP BY ALL)
SELECT doc_id, item_id, round(n / (na + nb - n), 9) AS similarity FROM p""",
)
def jaccard_near_dups(spark, d):
    """Every document with every item that shares a content token with it; all other pairs have similarity 0 and no row."""
    a, b = (read(spark, d, t).select(F.col(i).alias("id"), T.content_tokens(F.col("text")).alias("tokens")) for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    both = relational.shared_tokens(a, b)
    return both.select(F.col("left").alias("doc_id"), F.col("right").alias("item_id"), F.round(F.col("n") / (F.col("n_left") + F.col("n_right") - F.col("n")), 9).alias("similarity"))


@query("snippets", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS snippet FROM documents")
def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), 100).alias("snippet"))


@query("hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("html_strip", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(H.strip_html(F.col("html"))).alias("digest"))


@query("link_extract", r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)(?:#[^"'']*)?["'']', 1)) AS href FROM pages""")
def link_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "date_functions",
    """SELECT o_orderkey, (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END)::INT AS fiscal_year, date_trunc('minute', o_orderdate)::TIMESTAMP AS minute, make_date(year(o_orderdate) - 1, 7, 1) AS effective, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS day, CASE WHEN o_orderkey % 5 + 1 >= 3 THEN 30 WHEN o_orderkey % 5 + 1 = 2 THEN 5 ELSE 1 END::INT AS wait FROM orders""",
)
def date_functions(spark, d):
    o = read(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", D.fiscal_year(day).cast("int").alias("fiscal_year"), D.minute_floor(F.col("o_orderdate")).alias("minute"), D.effective_date_from_stage(F.lit("adopted"), F.year("o_orderdate")).alias("effective"), D.day_number(day).alias("day"), D.backoff_minutes((F.col("o_orderkey") % 5 + 1).cast("int")).alias("wait"))


@query("cosine_pairs", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_VEC}), 6) AS distance FROM embeddings")
def cosine_pairs(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.array(*[F.lit(x) for x in VECTOR])), 6).alias("distance"))


@query("chunk_documents")
def chunk_documents(spark, d):
    return chunking.chunk_texts(read(spark, d, "documents")).select("doc_id", "chunk_index", "token_count", "sentence_start", "sentence_end", "overlap_prev", "overlap_next")


@query(
    "page_ranges",
    "SELECT user_id, unnest(range(1, n + 1, 3)) AS first_page, least(first_page + 2, n) AS last_page FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)",
)
def page_ranges(spark, d):
    n = read(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return chunking.page_ranges(n, "user_id", "n").select("user_id", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"))


# ---------------------------------------------------------------- streams and queues


@query("tumbling_rate", "SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS requests FROM events GROUP BY ALL")
def tumbling_rate(spark, d):
    return windows.minute_counts(read(spark, d, "events"), "user_id")


@query("rate_exceeded", "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS requests, count(*) - 4 AS rejected FROM events GROUP BY ALL HAVING count(*) > 4")
def rate_exceeded(spark, d):
    return windows.over_limit(windows.minute_counts(read(spark, d, "events"), "user_id", minutes=1440), 4)


@query("rate_admitted", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id)::INT AS place, place <= 1 AS admitted FROM events")
def rate_admitted(spark, d):
    return windows.admitted(read(spark, d, "events"), "user_id", limit=1).select("event_id", "place", "admitted")


@query(
    "sliding_counts",
    """SELECT user_id, w AS window_start, w + INTERVAL 12 HOURS AS window_end, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS w FROM events) GROUP BY ALL""",
)
def sliding_counts(spark, d):
    return windows.sliding_counts(read(spark, d, "events"), "user_id", "ts", "12 hours", "6 hours")


@query(
    "session_windows",
    """SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g""",
)
def session_windows(spark, d):
    return windows.sessions(read(spark, d, "events"), "user_id", "ts", "3 hours")


@query(
    "cooldown_dedup",
    """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
t AS (SELECT user_id, event_type, event_id, r, ts AS last, true AS hit FROM n WHERE r = 1
UNION ALL SELECT n.user_id, n.event_type, n.event_id, n.r, CASE WHEN n.ts - t.last >= INTERVAL 6 HOURS THEN n.ts ELSE t.last END, n.ts - t.last >= INTERVAL 6 HOURS FROM t JOIN n ON n.user_id = t.user_id AND n.event_type = t.event_type AND n.r = t.r + 1)
SELECT event_id, user_id, event_type FROM t WHERE hit""",
)
def cooldown_dedup(spark, d):
    return windows.cooldown(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("alert_occurrences", "SELECT user_id, event_type, count(*) AS occurrence_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY ALL")
def alert_occurrences(spark, d):
    return windows.occurrences(read(spark, d, "events"), ["user_id", "event_type"])


@query("freshness_max", "SELECT event_type, max(ts) AS fresh FROM events GROUP BY 1")
def freshness_max(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("fresh"))


@query("staleness_sweep", "SELECT user_id AS alert_key FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY")
def staleness_sweep(spark, d):
    docs = read(spark, d, "events").groupBy(F.col("user_id").alias("url")).agg(F.max("ts").alias("last_checked_at")).withColumn("status", F.lit("current"))
    return queue.stale_documents(docs, F.lit("2024-01-30").cast("timestamp"), 1).select("alert_key")


_QUEUE = "SELECT event_id AS id, ts AS detected_at, CASE WHEN event_type = 'error' THEN 'pending' ELSE 'done' END AS status, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 40 DAYS END AS next_attempt_at FROM events"


def _queue(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("detected_at"), F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"), F.when(F.col("user_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))


@query("queue_claim", f"WITH q AS ({_QUEUE}), c AS (SELECT id FROM q WHERE status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-02-01') ORDER BY detected_at, id LIMIT 100) SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'processing' ELSE status END AS status FROM q")
def queue_claim(spark, d):
    table, _ = queue.claim(_queue(spark, d), F.lit("2024-02-01").cast("timestamp"), 100)
    return table.select("id", "status")


@query("queue_settle", "SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN 'done' WHEN user_id % 2 = 0 THEN 'pending' ELSE 'done' END AS status, (event_type = 'error' AND user_id % 2 = 0)::INT AS attempts FROM events")
def queue_settle(spark, d):
    q = _queue(spark, d).withColumn("status", F.when(F.col("status") == "pending", "processing").otherwise(F.col("status")))
    out = read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "failed").otherwise("done").alias("outcome"), F.lit("x").alias("error"))
    return queue.settle(q, out, F.lit("2024-02-01").cast("timestamp")).select("id", "status", "attempts")


@query("queue_watchdog", "SELECT event_id::VARCHAR AS alert_key, ts AS stuck_since FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 10 MINUTES")
def queue_watchdog(spark, d):
    q = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "processing").otherwise("done").alias("status"), F.col("ts").alias("started_at"))
    _, alerts = queue.watchdog(q, F.lit("2024-01-15").cast("timestamp"))
    return alerts.select("alert_key", "stuck_since")


# ---------------------------------------------------------------- evaluation

_RESULTS = "SELECT doc_id AS case_id, lang AS category, quality = 1 AS expects_answer, CASE WHEN quality IS NULL THEN 'skipped' WHEN doc_id % 50 = 0 THEN 'error' WHEN toxic = 0 THEN 'pass' ELSE 'fail' END AS status, doc_id % 7 = 0 AS refused FROM documents LEFT JOIN labels USING (doc_id)"


def _results(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "skipped").when(F.col("doc_id") % 50 == 0, "error").when(F.col("toxic") == 0, "pass").otherwise("fail")
    return j.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("expects_answer"), status.alias("status"), (F.col("doc_id") % 7 == 0).alias("refused"))


@query(
    "summary_metrics",
    f"""WITH r AS ({_RESULTS}), c AS (SELECT count(*) AS total, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errored, count(*) FILTER (status IN ('pass', 'fail')) AS ran, count(*) FILTER (status = 'pass') AS passed,
count(*) FILTER (status IN ('pass', 'fail') AND NOT refused) AS asserted, count(*) FILTER (status = 'pass' AND NOT refused) AS correct, count(*) FILTER (status IN ('pass', 'fail') AND NOT refused AND NOT expects_answer) AS false_assertions,
count(*) FILTER (status IN ('pass', 'fail') AND expects_answer) AS expected, count(*) FILTER (status IN ('pass', 'fail') AND expects_answer AND NOT refused) AS answered FROM r)
SELECT *, floor(100.0 * passed / nullif(ran, 0) + 0.5)::BIGINT AS overall_pct, floor(100.0 * correct / nullif(asserted, 0) + 0.5)::BIGINT AS correctness_pct, floor(100.0 * answered / nullif(expected, 0) + 0.5)::BIGINT AS availability_pct FROM c""",
)
def summary_metrics(spark, d):
    return evaluation.summary(_results(spark, d))


@query("category_rollup", f"SELECT category, count(*) AS ran, count(*) FILTER (status = 'pass') AS passed, floor(100.0 * count(*) FILTER (status = 'pass') / count(*) + 0.5)::BIGINT AS pct FROM ({_RESULTS}) WHERE status IN ('pass', 'fail') GROUP BY ROLLUP (category)")
def category_rollup(spark, d):
    return evaluation.by_category(_results(spark, d))
