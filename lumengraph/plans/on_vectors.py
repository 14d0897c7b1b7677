"""Vector search and identifiers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, vector
from ..operators import lexical, search
from ..session import Store
from ..sources import tables
from .base import query


def nodes(spark, sf_dir):
    """A node a vector; importance and time from the id and label."""
    v = tables.table(spark, sf_dir, "embeddings")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return v.select(
        F.col("vec_id").alias("id"), ((F.col("vec_id") % 10) / 10.0).alias("impact"), (start + F.make_dt_interval(days=F.col("label"))).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.when(F.col("vec_id") % 5 == 0, F.array(F.lit("MASTER"))).otherwise(F.array(F.lit("Note"))).alias("labels"), F.lit("en").alias("lang"),
    )


def first_vector(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def hits(df):
    return df.select("id", F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"))


def hybrid(k: int, alpha: float, where: str = "true", q: str = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)", pre: str = "true") -> str:
    return f"""WITH n AS (SELECT vec_id AS id, (vec_id % 10) / CAST(10 AS DOUBLE) AS impact, label, list_distance(CAST(embedding AS DOUBLE[]), {q}) AS dist FROM embeddings WHERE {pre}),
    near AS (FROM n ORDER BY dist, id LIMIT {2 * k}), s AS (SELECT id, dist, (1 - dist) * (1 - CAST({alpha} AS DOUBLE)) + impact * CAST({alpha} AS DOUBLE) AS score FROM near WHERE {where})
    SELECT id, round(dist, 6) AS dist, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {k}"""


@query("v1_hybrid_search", hybrid(10, 0.5))
def hybrid_search(spark, sf_dir):
    return hits(search.hybrid_search(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), 10))


@query("v1_as_of", hybrid(10, 0.5, "label < 5"))
def search_as_of(spark, sf_dir):
    """The time filters what was found, so fewer may come."""
    return hits(search.hybrid_search(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), 10, as_of="2024-01-05T12:00:00"))


@query("v1_prefiltered", hybrid(10, 0.5, pre="label < 5"))
def search_prefiltered(spark, sf_dir):
    return hits(search.hybrid_search(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), 10, as_of="2024-01-05T12:00:00", prefilter=True))


def text(v) -> str:
    return "[" + ", ".join(f"{x:.6f}" for x in v) + "]"


HQL_VECTOR = [((i * 37) % 21 - 10) / 40 for i in range(64)]
CONSTANT = f"CAST({text(HQL_VECTOR)} AS DOUBLE[])"


@query("v2_hql_search", hybrid(5, 0.0, q=CONSTANT))
def hql_search(spark, sf_dir):
    return hits(Store(nodes(spark, sf_dir).drop("labels"), edgeless(spark), tables.vectors(spark, sf_dir)).hql(f"SEARCH Note SIMILAR TO {text(HQL_VECTOR)} K 5"))


@query("v3_hql_match", hybrid(10, 0.7, q=CONSTANT))
def hql_match(spark, sf_dir):
    return hits(Store(nodes(spark, sf_dir).drop("labels"), edgeless(spark), tables.vectors(spark, sf_dir)).hql(f"MATCH Note SIMILAR TO {text(HQL_VECTOR)} ALPHA 0.7"))


def edgeless(spark):
    return spark.createDataFrame([], "id string, src string, dst string, rel string, valid_to timestamp")


@query("v4_ranked_context", hybrid(8, 0.4))
def ranked_context(spark, sf_dir):
    return hits(search.ranked_context(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), 8))


@query("v11_min_impact", hybrid(8, 0.4, "impact >= 0.5"))
def min_impact(spark, sf_dir):
    return hits(search.ranked_context(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), 8, min_impact=0.5))


SHIFT = [0.1, -0.2, 0.3]


@query("v7_language_shift", hybrid(10, 0.5, q="(SELECT list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + coalesce(CAST([0.1, -0.2, 0.3] AS DOUBLE[])[i], 0)) FROM embeddings WHERE vec_id = 0)"))
def language_shift(spark, sf_dir):
    c = spark.createDataFrame([("th", SHIFT)], "lang string, centroid array<double>")
    return hits(search.hybrid_search(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), 10, lang="th", centroids=c))


@query("v5_l2_to_first", "SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS dist FROM embeddings")
def distances(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(vector.l2(F.col("embedding"), vector.literal(first_vector(spark, sf_dir))), 6).alias("dist"))


@query("v6_cosine_to_first", "SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM embeddings")
def cosines(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(vector.cosine(F.col("embedding"), vector.literal(first_vector(spark, sf_dir))), 6).alias("cosine"))


@query("v8_all_nearest", """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings b)
SELECT query_id, node_id, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) <= 6""")
def all_nearest(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select("node_id", "embedding")
    return search.nearest_many(v, v.withColumnRenamed("node_id", "query_id"), 6).withColumn("dist", F.round("dist", 6))


@query("v9_conflicts", f"""WITH h AS ({hybrid(3, 0.4).replace('round(score, 6)', 's.score')}) SELECT coalesce(bool_or(score > 0.8 AND id % 5 = 0), false) AS refused FROM h""")
def conflicts(spark, sf_dir):
    """Whether a note with the first vector would stand too near a node of tier MASTER."""
    refused = search.conflicts(tables.vectors(spark, sf_dir), nodes(spark, sf_dir), first_vector(spark, sf_dir), ["Note"])
    return spark.createDataFrame([(refused,)], "refused boolean")


@query("v10_proximity_score", "SELECT vec_id AS id, round(CAST(0.5 AS DOUBLE) * ((vec_id % 10) / CAST(10 AS DOUBLE)) + CAST(0.3 AS DOUBLE) * (1 - list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))) + CAST(0.2 AS DOUBLE) / (1 + label), 6) AS score FROM embeddings")
def proximity(spark, sf_dir):
    v = tables.table(spark, sf_dir, "embeddings")
    d = vector.l2(F.col("embedding"), vector.literal(first_vector(spark, sf_dir)))
    return v.select(F.col("vec_id").alias("id"), F.round(search.proximity_score((F.col("vec_id") % 10) / 10.0, d, F.col("label")), 6).alias("score"))


# Identifiers


@query("x1_tokens", """WITH t AS (SELECT s_suppkey AS id, lower(s_name) AS l, s_name AS s FROM supplier), u AS (SELECT id, unnest(string_split(l, '')) AS token FROM t UNION SELECT id, substr(s, i, 2) FROM (SELECT id, s, unnest(generate_series(1, length(s) - 1)) AS i FROM t))
SELECT DISTINCT id, token FROM u WHERE token <> ''""")
def tokens(spark, sf_dir):
    return tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(scalar.tokens(F.col("s_name"))).alias("token"))


@query("x2_strip_marks", "SELECT doc_id, sha256(regexp_replace(text, '[\\pM]', '', 'g')) AS bare FROM documents")
def strip_marks(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(scalar.strip_marks(F.col("text")), 256).alias("bare"))


@query("x3_jaro_winkler", "SELECT p_partkey AS id, round(jaro_winkler_similarity(p_name, p_type), 6) AS score FROM part")
def jaro_winkler(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(scalar.jaro_winkler("p_name", "p_type"), 6).alias("score"))


NAMES = "(SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT r_name FROM region UNION SELECT n_name FROM nation)"


@query("x4_fuzzy_ids", f"""WITH n AS {NAMES}, q AS (SELECT 'x' || substr(name, 2) || 'o' AS query FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier WHERE s_suppkey % 100 = 0 UNION SELECT c_name FROM customer WHERE c_custkey % 100 = 0)),
s AS (SELECT query, name AS id, jaro_winkler_similarity(query, name) AS score FROM q, n)
SELECT query, arg_min(id, (-score, id)) AS id, round(max(score), 6) AS score FROM s GROUP BY query HAVING max(score) > 0.2""")
def fuzzy_ids(spark, sf_dir):
    """Places, and suppliers and customers whose key 100 divides, misspelt, among the names of all."""
    t = lambda n, c, where="true": tables.table(spark, sf_dir, n).where(where).select(F.col(c).alias("id"))
    places = t("region", "r_name").union(t("nation", "n_name"))
    ids = t("supplier", "s_name").union(t("customer", "c_name")).union(places).distinct()
    q = places.union(t("supplier", "s_name", "s_suppkey % 100 = 0")).union(t("customer", "c_name", "c_custkey % 100 = 0"))
    return lexical.resolve(ids, q.select(F.concat(F.lit("x"), F.expr("substring(id, 2)"), F.lit("o")).alias("query"))).withColumn("score", F.round("score", 6))


@query("j8_postings", f"""WITH n AS {NAMES}, t AS (SELECT name, lower(name) AS l FROM n), u AS (SELECT name, unnest(string_split(l, '')) AS token FROM t UNION SELECT name, substr(name, i, 2) FROM (SELECT name, unnest(generate_series(1, length(name) - 1)) AS i FROM n)),
q AS (SELECT DISTINCT n_name AS query, token FROM u JOIN nation ON name = n_name WHERE token <> '')
SELECT query, name AS id, count(*) AS shared FROM q JOIN u USING (token) GROUP BY 1, 2""")
def token_candidates(spark, sf_dir):
    """By the inverted index, the names that share tokens with a nation's."""
    t = lambda n, c: tables.table(spark, sf_dir, n).select(F.col(c).alias("id"))
    ids = t("supplier", "s_name").union(t("customer", "c_name")).union(t("region", "r_name")).union(t("nation", "n_name")).distinct()
    return lexical.sharing(ids, t("nation", "n_name"))


@query("x7_json_fields", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", scalar.json_field(F.col("props"), "k").cast("bigint").alias("k"))


@query("x10_peer_ids", "SELECT s_suppkey AS id, substr(sha256(s_name), 1, 16) AS peer_id FROM supplier")
def peer_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), scalar.peer_id(F.col("s_name").cast("binary")).alias("peer_id"))


@query("x14_float32", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) / 3 AS FLOAT) AS DOUBLE))), 6) AS total FROM embeddings")
def float32(spark, sf_dir):
    v = vector.to_float32(F.transform(vector.doubles(F.col("embedding")), lambda x: x / 3))
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(vector.total(vector.doubles(v)), 6).alias("total"))


@query("x15_vector_arithmetic", "SELECT vec_id AS id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: 2 * x + coalesce(CAST([0.1, -0.2, 0.3] AS DOUBLE[])[i], 0))), 6) AS total FROM embeddings")
def vector_arithmetic(spark, sf_dir):
    v = vector.shift(vector.scale(F.col("embedding"), 2), vector.literal(SHIFT))
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(vector.total(v), 6).alias("total"))
