"""Queries over vectors, neighbours, clusters, topics, metrics and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions import vectors as vec
from glyphmill.functions.hashing import uniform
from glyphmill.operators import clustering, evaluation, hashed_search, neighbors, topics
from glyphmill.plans.registry import documents, query, spread_documents, sql_clean_words, sql_draw, sql_int31, sql_tokens, table
from glyphmill.session import materialize, scratch_path

EPS, MIN_SAMPLES = 0.02, 4


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def projected(axis: int) -> Column:
    """Coordinate of a vector on one axis of a fixed orthogonal projection of all its entries.

    The axis alternates in sign every ``2 ** axis`` entries; eight is the axis' length at 64 entries.
    """
    signed = F.transform("embedding", lambda x, i: x.cast("double") * (1 - 2 * F.pmod(F.shiftright(i, axis), F.lit(2))))
    return F.aggregate(signed, F.lit(0.0), lambda total, x: total + x) / 8


def sql_projected(axis: int) -> str:
    signed = f"list_transform(embedding, lambda x, i: x::DOUBLE * (1 - 2 * (((i - 1) >> {axis}) % 2)))"
    return f"list_reduce(list_prepend(0::DOUBLE, {signed}), lambda a, b: a + b) / 8"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors on two axes of a projection of all entries."""
    return embeddings(spark, sf).select("vec_id", projected(0).alias("x"), projected(1).alias("y"), "label")


def label_means(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.mean_vectors(embeddings(spark, sf), "label", "embedding").withColumnRenamed("label", "query_id")


_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_POINTS = f"p AS MATERIALIZED (SELECT vec_id, {sql_projected(0)} AS x, {sql_projected(1)} AS y, label FROM embeddings)"
_MEANS = """
    long AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(v) AS m FROM long GROUP BY 1, 2) GROUP BY 1)"""
_KNN = f"""{_MEANS},
    d AS (SELECT query_id, vec_id, e.label, list_sum(list_transform(list_zip(q, embedding), lambda z: (z[1] - z[2]::DOUBLE) * (z[1] - z[2]::DOUBLE))) AS distance
          FROM means, embeddings e),
    knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 5)"""


# ---------------------------------------------------------------- vector functions and search

@query("cosine_pairs", """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = e.select("vec_id", "embedding").join(nxt, "vec_id")
    return both.select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("normalize_truncate", f"""
    WITH c AS (SELECT vec_id, {_V}[1:16] AS v FROM embeddings)
    SELECT vec_id, pos, round(x / n, 6) AS value FROM
      (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c)""")
def normalize_truncate(spark: SparkSession, sf: str) -> DataFrame:
    unit = embeddings(spark, sf).select("vec_id", vec.truncate_normalize(F.col("embedding"), 16).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("value"))


@query("knn_search", f"WITH {_KNN} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM knn")
def knn_search(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbors.knn(embeddings(spark, sf), label_means(spark, sf), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("knn_infer", f"""
    WITH {_KNN}, v AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first FROM knn GROUP BY 1, 2)
    SELECT query_id, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1""")
def knn_infer(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.knn_label(embeddings(spark, sf), label_means(spark, sf), 5)


@query("similarity_matrix", f"""
    WITH {_MEANS} SELECT a.query_id AS left_id, b.query_id AS right_id, round(list_cosine_similarity(a.q, b.q), 6) AS similarity FROM means a, means b""")
def similarity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    means = label_means(spark, sf)
    out = neighbors.similarity_matrix(means, means, "query_id", "embedding")
    return out.withColumn("similarity", F.round("similarity", 6))


_ROW_KNN = """
    d AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
          FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
    knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 5)"""


def row_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 100, as a query."""
    return embeddings(spark, sf).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("knn_search_rows", f"WITH {_ROW_KNN} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM knn")
def knn_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbors.knn(embeddings(spark, sf), row_queries(spark, sf), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("knn_infer_rows", f"""
    WITH {_ROW_KNN}, v AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first FROM knn GROUP BY 1, 2)
    SELECT query_id, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1""")
def knn_infer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.knn_label(embeddings(spark, sf), row_queries(spark, sf), 5)


@query("knn_approx_rows")
def knn_approx_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth row against all rows by probed sign buckets."""
    found = hashed_search.knn_approx(embeddings(spark, sf), row_queries(spark, sf), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("similarity_rows", f"""
    SELECT q.vec_id AS left_id, e.vec_id AS right_id, round(list_cosine_similarity({_V.replace('embedding', 'q.embedding')}, {_V.replace('embedding', 'e.embedding')}), 6) AS similarity
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0""")
def similarity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth row against all rows, block by block."""
    out = neighbors.similarity_matrix(row_queries(spark, sf).withColumnRenamed("query_id", "vec_id"), embeddings(spark, sf), "vec_id", "embedding")
    return out.withColumn("similarity", F.round("similarity", 6))


# ---------------------------------------------------------------- clusters

@query("non_noise", "SELECT vec_id, label FROM embeddings WHERE label <> 0")
def non_noise(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.non_noise(embeddings(spark, sf).select("vec_id", "label"), noise=0)


@query("cluster_members", "SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS cluster_size FROM embeddings")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.members(embeddings(spark, sf), "vec_id")


@query("cluster_centroids", f"""
    SELECT label, round(avg({sql_projected(0)}), 6) AS x, round(avg({sql_projected(1)}), 6) AS y, round(avg({sql_projected(2)}), 6) AS z
    FROM embeddings GROUP BY label""")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    placed = embeddings(spark, sf).select("label", *[projected(i).alias(c) for i, c in enumerate("xyz")])
    return clustering.centroids(placed, "label", list("xyz")).select("label", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("cluster_count", "SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_count(embeddings(spark, sf))


@query("cluster_sample", f"""
    WITH m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
         d AS (SELECT DISTINCT label, n, j FROM m, range(1, 11) r(j))
    SELECT d.label, d.j::INT AS draw_no, m.vec_id FROM d JOIN m ON m.label = d.label AND m.pos = {sql_draw(1998, 'd.label', 'd.j')} % d.n""")
def cluster_sample(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.sample_members(embeddings(spark, sf), "vec_id", "label", 10)


@query("density_grid", f"""
    WITH {_POINTS}, b AS (SELECT label, floor(x / 0.05)::BIGINT AS bx, floor(y / 0.05)::BIGINT AS "by", count(*) AS n FROM p GROUP BY 1, 2, 3)
    SELECT * FROM b WHERE label IN (SELECT label FROM p GROUP BY label HAVING count(*) >= 4)""")
def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.density_grid(points(spark, sf), "label", "x", "y", 0.05)


@query("cluster_hull", f"""
    WITH {_POINTS}, q AS (SELECT * FROM p WHERE label <> 0),
         e AS (SELECT a.label, a.x, a.y, max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS worst
               FROM q a JOIN q b ON a.label = b.label AND (a.x, a.y) <> (b.x, b.y) JOIN q c ON c.label = a.label GROUP BY a.label, a.x, a.y, b.x, b.y)
    SELECT DISTINCT label, round(x, 6) AS x, round(y, 6) AS y FROM e WHERE worst <= 0""")
def cluster_hull(spark: SparkSession, sf: str) -> DataFrame:
    hulls = clustering.cluster_hulls(points(spark, sf), "label", "x", "y", noise=0)
    return hulls.select("label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _near(eps: float, least: int) -> str:
    return f"""{_POINTS},
    nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps} * {eps}),
    core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {least})"""


@query("eps_neighbors", f"WITH {_near(EPS, MIN_SAMPLES)} SELECT vec_id, vec_id IN (SELECT id FROM core) AS is_core FROM p")
def eps_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Which points have at least ``min_samples`` points within eps (themselves included)."""
    return clustering.core_points(points(spark, sf), "vec_id", ["x", "y"], EPS, MIN_SAMPLES)


def _dbscan(eps: float, least: int) -> str:
    return f"""
    {_near(eps, least)},
    cc AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(a, b) AS (SELECT a, b FROM cc UNION SELECT r.a, c.b FROM reach r JOIN cc c ON c.a = r.b),
    root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
    lab AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM root),
    border AS (SELECT nb.a AS id, min(l.label) AS label FROM nb JOIN lab l ON l.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
    done AS (SELECT p.vec_id, p.x, p.y, coalesce(l.label, b.label, -1)::INT AS label FROM p LEFT JOIN lab l ON l.id = p.vec_id LEFT JOIN border b ON b.id = p.vec_id)"""


@query("dbscan", f"WITH RECURSIVE {_dbscan(EPS, MIN_SAMPLES)} SELECT vec_id, label FROM done")
def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.dbscan(points(spark, sf).drop("label"), "vec_id", ["x", "y"], EPS, MIN_SAMPLES)


V_EPS = 1.15


@query("dbscan_vectors", f"""
    WITH RECURSIVE v AS (SELECT vec_id, {_V} AS e FROM embeddings),
    nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= {V_EPS} * {V_EPS}),
    core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
    cc AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(a, b) AS (SELECT a, b FROM cc UNION SELECT r.a, c.b FROM reach r JOIN cc c ON c.a = r.b),
    lab AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)),
    border AS (SELECT nb.a AS id, min(l.label) AS label FROM nb JOIN lab l ON l.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a)
    SELECT v.vec_id, coalesce(l.label, b.label, -1)::INT AS label FROM v LEFT JOIN lab l ON l.id = v.vec_id LEFT JOIN border b ON b.id = v.vec_id""")
def dbscan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.dbscan_vectors(embeddings(spark, sf), "vec_id", "embedding", V_EPS, MIN_SAMPLES)


@query("silhouette", """
    WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
         s AS (SELECT label, i, sum(v) AS s FROM c GROUP BY 1, 2), n AS (SELECT vec_id, label, sum(v * v) AS sq FROM c GROUP BY 1, 2),
         k AS (SELECT label, count(*) AS n, sum(sq) AS psi FROM n GROUP BY label),
         d AS (SELECT c.vec_id, s.label AS other, sum(c.v * s.s) AS dot FROM c JOIN s ON s.i = c.i GROUP BY 1, 2),
         m AS (SELECT n.vec_id, n.label, d.other, k.n, n.sq + k.psi / k.n - 2 * d.dot / k.n AS mean_sq FROM n JOIN d ON d.vec_id = n.vec_id JOIN k ON k.label = d.other),
         ab AS (SELECT vec_id, max(n) FILTER (other = label) AS n, max(mean_sq * n / (n - 1)) FILTER (other = label) AS a, min(mean_sq) FILTER (other <> label) AS b FROM m GROUP BY vec_id)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    value = clustering.silhouette(embeddings(spark, sf), "embedding", "label")
    return spark.createDataFrame([(value,)], "silhouette double").select(F.round("silhouette", 6).alias("silhouette"))


@query("silhouette_rows", """
    WITH d AS (SELECT x.vec_id, x.label, y.label AS other, sum(sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding),
                 lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))) AS total FROM embeddings x, embeddings y GROUP BY 1, 2, 3),
         k AS (SELECT label AS other, count(*) AS n FROM embeddings GROUP BY 1),
         ab AS (SELECT vec_id, max(n) FILTER (label = other) AS n, max(total / greatest(n - 1, 1)) FILTER (label = other) AS a,
                  min(total / n) FILTER (label <> other) AS b FROM d JOIN k USING (other) GROUP BY 1)
    SELECT vec_id, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab WHERE b IS NOT NULL""")
def silhouette_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette of every row by Euclidean distance."""
    rows = clustering.exact_silhouette(embeddings(spark, sf), "vec_id", "embedding", "label", noise=None)
    return rows.withColumn("silhouette", F.round("silhouette", 6))


_SWEEP = [(0.015, 4), (0.02, 4), (0.03, 8)]
_SWEPT = " UNION ALL ".join(f"""
    SELECT * FROM (WITH RECURSIVE {_dbscan(eps, least)},
      q AS (SELECT * FROM done WHERE label <> -1),
      k AS (SELECT label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS psi FROM q GROUP BY label),
      m AS (SELECT q.vec_id, q.label, k.label AS other, k.n, q.x * q.x + q.y * q.y + psi / k.n - 2 * (q.x * sx + q.y * sy) / k.n AS mean_sq FROM q, k),
      ab AS (SELECT vec_id, max(n) FILTER (other = label) AS n, max(mean_sq * n / (n - 1)) FILTER (other = label AND n > 1) AS a, min(mean_sq) FILTER (other <> label) AS b FROM m GROUP BY vec_id)
      SELECT {eps}::DOUBLE AS eps, {least} AS min_samples, (SELECT count(*) FROM k) AS n_clusters, (SELECT count(*) FROM done WHERE label = -1) AS n_noise,
             CASE WHEN (SELECT count(*) FROM k) > 1 THEN (SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM ab) END AS silhouette)""" for eps, least in _SWEEP)


@query("dbscan_sweep", _SWEPT)
def dbscan_sweep(spark: SparkSession, sf: str) -> DataFrame:
    swept = clustering.sweep(materialize(points(spark, sf).drop("label")), "vec_id", ["x", "y"], _SWEEP)
    return swept.withColumn("silhouette", F.round("silhouette", 6))


# ---------------------------------------------------------------- topics

@query("embed_text")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return topics.embed_text(spread_documents(spark, sf, "text"), "doc_id", "text", dims=64)


@query("project_pca")
def project_pca(spark: SparkSession, sf: str) -> DataFrame:
    return topics.project_pca(embeddings(spark, sf), "vec_id", "embedding", 2)


@query("topic_model")
def topic_model(spark: SparkSession, sf: str) -> DataFrame:
    """Documents embedded, projected and clustered; terms of each cluster."""
    docs = spread_documents(spark, sf, "text")
    vectors = materialize(topics.embed_text(docs, "doc_id", "text"))
    fitted = topics.fit_topics(vectors, "doc_id", "embedding", 0.05, 5, docs, "text", terms=5)
    return fitted["terms"]


@query("topic_terms", f"""
    WITH w AS (SELECT lang, unnest({sql_clean_words('text')}) AS word FROM documents), tf AS (SELECT lang, word, count(*) AS tf FROM w GROUP BY 1, 2),
         s AS (SELECT lang, word, tf, tf * ln(1 + (SELECT sum(tf) / count(DISTINCT lang) FROM tf) / sum(tf) OVER (PARTITION BY word)) AS score FROM tf)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, word) AS rank, word, tf, round(score, 4) AS score FROM s QUALIFY rank <= 10""")
def topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.topic_terms(spread_documents(spark, sf, "text", "lang"), "lang", tx.clean_words(F.col("text")), 10)
    return out.withColumn("score", F.round("score", 4))


_DRAWN = f"""
    m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n
          FROM embeddings JOIN documents ON doc_id = vec_id),
    d AS (SELECT DISTINCT label, n, j FROM m, range(1, 11) r(j)),
    drawn AS (SELECT d.label, d.j, m.vec_id FROM d JOIN m ON m.label = d.label AND m.pos = {sql_draw(1998, 'd.label', 'd.j')} % d.n)"""


@query("topic_prompts", f"""
    WITH {_DRAWN} SELECT label, count(*)::INT AS n_examples,
      string_agg('Example ' || j || ':' || chr(10) || substring(text, 1, 420), chr(10) || chr(10) ORDER BY j) || chr(10) || chr(10) || '{topics.DEFAULT_INSTRUCTION}' AS prompt
    FROM drawn JOIN documents ON doc_id = vec_id GROUP BY label""")
def topic_prompts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "label").join(docs.select("doc_id"), "doc_id")
    samples = clustering.sample_members(labelled, "doc_id", "label", 10)
    return topics.topic_prompts(samples, docs, "doc_id", "text", "label")


@query("cluster_save_load", f"""
    WITH {_POINTS} SELECT label, count(*) AS n_points, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p GROUP BY label""")
def cluster_save_load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "clusters")
    saved = embeddings(spark, sf).select("vec_id", "embedding", "label").join(points(spark, sf).drop("label"), "vec_id")
    topics.save_clusters(saved, None, path)
    back = topics.load_clusters(spark, path)
    sizes = back.groupBy("label").agg(F.count(F.lit(1)).alias("n_points"))
    centers = clustering.centroids(back, "label", ["x", "y"])
    return sizes.join(centers, "label").select("label", "n_points", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("label_new_texts")
def label_new_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Test texts labelled by a clustering of the train texts that was saved and loaded again."""
    docs = documents(spark, sf).select("doc_id", "text", "split")
    train = docs.where("split = 'train'")
    embedder = topics.Embedder.fit(train, "text")
    vectors = materialize(embedder.embed(train, "doc_id", "text"))
    points = topics.fit_topics(vectors, "doc_id", "embedding", 0.05, 5)["points"].join(vectors, "doc_id")
    path = scratch_path(spark, "clusters")
    topics.save_clusters(points, None, path, embedder)
    return topics.label_texts(docs.where("split = 'test'"), "doc_id", "text", path, k=5)


# ---------------------------------------------------------------- model metrics

_LOGITS = f"x AS (SELECT vec_id, label, {_V} AS l FROM embeddings)"


@query("lm_metrics", f"""
    WITH {_LOGITS}, r AS (SELECT label, l, ln(list_sum(list_transform(l, lambda v: exp(v)))) AS lse, list_position(l, list_max(l)) - 1 AS pred FROM x),
         m AS (SELECT i, avg(p) AS p FROM (SELECT unnest(list_transform(l, lambda v: exp(v - lse))) AS p, generate_subscripts(l, 1) AS i FROM r) GROUP BY i),
         t AS (SELECT avg(lse - l[label + 1]) AS loss, avg((pred = label)::INT) AS accuracy FROM r)
    SELECT round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity, round(accuracy, 6) AS accuracy, round(accuracy, 6) AS accuracy_all,
           (SELECT round(-sum(p * ln(p)), 6) FROM m) AS token_entropy FROM t""")
def lm_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.lm_metrics(embeddings(spark, sf), "embedding", "label")
    return out.select(*[F.round(c, 6).alias(c) for c in ("loss", "perplexity", "accuracy", "accuracy_all", "token_entropy")])


@query("argmax_pred", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS prediction FROM embeddings")
def argmax_pred(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.argmax_predictions(embeddings(spark, sf), "vec_id", "embedding")


@query("top_predictions", f"""
    WITH s AS (SELECT vec_id, unnest({_V}) AS score, generate_subscripts(embedding, 1) - 1 AS token_id FROM embeddings)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token_id) AS rank, token_id, round(score, 6) AS score FROM s QUALIFY rank <= 3""")
def top_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.top_predictions(embeddings(spark, sf), "vec_id", "embedding", 3).withColumn("score", F.round("score", 6))


_BOARD = """b AS (SELECT event_type AS model, sum((value > 10)::INT)::BIGINT AS wins, count(*) AS total,
                         round(100 * sum((value > 10)::INT) / count(*), 2) AS win_rate FROM events GROUP BY 1)"""


@query("leaderboard", f"WITH {_BOARD} SELECT * FROM b")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.leaderboard(table(spark, sf, "events"), "event_type", F.col("value") > 10)


@query("leaderboard_delta", f"WITH {_BOARD} SELECT model, win_rate, round(win_rate - (SELECT win_rate FROM b WHERE model = 'view'), 2) AS gain_points FROM b")
def leaderboard_delta(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.gain_over(leaderboard(spark, sf), "view")


def _token_vector(token: Column, dims: int) -> Column:
    """A stand-in token vector: one hash draw in [-1, 1) per dimension."""
    return F.array(*[uniform(d, token) * 2 - 1 for d in range(dims)])


@query("pool_vectors", f"""
    WITH t AS (SELECT conv_id, turn, unnest({sql_tokens('text')}) AS tok, generate_subscripts({sql_tokens('text')}, 1) - 1 AS pos FROM conversations),
         v AS (SELECT conv_id, turn, pos, CASE WHEN length(tok) > 2 THEN 1 ELSE 0 END AS mask, dim,
                      {sql_int31("dim || '|' || tok")} / 2147483648.0::DOUBLE * 2 - 1 AS v FROM t, range(4) r(dim))
    SELECT conv_id, turn, dim::INT AS dim, round(max(v) FILTER (pos = 0), 6) AS cls,
           round(coalesce(sum(v) FILTER (mask = 1), 0) / greatest(count(*) FILTER (mask = 1), 1e-9), 6) AS mean, round(max(v) FILTER (mask = 1), 6) AS max
    FROM v GROUP BY 1, 2, 3""")
def pool_vectors(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.word_tokens(F.col("text"))).alias("pos", "tok"))
    tokens = words.select(
        "conv_id", "turn", "pos", F.when(F.length("tok") > 2, 1).otherwise(0).alias("mask"), _token_vector(F.col("tok"), 4).alias("v")
    )
    pooled = evaluation.pool_vectors(tokens, ["conv_id", "turn"], "pos", "mask", "v")
    return pooled.select("conv_id", "turn", "dim", *[F.round(c, 6).alias(c) for c in ("cls", "mean", "max")])
