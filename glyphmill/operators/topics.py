"""Text embeddings, projections, topic terms and prompts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import clustering, hashed_search, neighbors
from glyphmill.session import materialize


def _features(text: Column, features: int) -> Column:
    return F.transform(tx.clean_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


@dataclass(frozen=True)
class Embedder:
    """Text vectors of unit length: hashed word counts times inverse document frequency, then a seeded
    random projection that each worker rebuilds. The weights are one number per feature."""

    weights: np.ndarray
    dims: int = 64
    seed: int = 1998

    @classmethod
    def fit(cls, df: DataFrame, text: str, dims: int = 64, features: int = 1 << 16, seed: int = 1998) -> Embedder:
        """Document frequencies over all rows of ``df``."""
        hashed = df.select(F.explode(F.array_distinct(_features(F.col(text), features))).alias("f"))
        found = hashed.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
        rows = df.count()
        weights = np.full(features, np.log(rows + 1.0))
        for f, n in found:
            weights[f] = np.log((rows + 1.0) / (n + 1.0))
        return cls(weights, dims, seed)

    def embed(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """``id, embedding``; NULL texts and texts without a word get the zero vector."""
        shared, dims, seed = df.sparkSession.sparkContext.broadcast(self.weights), self.dims, self.seed

        @F.pandas_udf("array<double>")
        def project(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            idf = shared.value
            matrix = np.random.default_rng(seed).standard_normal((len(idf), dims))

            def one(f: np.ndarray | None) -> np.ndarray:
                if f is None:
                    return np.zeros(dims)
                idx, count = np.unique(np.asarray(f, dtype=np.int64), return_counts=True)
                v = (count * idf[idx]) @ matrix[idx]
                length = np.linalg.norm(v)
                return v / length if length > 0 else v

            for s in parts:
                yield s.map(one)

        return df.select(id_col, project(_features(F.col(text), len(self.weights))).alias("embedding"))

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.weights.tolist(), self.dims, self.seed)]
        spark.createDataFrame(row, "weights array<double>, dims int, seed bigint").write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedder:
        weights, dims, seed = spark.read.parquet(path).select("weights", "dims", "seed").first()
        return cls(np.array(weights), dims, seed)


def embed_text(df: DataFrame, id_col: str, text: str, dims: int = 64, features: int = 1 << 16, seed: int = 1998) -> DataFrame:
    """``id, embedding`` by an :class:`Embedder` fitted on ``df`` itself."""
    return Embedder.fit(df, text, dims, features, seed).embed(df, id_col, text)


def project_pca(df: DataFrame, id_col: str, vec: str, k: int = 2) -> DataFrame:
    """Principal components ``x, y[, z]``; each component's largest loading is made positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = ["x", "y", "z"][:k]
    ready = df.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, i])), i] >= 0 else -1.0 for i in range(k)]
    out = model.transform(ready).select(id_col, vector_to_array("_p").alias("_p"))
    return out.select(id_col, *[(F.col("_p")[i] * signs[i]).alias(names[i]) for i in range(k)])


def topic_terms(df: DataFrame, cluster: str, words: Column, k: int = 10) -> DataFrame:
    """Top terms per cluster by class-based TF-IDF: ``tf * ln(1 + A / f)`` with ``A`` the mean number
    of words per cluster and ``f`` the term's count over all clusters."""
    tf = df.select(cluster, F.explode(words).alias("word")).groupBy(cluster, "word").agg(F.count(F.lit(1)).alias("tf"))
    # After counting, a word has at most one row per cluster.
    scored = tf.withColumn("f", F.sum("tf").over(Window.partitionBy("word")))
    mean_words = tf.agg((F.sum("tf") / F.count_distinct(cluster)).alias("a")).scalar()
    scored = scored.withColumn("score", F.col("tf") * F.ln(1 + mean_words / F.col("f")))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(cluster, "rank", "word", "tf", "score")


DEFAULT_INSTRUCTION = "Name the topic these texts share in at most seven words. Answer with the topic only."
DEFAULT_TEMPLATE = "{examples}\n\n{instruction}"


def topic_prompts(
    samples: DataFrame, texts: DataFrame, id_col: str, text: str, label: str,
    chunk: int = 420, instruction: str = DEFAULT_INSTRUCTION, template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """One prompt per cluster from its drawn members: numbered examples, then the instruction.

    ``samples`` holds a fixed number of draws per cluster, so a prompt's list is bounded.
    """
    picked = samples.join(texts.select(id_col, F.substring(text, 1, chunk).alias("_t")), id_col)
    block = F.concat(F.lit("Example "), F.col("draw_no").cast("string"), F.lit(":\n"), F.col("_t"))
    grouped = picked.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("draw_no", block.alias("b")))).alias("_b"))
    examples = F.array_join(F.transform("_b", lambda s: s["b"]), "\n\n")
    filled = F.replace(F.replace(F.lit(template), F.lit("{instruction}"), F.lit(instruction)), F.lit("{examples}"), examples)
    return grouped.select(label, F.size("_b").alias("n_examples"), filled.alias("prompt"))


def fit_topics(
    vectors: DataFrame, id_col: str, vec: str, eps: float, min_samples: int,
    texts: DataFrame | None = None, text: str = "text", terms: int = 10,
) -> dict[str, DataFrame]:
    """Project, cluster and describe: ``points (id, x, y, label)``, ``centroids`` and, with texts, ``terms``."""
    placed = materialize(project_pca(vectors, id_col, vec, 2))
    labels = clustering.dbscan(placed, id_col, ["x", "y"], eps, min_samples)
    points = materialize(placed.join(labels, id_col))
    out = {"points": points, "centroids": clustering.centroids(points, "label", ["x", "y"])}
    if texts is not None:
        named = clustering.non_noise(points).join(texts, id_col)
        out["terms"] = topic_terms(named, "label", tx.clean_words(F.col(text)), terms)
    return out


def save_clusters(points: DataFrame, summaries: DataFrame | None, path: str, embedder: Embedder | None = None) -> None:
    """Points, and where given the summaries and the embedder that made the points' vectors."""
    points.write.mode("errorifexists").parquet(f"{path}/points")
    if summaries is not None:
        summaries.write.mode("errorifexists").parquet(f"{path}/summaries")
    if embedder is not None:
        embedder.save(points.sparkSession, f"{path}/embedder")


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """The saved point table; members and centroids are derived from it again."""
    return spark.read.parquet(f"{path}/points")


def load_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The cluster summaries saved with the points."""
    return spark.read.parquet(f"{path}/summaries")


def label_texts(
    new: DataFrame, id_col: str, text: str, path: str, k: int = 1, saved_id: str = "doc_id", vec: str = "embedding", exact: bool = True,
) -> DataFrame:
    """``id, label, votes``: new texts labelled by a clustering saved with its embedder.

    A text is embedded with the saved weights, its ``k`` nearest saved points vote and a tie goes to the
    label met first; noise votes like any label. One row per new text, whose ids are distinct; a text without
    a word, NULL included, has a NULL label and no votes, and saved points without a vector do not
    vote. ``exact=False`` searches by :func:`hashed_search.knn_approx`.
    """
    spark = new.sparkSession
    there = lambda v: F.exists(v, lambda x: x != 0)
    points = load_clusters(spark, path).where(there(F.col(vec))).select(saved_id, vec, "label")
    asked = Embedder.load(spark, f"{path}/embedder").embed(new, id_col, text).select(F.col(id_col).alias("query_id"), F.col("embedding").alias(vec))
    asked = materialize(asked.where(there(F.col(vec))))
    search = neighbors.knn if exact else hashed_search.knn_approx
    votes = neighbors.vote(search(points, asked, k, base_id=saved_id, vec=vec), points, saved_id)
    found = votes.select(F.col("query_id").alias(id_col), "label", "votes")
    return new.select(id_col).join(found, id_col, "left").select(id_col, "label", F.coalesce("votes", F.lit(0)).alias("votes"))
