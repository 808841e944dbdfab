"""Language-model metrics, predictions, leaderboards and token pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import vectors as vec

IGNORED_LABEL = -100


def lm_metrics(df: DataFrame, logits: str, label: str) -> DataFrame:
    """Mean cross-entropy over labelled positions, perplexity, accuracy with and without the
    ignored positions, and the entropy (nats) of the mean distribution."""
    x = F.col(logits).cast("array<double>")
    used = F.col(label) != IGNORED_LABEL
    scored = df.select(
        F.when(used, vec.log_sum_exp(x) - F.get(x, F.col(label))).alias("loss"),
        (vec.argmax(x) == F.col(label)).cast("double").alias("hit"), used.alias("used"), vec.softmax(x).alias("p"),
    )
    # The mean distribution has one row per vocabulary entry; sums combine before the shuffle.
    mean_p = scored.select(F.posexplode("p").alias("i", "p")).groupBy("i").agg(F.avg("p").alias("p"))
    entropy = mean_p.agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)))
    totals = scored.agg(
        F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy_all"),
        F.avg(F.when(F.col("used"), F.col("hit"))).alias("accuracy"),
    )
    return totals.withColumn("perplexity", F.exp("loss")).withColumn("token_entropy", entropy.scalar())


def argmax_predictions(df: DataFrame, id_col: str, logits: str) -> DataFrame:
    return df.select(id_col, vec.argmax(F.col(logits)).alias("prediction"))


def top_predictions(df: DataFrame, id_col: str, scores: str, k: int) -> DataFrame:
    """The ``k`` best entries of each row's score vector; sorted inside the row, nothing is shuffled."""
    tagged = F.transform(F.col(scores).cast("array<double>"), lambda s, i: F.struct((-s).alias("neg"), i.alias("token_id")))
    best = F.slice(F.sort_array(tagged), 1, k)
    out = df.select(id_col, F.posexplode(best).alias("_i", "_t"))
    return out.select(id_col, (F.col("_i") + 1).alias("rank"), F.col("_t.token_id").alias("token_id"), (-F.col("_t.neg")).alias("score"))


def leaderboard(df: DataFrame, model: str, won: Column) -> DataFrame:
    """Wins, comparisons and win rate in percent (two decimals), best first."""
    out = df.groupBy(F.col(model).alias("model")).agg(F.sum(won.cast("bigint")).alias("wins"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("win_rate", F.round(100 * F.col("wins") / F.col("total"), 2)).orderBy(F.desc("win_rate"), "model")


def gain_over(board: DataFrame, baseline: str) -> DataFrame:
    """Difference to the baseline's win rate in percentage points."""
    base = board.where(F.col("model") == baseline).select("win_rate").scalar()
    return board.select("model", "win_rate", F.round(F.col("win_rate") - base, 2).alias("gain_points"))


def pool_vectors(tokens: DataFrame, doc: list[str], pos: str, mask: str, vector: str) -> DataFrame:
    """First-token, masked-mean and masked-max pooling per document, one row per dimension.

    Works on the long form ``(doc, dim)``: long documents combine before the shuffle.
    """
    used = F.col(mask) == 1
    long = tokens.select(*doc, pos, mask, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))
    return long.groupBy(*doc, "dim").agg(
        F.max(F.when(F.col(pos) == 0, F.col("v"))).alias("cls"),
        (F.sum(F.when(used, F.col("v")).otherwise(0.0)) / F.greatest(F.sum(F.when(used, 1.0).otherwise(0.0)), F.lit(1e-9))).alias("mean"),
        F.max(F.when(used, F.col("v"))).alias("max"),
    )


def as_vectors(pooled: DataFrame, doc: list[str], value: str) -> DataFrame:
    """Pooled rows back to one vector per document (as many entries as dimensions)."""
    pairs = F.sort_array(F.collect_list(F.struct("dim", value)))
    return pooled.groupBy(*doc).agg(F.transform(pairs, lambda p: p[value]).alias("embedding"))
