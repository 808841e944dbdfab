"""Queries over sources, projections, splits, exact duplicates and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import dedup, ordering, schema, stacking, stats
from glyphmill.plans import assembly
from glyphmill.plans.registry import (
    SPLIT, documents, query, spread_documents, spread_table, sql_clean, sql_clean_words, sql_draw, sql_not_blank, sql_runs, sql_words, table,
)
from glyphmill.session import scratch_path
from glyphmill.sources import tables


# ---------------------------------------------------------------- sources and sinks

@query("scan_corpus", f"SELECT {SPLIT} AS split, doc_id, text, lang, source FROM documents")
def scan_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("split", "doc_id", "text", "lang", "source")


@query("scan_split", "SELECT doc_id, text FROM documents WHERE doc_id % 100 = 99")
def scan_split(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "split")
    schema.select_columns(documents(spark, sf), ["doc_id", "text", "split"]).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).where(F.col("split") == "test").select("doc_id", "text")


@query("csv_roundtrip", "SELECT item_id, text FROM benchmark")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.write_csv(table(spark, sf, "benchmark"), scratch_path(spark, "csv"))
    return tables.read_csv(spark, path, "item_id BIGINT, text STRING")


@query("publish_corpus", f"SELECT count(*) AS n_rows, sum(len({sql_runs('text')}))::BIGINT AS n_tokens, 'first release' AS message FROM documents")
def publish_corpus(spark: SparkSession, sf: str) -> DataFrame:
    df = documents(spark, sf).select("doc_id", "split", "text", "source").withColumn("token_count", tx.token_count(F.col("text")))
    return tables.publish(df, scratch_path(spark, "corpus"), "first release", tokens=F.col("token_count"))


@query("head_rows", "SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.head(table(spark, sf, "documents").select("doc_id", "source", "lang"), 5, "doc_id")


@query("text_batches", "SELECT batch_no, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM "
       "(SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch_no FROM documents) GROUP BY batch_no")
def text_batches(spark: SparkSession, sf: str) -> DataFrame:
    batched = tables.numbered_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 1000)
    return batched.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


# ---------------------------------------------------------------- projections and filters

@query("drop_columns", "SELECT doc_id, text, lang FROM documents")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return schema.drop_columns(table(spark, sf, "documents"), ["source", "n_chars"])


@query("select_columns", "SELECT source, doc_id, lang FROM documents")
def select_columns(spark: SparkSession, sf: str) -> DataFrame:
    return schema.select_columns(table(spark, sf, "documents"), ["source", "doc_id", "lang"])


@query("filter_class", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def filter_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("lang") == "fr").select("doc_id", "lang")


@query("filter_topic_len", "SELECT doc_id, text FROM documents WHERE lang = 'es' AND length(text) > 20")
def filter_topic_len(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents")
    return df.where((F.col("lang") == "es") & (F.length("text") > 20)).select("doc_id", "text")


@query("filter_blank", f"SELECT doc_id FROM documents WHERE {sql_not_blank('text')}")
def filter_blank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(tx.not_blank(F.col("text"))).select("doc_id")


@query("stack_text", "SELECT url AS text, 'pages' AS dataset_source FROM pages UNION ALL SELECT html, 'pages' FROM pages")
def stack_text(spark: SparkSession, sf: str) -> DataFrame:
    spec = stacking.SourceSpec("pages", table(spark, sf, "pages"), ["page_id"], [])
    return stacking.stack_source(spec).select("text", "dataset_source")


@query("stack_metadata", "SELECT text, '{''lang'': ''' || lang || ''', ''n_chars'': ''' || n_chars || '''}' AS metadata FROM documents")
def stack_metadata(spark: SparkSession, sf: str) -> DataFrame:
    spec = stacking.SourceSpec("documents", table(spark, sf, "documents").drop("source"), ["doc_id"], ["lang", "n_chars"])
    return stacking.stack_source(spec).select("text", "metadata")


@query("source_label", "SELECT dataset_source, count(*) AS n_rows FROM (SELECT source AS dataset_source FROM documents "
       "UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY dataset_source")
def source_label(spark: SparkSession, sf: str) -> DataFrame:
    labelled = stacking.combine_sources([
        stacking.SourceSpec("documents", table(spark, sf, "documents"), ["doc_id"], ["lang", "source", "n_chars"], "source"),
        stacking.SourceSpec("benchmark", table(spark, sf, "benchmark"), ["item_id"]),
    ])
    return stats.count_by(labelled, "dataset_source")


@query("fill_source", "SELECT CASE WHEN s = '' THEN 'unnamed' ELSE s END AS source, count(*) AS n_rows FROM "
       "(SELECT CASE WHEN lang = 'fr' THEN '' ELSE source END AS s FROM documents) GROUP BY 1")
def fill_source(spark: SparkSession, sf: str) -> DataFrame:
    emptied = table(spark, sf, "documents").select(F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("source"))
    return stats.count_by(emptied.select(tx.fill_value(F.col("source"), "", "unnamed").alias("source")), "source")


@query("to_text", "SELECT u.conv_id, u.turn, u.text || ' ' || coalesce(a.text, 'None') AS text FROM conversations u "
       "LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def to_text(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = asked.join(answered, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", tx.join_as_text(F.col("instruction"), F.col("answer")).alias("text"))


# ---------------------------------------------------------------- set operations

@query("concat_splits", f"SELECT {SPLIT} AS split, doc_id, text, lang, NULL::BIGINT AS item_id FROM documents "
       "UNION ALL SELECT 'validation', NULL, text, NULL, item_id FROM benchmark")
def concat_splits(spark: SparkSession, sf: str) -> DataFrame:
    bench = table(spark, sf, "benchmark").withColumn("split", F.lit("validation"))
    return stacking.concat_splits(documents(spark, sf).select("split", "doc_id", "text", "lang"), bench)


def corpus_sources(spark: SparkSession, sf: str) -> list[stacking.SourceSpec]:
    """The four text tables as sources, in order of preference."""
    return [
        stacking.SourceSpec("benchmark", table(spark, sf, "benchmark"), ["item_id"]),
        stacking.SourceSpec(
            "documents", schema.with_split(spread_table(spark, sf, "documents", "doc_id"), "doc_id"), ["doc_id"], ["lang", "source", "n_chars"], "source"),
        stacking.SourceSpec("conversations", table(spark, sf, "conversations"), ["conv_id", "turn"], ["role"]),
        stacking.SourceSpec("pages", spread_table(spark, sf, "pages", "page_id"), ["page_id"]),
    ]


_STACKED = f"""
    SELECT 'train' AS split, text, 'benchmark' AS dataset_source, '{{}}' AS metadata, 0 AS s, 0 AS b, 0 AS c, item_id AS k1, 0 AS k2 FROM benchmark
    UNION ALL SELECT {SPLIT}, text, source, '{{''lang'': ''' || lang || ''', ''source'': ''' || source || ''', ''n_chars'': ''' || n_chars || '''}}', 1, 0, 0, doc_id, 0 FROM documents
    UNION ALL SELECT 'train', text, 'conversations', '{{''role'': ''' || role || '''}}', 2, 0, 0, conv_id, turn FROM conversations
    UNION ALL SELECT 'train', url, 'pages', '{{}}', 3, page_id // 1000, 0, page_id, 0 FROM pages
    UNION ALL SELECT 'train', html, 'pages', '{{}}', 3, page_id // 1000, 1, page_id, 0 FROM pages"""


@query("combine_sources", f"SELECT split, text, dataset_source, metadata FROM ({_STACKED})")
def combine_sources(spark: SparkSession, sf: str) -> DataFrame:
    return stacking.combine_sources(corpus_sources(spark, sf)).drop("ord")


_MIXES = {"stage_two": {"en": 1, "fr": 2}, "decay": {"fr": 1, "de": 1, "es": 1}}


@query("mix_sources", f"""
    SELECT mix, count(*) AS n_rows, sum(len({sql_runs('text')}))::BIGINT AS n_tokens
    FROM documents d JOIN (VALUES ('stage_two','en'),('stage_two','fr'),('stage_two','fr'),('decay','fr'),('decay','de'),('decay','es')) m(mix, lang)
      ON d.lang = m.lang GROUP BY mix""")
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    counted = spread_documents(spark, sf, "text", "lang").select("lang", tx.token_count(F.col("text")).alias("tokens"))
    mixed = stacking.mix(counted, "lang", _MIXES)
    return mixed.groupBy("mix").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tokens").cast("bigint").alias("n_tokens"))


# ---------------------------------------------------------------- order, samples, exact duplicates

@query("dedup_exact", f"SELECT split, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY doc_id) AS rn "
       f"FROM (SELECT *, {SPLIT} AS split FROM documents)) WHERE rn = 1")
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.drop_exact(documents(spark, sf), "text", "doc_id", by=["split"]).select("split", "doc_id", "source")


@query("global_ids", f"SELECT doc_id, split || '_' || (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) AS global_id "
       f"FROM (SELECT doc_id, {SPLIT} AS split FROM documents)")
def global_ids(spark: SparkSession, sf: str) -> DataFrame:
    numbered = ordering.row_index(documents(spark, sf).select("doc_id", "split"), "doc_id", by=["split"])
    return numbered.select("doc_id", F.concat_ws("_", "split", "row_idx").alias("global_id"))


@query("sample_n", f"SELECT doc_id, text FROM documents ORDER BY {sql_draw(1998, 'doc_id')}, doc_id LIMIT 100")
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.sample_exact(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 100, seed=1998)


@query("train_test_split", f"""
    SELECT doc_id, CASE WHEN rn <= ceil(n * 0.01) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT doc_id, row_number() OVER (ORDER BY {sql_draw(1998, 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)""")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.01, seed=1998)


@query("source_overlap", "WITH t AS (SELECT DISTINCT text, source FROM documents) SELECT a.source AS source_a, b.source AS source_b, "
       "count(*) AS n_texts FROM t a JOIN t b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2")
def source_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.source_overlap(table(spark, sf, "documents"), "text", "source")


# ---------------------------------------------------------------- statistics

@query("split_sizes", f"SELECT {SPLIT} AS split, count(*) AS n_rows FROM documents GROUP BY 1")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_by(documents(spark, sf), "split")


@query("token_totals", f"SELECT {SPLIT} AS split, sum(len({sql_runs('text')}))::BIGINT AS n_tokens FROM documents GROUP BY 1")
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.total_by(schema.with_split(spread_documents(spark, sf, "text"), "doc_id"), "split", tx.token_count(F.col("text")), "n_tokens")


@query("value_counts", "SELECT source, count(*) AS n_rows FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n_rows DESC, source")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_counts(table(spark, sf, "documents"), "source")


@query("distinct_values", "SELECT DISTINCT source FROM documents")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_values(table(spark, sf, "documents"), "source")


@query("null_count", "SELECT count(*) FILTER (source IS NULL) AS source_nulls, count(*) FILTER (lang IS NULL) AS lang_nulls FROM documents")
def null_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.null_counts(table(spark, sf, "documents"), ["source", "lang"])


@query("stat_distribution", f"""
    SELECT split, n_rows, round(mean_all, 6) AS mean_all, round(std_all, 6) AS std_all, n_above, round(mean_capped, 6) AS mean_capped,
           round(std_capped, 6) AS std_capped, round(100.0 * n_above / n_rows, 6) AS percent_above,
           round(CASE WHEN mean_capped - std_capped > 0 THEN mean_capped - std_capped END, 6) AS lower_mark,
           round(mean_capped + std_capped, 6) AS upper_mark
    FROM (SELECT {SPLIT} AS split, count(w) AS n_rows, avg(w) AS mean_all, stddev_pop(w) AS std_all, count(*) FILTER (w > 500) AS n_above,
                 avg(w) FILTER (w <= 500) AS mean_capped, stddev_pop(w) FILTER (w <= 500) AS std_capped
          FROM (SELECT doc_id, len({sql_words('text')}) AS w FROM documents) GROUP BY 1)""")
def stat_distribution(spark: SparkSession, sf: str) -> DataFrame:
    counted = schema.with_split(spread_documents(spark, sf, "text"), "doc_id").select("split", tx.word_count(F.col("text")).alias("words"))
    out = stats.distribution(counted, "words", 500, by="split")
    exact = ["split", "n_rows", "n_above"]
    return out.select(*[c if c in exact else F.round(c, 6).alias(c) for c in out.columns])


@query("histogram30", f"""
    WITH v AS (SELECT len({sql_words('text')})::DOUBLE AS v FROM documents), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
         c AS (SELECT least(floor((v - lo) * 30 / (hi - lo)), 29)::INT AS bin, count(*) AS n FROM v, e GROUP BY 1)
    SELECT i::INT AS bin, round(lo + (hi - lo) / 30 * i, 6) AS bin_from, coalesce(n, 0) AS n_rows
    FROM range(30) r(i) CROSS JOIN e LEFT JOIN c ON c.bin = i""")
def histogram30(spark: SparkSession, sf: str) -> DataFrame:
    counted = spread_documents(spark, sf, "text").select(tx.word_count(F.col("text")).alias("words"))
    return stats.histogram(counted, "words", 30).withColumn("bin_from", F.round("bin_from", 6))


@query("word_freq", f"SELECT w AS word, count(*) AS freq FROM (SELECT unnest({sql_clean_words('text')}) AS w FROM documents) GROUP BY w")
def word_freq(spark: SparkSession, sf: str) -> DataFrame:
    return stats.word_frequency(spread_documents(spark, sf, "text"), tx.clean_words(F.col("text")))


_NGRAM_ROWS = " UNION ALL ".join(
    f"SELECT {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS ngram FROM d" for n in (1, 2, 3)
)


_TOP_NGRAMS = f"""
    WITH d AS (SELECT {sql_clean_words('text')} AS w FROM documents),
         c AS (SELECT n, ngram, count(*) AS freq FROM ({_NGRAM_ROWS}) GROUP BY 1, 2)
    SELECT n, ngram, freq, row_number() OVER (PARTITION BY n ORDER BY freq DESC, ngram) AS rank FROM c QUALIFY rank <= 20"""


@query("top_ngrams", _TOP_NGRAMS)
def top_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_ngrams(spread_documents(spark, sf, "text"), "text", [1, 2, 3], 20)


@query("frequent_ngrams", _TOP_NGRAMS)
def frequent_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """The same n-grams; only those of heavy hash buckets are shuffled."""
    return stats.frequent_ngrams(spread_documents(spark, sf, "text"), "text", [1, 2, 3], 20)


@query("word_cloud", f"""
    WITH f AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest({sql_clean_words('text')}) AS w FROM documents) GROUP BY w
               ORDER BY freq DESC, w LIMIT 100)
    SELECT word, freq, round(freq / (SELECT max(freq) FROM f), 6) AS weight FROM f""")
def word_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return stats.word_cloud(spread_documents(spark, sf, "text"), "text", 100).withColumn("weight", F.round("weight", 6))


@query("corpus_report", f"""
    SELECT {SPLIT} AS split, count(*) AS n_rows, sum(strlen(text))::BIGINT AS n_bytes, sum(len({sql_words('text')}))::BIGINT AS n_words,
           sum(len({sql_runs('text')}))::BIGINT AS n_tokens FROM documents GROUP BY 1""")
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus_card(schema.with_split(spread_documents(spark, sf, "text"), "doc_id"), "text", "split")


# ---------------------------------------------------------------- scalar text functions

@query("word_count", f"SELECT doc_id, len({sql_words('text')})::INT AS word_count FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf, "text").select("doc_id", tx.word_count(F.col("text")).alias("word_count"))


@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf, "text").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query("token_count", f"SELECT doc_id, least(len({sql_runs('text')}), 2048)::INT AS token_count FROM documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf, "text").select("doc_id", tx.token_count(F.col("text"), 2048).alias("token_count"))


@query("truncate_text", "SELECT doc_id, substring(text, 1, 1024) AS display_text, substring(text, 1, 420) AS prompt_text FROM documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.truncate_chars(t, 1024).alias("display_text"), tx.truncate_chars(t, 420).alias("prompt_text")
    )


# ---------------------------------------------------------------- the whole assembly

@query("corpus_assembly", f"""
    SELECT split, dataset_source, count(*) AS n_rows, sum(len({sql_runs('text')}))::BIGINT AS n_tokens,
           sum(len({sql_words('text')}))::BIGINT AS n_words
    FROM (SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY s, b, c, k1, k2) AS rn FROM ({_STACKED}) WHERE {sql_not_blank('text')})
    WHERE rn = 1 GROUP BY split, dataset_source""")
def corpus_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.assembled_totals(corpus_sources(spark, sf))


@query("assembled_rows", f"""
    SELECT split, text, dataset_source, metadata, len({sql_runs('text')})::INT AS token_count, len({sql_words('text')})::INT AS word_count
    FROM (SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY s, b, c, k1, k2) AS rn FROM ({_STACKED}) WHERE {sql_not_blank('text')})
    WHERE rn = 1""")
def assembled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.assemble(corpus_sources(spark, sf)).drop("ord")


@query("assemble_published", f"""
    WITH stacked AS (
      SELECT 'train' AS split, text, 'benchmark' AS dataset_source, 0 AS s, item_id AS k FROM benchmark
      UNION ALL SELECT {SPLIT}, text, source, 1, doc_id FROM documents
      UNION ALL SELECT {SPLIT}, text, 'release', 2, doc_id FROM documents
      UNION ALL SELECT 'train', text, 'release', 2, conv_id * 1000 + turn FROM conversations)
    SELECT split, text, dataset_source FROM (
      SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY s, k) AS rn FROM stacked WHERE {sql_not_blank('text')}) WHERE rn = 1""")
def assemble_published(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark and documents added to a release that holds the documents already, and conversations besides."""
    release = documents(spark, sf).select("split", "text", F.lit("release").alias("dataset_source"), F.struct(F.lit("d").alias("t"), F.col("doc_id").alias("k")).alias("ord"))
    talks = table(spark, sf, "conversations").select(
        F.lit("train").alias("split"), "text", F.lit("release").alias("dataset_source"),
        F.struct(F.lit("c").alias("t"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k")).alias("ord"),
    )
    return assembly.assemble(corpus_sources(spark, sf)[:2], release.unionByName(talks)).select("split", "text", "dataset_source")
