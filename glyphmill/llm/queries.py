"""The registered queries of the numbered operators: production parameters over whole tables, thin digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import alignment, audit, chat, host_rules, line_dedup, mixing, pieces, quality, rows, sharding, simhash, toxicity, vptree, warc
from glyphmill.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS, SHARD_SEED = 8, 20


@query
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; only digests of the texts are sorted.

    A NULL text counts no bytes (size 1) and has CRC-32 0.
    """
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_rows(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], SHARDS, SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations in chat markup."""
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED = [5, 2, 1], 1.5, 2, 5


@query
def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(rows.words(F.col("text"))).cast("bigint").alias("size"))
    mixed = mixing.mix(docs, F.col("size"), [F.col("doc_id")], MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op9_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the digest of what stays, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    kept = F.when(F.col("_bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(line_dedup.kept_text(F.col("text"), F.col("_bits")))
    return joined.select(
        "doc_id",
        F.size(line_dedup.lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


@query
def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents")
    prints = materialize(docs.select("doc_id", simhash.fingerprint(F.col("text")).alias("fp")))
    grouped = simhash.near_duplicates(prints)
    return grouped.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


MAX_HOST_RATE = 0.6


@query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document and the verdict with its host (the ``source``) considered."""
    docs = table(spark, sf_dir, "documents")
    counted = materialize(docs.select("doc_id", "source", host_rules.count_texts(F.col("text")).alias("c")).select("doc_id", "source", "c.*"))
    judged = host_rules.judge(counted, "source", MAX_HOST_RATE)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


TOXIC_FROM = 0.7


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the labels that are not held out."""
    return toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))


@query
def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= TOXIC_FROM).cast("int").alias("predicted"), "s.n_segments")


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op10_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, TOKENIZER).select("doc_id", F.size("ids").alias("n_ids"), "ids", "intact")


NEAREST, PRUNING = 20, 0.8


@query
def op4_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th, by inner product."""
    vectors = materialize(vptree.vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    index = vptree.build_index(vectors, NEAREST + 1)
    return vptree.nearest(index, vectors.where(F.pmod("vec_id", F.lit(20)) == 0), NEAREST, PRUNING)


@query
def op2_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to seekable archives in the shared folder and read back from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write(pages, scratch_path(spark, "warc"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of every whole text in which the ids of both tokenizers cover the same bytes, and how usual their links are."""
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_TOKENIZER, TOKENIZER)
    return aligned.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


GOOD_FROM = 0.7


def quality_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


@query
def op13_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality_held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", quality_held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language in every order, from a stream over all documents."""
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
