"""Queries over shingles, near duplicates, bigrams, word networks and benchmark rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions.hashing import draw
from glyphmill.operators import dedup, near_pairs, network, ordering
from glyphmill.plans.benchmark import benchmark_rows
from glyphmill.plans.registry import (
    query, spread_documents, sql_clean_words, sql_draw, sql_int31, sql_ngrams, sql_not_blank, sql_tokens, sql_words, table,
)
from glyphmill.operators.schema import with_split

MIN_FREQ = 5
CENTRALITY = 0.05

# ---------------------------------------------------------------- near duplicates

_BANDS, _ROWS = dedup.best_bands(0.75, 128)
_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(dedup.permutations(128)))
_SIGNED = f"""
    tok AS (SELECT doc_id, text, {sql_tokens('text')} AS w FROM documents WHERE {sql_not_blank('text')}),
    sh AS (SELECT DISTINCT doc_id, unnest({sql_ngrams('w', 3)}) AS s FROM tok WHERE len(w) >= 3),
    hs AS (SELECT doc_id, {sql_int31('s')} AS h FROM sh),
    perm(i, a, b) AS (VALUES {_PERMS}),
    sig AS (SELECT doc_id, i, min((a::BIGINT * h + b) % 2147483647) AS m FROM hs CROSS JOIN perm GROUP BY 1, 2)"""
_BANDED = f"""{_SIGNED},
    bands AS (SELECT doc_id, i // {_ROWS} AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS key FROM sig
              WHERE i < {_BANDS * _ROWS} GROUP BY 1, 2)"""


@query("shingles", f"""
    SELECT doc_id, len(s) AS n_shingles, list_min(s) AS first_shingle, list_max(s) AS last_shingle
    FROM (SELECT doc_id, list_distinct({sql_ngrams('w', 3)}) AS s FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents))""")
def shingles(spark: SparkSession, sf: str) -> DataFrame:
    s = spread_documents(spark, sf, "text").select("doc_id", tx.shingles(F.col("text"), 3).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.array_min("s").alias("first_shingle"), F.array_max("s").alias("last_shingle"))


@query("minhash_signatures", f"WITH {_SIGNED} SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY i) AS signature FROM sig GROUP BY doc_id")
def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    signed = dedup.signatures(spread_documents(spark, sf, "text"), "text", ["doc_id"])
    return signed.select("doc_id", F.array_join("signature", ",").alias("signature"))


# Classes of equal shingle sets, all pairs of representatives in the buckets of the short bands, their true similarity.
_VERIFIED = f"""{_SIGNED},
    cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS rep FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS g FROM sh GROUP BY 1)),
    bands AS (SELECT doc_id, i // {near_pairs.ROWS} AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS key FROM sig
              WHERE i < {near_pairs.BANDS * near_pairs.ROWS} AND doc_id IN (SELECT rep FROM cls) GROUP BY 1, 2),
    mates AS (SELECT DISTINCT p.doc_id AS later, q.doc_id AS earlier FROM bands p JOIN bands q ON p.band = q.band AND p.key = q.key AND p.doc_id > q.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT later, earlier, count(*) AS c FROM mates JOIN sh a ON a.doc_id = later JOIN sh b ON b.doc_id = earlier AND a.s = b.s GROUP BY 1, 2),
    verified AS (SELECT later, earlier, c / (x.n + y.n - c) AS jaccard FROM common JOIN n x ON x.doc_id = later JOIN n y ON y.doc_id = earlier
                 WHERE c / (x.n + y.n - c) >= 0.75)"""


@query("lsh_candidates", f"""
    WITH {_VERIFIED}, ends AS (SELECT rep, count(*) AS n FROM (SELECT later AS rep FROM verified UNION ALL SELECT earlier FROM verified) GROUP BY 1)
    SELECT doc_id, rep AS class_id, coalesce(n, 0) AS n_links FROM cls LEFT JOIN ends USING (rep)""")
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Class of equal shingle sets of every row, with the number of other classes that are near it."""
    _, membership = near_pairs.verified_pairs(spread_documents(spark, sf, "text"), "text", "doc_id")
    return membership.select(F.col("ord").alias("doc_id"), F.col("rep").alias("class_id"), "n_links")


@query("jaccard_pairs", f"WITH {_VERIFIED} SELECT later AS doc_id, earlier AS near_id, round(jaccard, 6) AS jaccard FROM verified")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of class representatives that meets in a bucket and is similar, with its true similarity."""
    pairs, _ = near_pairs.verified_pairs(spread_documents(spark, sf, "text"), "text", "doc_id")
    return pairs.select(F.col("later").alias("doc_id"), F.col("earlier").alias("near_id"), F.round("jaccard", 6).alias("jaccard"))


# The sequential pass in SQL: one step per row with a collision, carrying the rows dropped so far.
_MET = """
    SELECT DISTINCT x.doc_id AS later, y.doc_id AS earlier FROM bands p JOIN bands q ON p.band = q.band AND p.key = q.key
    JOIN o x ON x.doc_id = p.doc_id JOIN o y ON y.doc_id = q.doc_id WHERE y.o < x.o AND x.grp = y.grp"""


def _greedy_sql(ord_expr: str, separate: str, select: str, tables: str = _BANDED, pairs: str = _MET) -> str:
    return f"""
    WITH RECURSIVE {tables},
      o AS (SELECT doc_id, {ord_expr} AS o, {separate} AS grp FROM documents),
      pairs AS ({pairs}),
      near AS (SELECT later, list(earlier) AS es, row_number() OVER (ORDER BY min(o.o)) AS step FROM pairs JOIN o ON o.doc_id = later GROUP BY later),
      run(step, gone) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT n.step, CASE WHEN len(list_filter(n.es, lambda e: NOT list_contains(r.gone, e))) > 0 THEN list_append(r.gone, n.later) ELSE r.gone END
        FROM run r JOIN near n ON n.step = r.step + 1),
      last AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM run ORDER BY step DESC LIMIT 1))
    SELECT {select} FROM tok WHERE len(w) >= 3 AND doc_id NOT IN (SELECT doc_id FROM last)"""


@query("dedup_minhash", _greedy_sql("doc_id", "doc_id % 100 = 99", "doc_id"))
def dedup_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.drop_near(with_split(spread_documents(spark, sf, "text"), "doc_id"), "text", "doc_id", by=["split"]).select("doc_id")


@query("dedup_minhash_cross_split", _greedy_sql("CASE WHEN doc_id % 100 = 99 THEN 1 ELSE 0 END * 1000000000000 + doc_id", "1",
       "doc_id, CASE WHEN doc_id % 100 = 99 THEN 'test' ELSE 'train' END AS split"))
def dedup_minhash_cross_split(spark: SparkSession, sf: str) -> DataFrame:
    place = F.struct(F.when(F.col("split") == "train", 0).otherwise(1).alias("split_no"), F.col("doc_id").alias("row"))
    return dedup.drop_near(with_split(spread_documents(spark, sf, "text"), "doc_id").withColumn("ord", place), "text", "ord").select("doc_id", "split")


@query("dedup_minhash_verified", _greedy_sql("doc_id", "1", "doc_id", _VERIFIED,
       "SELECT c.doc_id AS later, earlier FROM verified JOIN cls c ON c.rep = later UNION ALL SELECT doc_id, rep FROM cls WHERE doc_id > rep"))
def dedup_minhash_verified(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs.drop_verified(spread_documents(spark, sf, "text"), "text", "doc_id").select("doc_id")


# ---------------------------------------------------------------- bigrams and the word network

_WORDS = f"d AS (SELECT doc_id, {sql_clean_words('text')} AS w FROM documents)"
_PAIRS = f"""{_WORDS},
    pairs AS (SELECT doc_id, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))"""
_NETWORK = f"""{_PAIRS},
    freq AS (SELECT x AS word, count(*) AS freq FROM (SELECT unnest(w) AS x FROM d) GROUP BY 1),
    edges AS (SELECT least(w1, w2) AS w1, greatest(w1, w2) AS w2, sum(CASE WHEN w1 = w2 THEN 2 ELSE 1 END)::BIGINT AS weight FROM pairs
              GROUP BY 1, 2),
    net AS (SELECT e.w1, e.w2, e.weight, a.freq AS freq1, b.freq AS freq2 FROM edges e JOIN freq a ON a.word = e.w1 JOIN freq b ON b.word = e.w2
            WHERE a.freq >= {MIN_FREQ} AND b.freq >= {MIN_FREQ}),
    deg AS (SELECT word, count(*) AS degree FROM (SELECT w1 AS word FROM net UNION ALL SELECT w2 FROM net) GROUP BY word),
    cent AS (SELECT word, degree, degree / ((SELECT count(*) FROM deg) - 1) AS centrality FROM deg),
    kept AS (SELECT word FROM cent WHERE centrality >= {CENTRALITY}),
    inner_net AS (SELECT w1, w2, weight FROM net WHERE w1 IN (SELECT word FROM kept) AND w2 IN (SELECT word FROM kept)),
    inner_deg AS (SELECT k.word, coalesce(d.degree, 0) AS degree FROM kept k LEFT JOIN
                  (SELECT word, count(*) AS degree FROM (SELECT w1 AS word FROM inner_net UNION ALL SELECT w2 FROM inner_net) GROUP BY word) d
                  ON d.word = k.word)"""


def word_network(spark: SparkSession, sf: str) -> DataFrame:
    return network.word_edges(spread_documents(spark, sf, "text"), "text", MIN_FREQ)


def packed_network(spark: SparkSession, sf: str) -> network.PackedEdges:
    return network.word_edges(spread_documents(spark, sf, "text"), "text", MIN_FREQ, packed=True)


@query("bigrams", f"WITH {_PAIRS} SELECT doc_id, w1, w2 FROM pairs")
def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return network.document_bigrams(spread_documents(spark, sf, "text"), "text", ["doc_id"])


@query("bigram_counts", f"WITH {_PAIRS} SELECT w1, w2, count(*) AS n_pairs FROM pairs GROUP BY 1, 2")
def bigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return network.bigram_counts(spread_documents(spark, sf, "text"), "text")


@query("bigrams_cross_doc", f"""
    WITH {_WORDS}, s AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM d),
         p AS (SELECT w1, lead(w1) OVER (ORDER BY doc_id, i) AS w2 FROM s)
    SELECT w1, w2, count(*) AS n_pairs FROM p WHERE w2 IS NOT NULL GROUP BY 1, 2""")
def bigrams_cross_doc(spark: SparkSession, sf: str) -> DataFrame:
    return network.bigram_counts(spread_documents(spark, sf, "text"), "text", cross_document_order="doc_id")


@query("word_edges", f"WITH {_NETWORK} SELECT w1, w2, weight FROM net")
def word_edges(spark: SparkSession, sf: str) -> DataFrame:
    return word_network(spark, sf)


@query("edge_freq_join", f"WITH {_NETWORK} SELECT w1, w2, weight, freq1, freq2 FROM net")
def edge_freq_join(spark: SparkSession, sf: str) -> DataFrame:
    return network.frequent_edges(spread_documents(spark, sf, "text"), "text", MIN_FREQ)


@query("degree_centrality", f"WITH {_NETWORK} SELECT word, degree, round(centrality, 9) AS centrality FROM cent")
def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return network.degree_centrality(packed_network(spark, sf)).withColumn("centrality", F.round("centrality", 9))


@query("network_size", f"WITH {_NETWORK} SELECT count(*) AS n_edges, sum(weight)::BIGINT AS total_weight, (SELECT count(*) FROM deg) AS n_nodes FROM net")
def network_size(spark: SparkSession, sf: str) -> DataFrame:
    return network.network_size(packed_network(spark, sf))


@query("filter_network", f"WITH {_NETWORK} SELECT w1, w2, weight FROM inner_net")
def filter_network(spark: SparkSession, sf: str) -> DataFrame:
    return network.filter_by_centrality(packed_network(spark, sf), CENTRALITY)[0]


@query("word_network", f"""
    WITH {_NETWORK} SELECT word, degree::BIGINT AS degree, round(CASE WHEN (SELECT count(*) FROM inner_deg) > 1
           THEN degree / ((SELECT count(*) FROM inner_deg) - 1) ELSE 1 END, 9) AS centrality FROM inner_deg""")
def filtered_network(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = network.filter_by_centrality(packed_network(spark, sf), CENTRALITY)
    return network.degree_centrality(edges, nodes).withColumn("centrality", F.round("centrality", 9))


# ---------------------------------------------------------------- benchmark rows

_TAKEN = """
    t AS (SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE length(text) > 20)
          JOIN (VALUES ('en', 15), ('fr', 10), ('de', 25), ('es', 10)) q(lang, n) USING (lang) WHERE rn <= n)"""
QUOTAS = {"en": 15, "fr": 10, "de": 25, "es": 10}


def _sql_mask(seed: int) -> str:
    hit = f"({sql_draw(seed, 'doc_id')} % len(string_split(text, ' ')))"
    return (f"array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i - 1 = {hit} THEN '<mask>' ELSE w END), ' ')")


def _sql_prefix(words: str) -> str:
    return (f"array_to_string({words}[1:CASE WHEN len({words}) < 45 THEN len({words}) // 2 ELSE len({words}) // 3 * 2 END], ' ')")


@query("stratified_take", f"WITH {_TAKEN} SELECT doc_id, lang FROM t")
def stratified_take(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").where(F.length("text") > 20).select("doc_id", "lang")
    return ordering.first_per_group(df, "lang", ["doc_id"], QUOTAS)


@query("mask_word", f"SELECT doc_id, {_sql_mask(7)} AS masked FROM documents")
def mask_word(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf, "text").select("doc_id", tx.mask_word(F.col("text"), draw(7, F.col("doc_id"))).alias("masked"))


@query("swap_mask_token", f"SELECT doc_id, replace({_sql_mask(7)}, '<mask>', '[MASK]') AS masked FROM documents")
def swap_mask_token(spark: SparkSession, sf: str) -> DataFrame:
    return mask_word(spark, sf).withColumn("masked", tx.swap_token(F.col("masked"), "<mask>", "[MASK]"))


@query("causal_prefix", f"SELECT doc_id, {_sql_prefix('w')} AS prefix FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)")
def causal_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return spread_documents(spark, sf, "text").select("doc_id", tx.causal_prefix(F.col("text")).alias("prefix"))


@query("lm_benchmark", f"""
    WITH {_TAKEN} SELECT text AS ground_truth, {_sql_mask(7)} AS masked_sentence, {_sql_prefix(sql_words('text'))} AS causal_sentence, lang AS topic FROM t""")
def lm_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_rows(table(spark, sf, "documents"), "doc_id", "text", "lang", QUOTAS, seed=7)
