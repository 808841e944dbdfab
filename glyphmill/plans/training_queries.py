"""Queries over encoding, masking, schedules, model inference and graph centralities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.functions.hashing import draw
from glyphmill.operators import encoding, inference, merges, network
from glyphmill.plans.registry import query, spread_documents, sql_draw, sql_runs, sql_tokens, table
from glyphmill.plans.text_queries import CENTRALITY, _NETWORK, _PAIRS, _sql_mask, packed_network, word_network
from glyphmill.session import materialize

# Length limits of the masked and of the causal models.
VOCAB, MASKED, CAUSAL = 1000, 512, 2048


def _vocab(length: int) -> str:
    return f"""
    d AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents),
    vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 4 AS id FROM
              (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word ORDER BY n DESC, word LIMIT {VOCAB})),
    tok AS (SELECT doc_id, unnest(w[1:{length - 2}]) AS word, generate_subscripts(w[1:{length - 2}], 1) AS pos FROM d),
    ids AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM tok LEFT JOIN vocab USING (word) GROUP BY doc_id),
    seq AS (SELECT d.doc_id, list_concat(list_concat([2], coalesce(ids, [])), [3]) AS s FROM d LEFT JOIN ids ON ids.doc_id = d.doc_id),
    padded AS (SELECT doc_id, len(s) AS n, list_concat(s, list_transform(range({length} - len(s)), lambda x: 0)) AS ids FROM seq)"""


def _encoded(spark: SparkSession, sf: str, length: int, pad: bool = True) -> tuple[DataFrame, encoding.Vocabulary]:
    df = spread_documents(spark, sf, "text")
    vocab = encoding.word_vocabulary(df, tx.word_tokens(F.col("text")), VOCAB)
    return encoding.encode(df, tx.word_tokens(F.col("text")), vocab, length, pad=pad, keep=["doc_id"]), vocab


@query("encode_pad", f"""
    WITH {_vocab(CAUSAL)} SELECT doc_id, array_to_string(ids, ',') AS input_ids,
      array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= n THEN 1 ELSE 0 END), ',') AS attention_mask,
      array_to_string(list_transform(ids, lambda x, i: CASE WHEN i > 1 AND i < n THEN 0 ELSE 1 END), ',') AS special_tokens_mask FROM padded""")
def encode_pad(spark: SparkSession, sf: str) -> DataFrame:
    encoded, _ = _encoded(spark, sf, CAUSAL)
    return encoded.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


@query("encode_truncate", f"WITH {_vocab(MASKED)} SELECT doc_id, array_to_string(s, ',') AS input_ids, len(s)::INT AS n_ids FROM seq")
def encode_truncate(spark: SparkSession, sf: str) -> DataFrame:
    encoded, _ = _encoded(spark, sf, MASKED, pad=False)
    return encoded.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.size("input_ids").alias("n_ids"))


def _sql_mlm(p: float) -> str:
    span = 2147483648.0
    chosen, masked, random = int(p * span), int(0.8 * p * span), int(0.9 * p * span)
    return f"""
    WITH {_vocab(MASKED)}, size AS (SELECT count(*) AS v FROM vocab),
      pos AS (SELECT doc_id, n, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS i FROM padded),
      u AS (SELECT *, CASE WHEN i > 0 AND i < n - 1 THEN {sql_draw(1998, '0', 'doc_id', 'i')} ELSE 2147483647 END AS u FROM pos)
    SELECT doc_id,
      string_agg((CASE WHEN u < {masked} THEN 4 WHEN u < {random} THEN {sql_draw(1999, '0', 'doc_id', 'i')} % (SELECT v FROM size) + 5 ELSE id END)::VARCHAR, ',' ORDER BY i) AS input_ids,
      string_agg((CASE WHEN u < {chosen} THEN id ELSE -100 END)::VARCHAR, ',' ORDER BY i) AS labels
    FROM u GROUP BY doc_id"""


@query("mlm_mask", _sql_mlm(0.3))
def mlm_mask(spark: SparkSession, sf: str) -> DataFrame:
    encoded, vocab = _encoded(spark, sf, MASKED)
    masked = encoding.mlm_mask(encoded, "doc_id", vocab.size, p=0.3)
    return masked.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "labels")])


@query("causal_labels", f"WITH {_vocab(CAUSAL)} SELECT doc_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS labels FROM padded")
def causal_labels(spark: SparkSession, sf: str) -> DataFrame:
    encoded, _ = _encoded(spark, sf, CAUSAL)
    return encoded.select("doc_id", F.array_join(encoding.causal_labels(F.col("input_ids")), ",").alias("labels"))


@query("context_curriculum", f"""
    WITH r AS (SELECT doc_id, len({sql_tokens('text')}) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS step, ceil(count(*) OVER () / 8.0) AS total FROM documents),
         p AS (SELECT *, CASE WHEN step >= total THEN 5 ELSE floor(step * 5 / total) END AS part FROM r)
    SELECT doc_id, step, (CASE WHEN part = 5 THEN 1024 ELSE 128 + (part * (1024 - 128))::BIGINT // 5 END)::INT AS max_length,
           least(n + 2, CASE WHEN part = 5 THEN 1024 ELSE 128 + (part * (1024 - 128))::BIGINT // 5 END)::INT AS n_ids FROM p""")
def context_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "text")
    vocab = encoding.word_vocabulary(df, tx.word_tokens(F.col("text")), VOCAB)
    staged = encoding.curriculum(df, "doc_id", 128, 1024, effective_batch=8)
    encoded = encoding.encode(staged, tx.word_tokens(F.col("text")), vocab, F.col("max_length"), pad=False, keep=["doc_id", "step", "max_length"])
    return encoded.select("doc_id", "step", "max_length", F.size("input_ids").alias("n_ids"))


EPOCHS, BATCH = 3, 8


@query("epoch_curriculum", f"""
    WITH t AS (SELECT doc_id, len({sql_tokens('text')}) AS n FROM documents),
         r AS (SELECT doc_id, n, epoch, (row_number() OVER (ORDER BY epoch, {sql_draw(1998, 'epoch', 'doc_id')}, doc_id) - 1) // {BATCH} AS step,
                 ceil(count(*) OVER () / {BATCH}.0) AS total FROM t, range({EPOCHS}) e(epoch)),
         p AS (SELECT *, floor(step * 5 / total) AS part FROM r)
    SELECT doc_id, epoch::INT AS epoch, step, (128 + (part * (1024 - 128))::BIGINT // 5)::INT AS max_length,
           least(n + 2, 128 + (part * (1024 - 128))::BIGINT // 5)::INT AS n_ids FROM p""")
def epoch_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Three epochs, each in a drawn order: step, length in force and ids used of every row."""
    df = spread_documents(spark, sf, "text")
    schedule = encoding.epoch_schedule(df.select("doc_id"), "doc_id", 128, 1024, BATCH, EPOCHS)
    lengths = df.select("doc_id", F.size(tx.word_tokens(F.col("text"))).alias("_n"))
    return schedule.join(lengths, "doc_id").select("doc_id", "epoch", "step", "max_length", F.least(F.col("_n") + 2, "max_length").alias("n_ids"))


# Entries of the trained vocabulary beyond the characters, as many as the reference trains.
MERGES = 70_000
_TRAINED: dict[tuple[str, str], encoding.Subwords] = {}


def subwords(spark: SparkSession, sf: str) -> encoding.Subwords:
    """The vocabulary of all words of the documents, trained once for a table and Spark context."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        alphabet, found = merges.train_merges(spread_documents(spark, sf, "text"), tx.clean_words(F.col("text")), MERGES)
        _TRAINED[key] = encoding.Subwords(spark, alphabet, found)
    return _TRAINED[key]


@query("train_vocab")
def train_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Base symbols and the first 70,000 merges over all words of the documents (all there are, if fewer)."""
    vocab = subwords(spark, sf)
    tokens = [(i, s, "symbol") for i, s in enumerate(vocab.alphabet)]
    tokens += [(len(vocab.alphabet) + i, a + b, "merge") for i, (a, b) in enumerate(vocab.merges)]
    return spark.createDataFrame(tokens, "token_id int, token string, kind string")


@query("token_count_subword")
def token_count_subword(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document and the symbols that the trained merges leave of them."""
    words = tx.clean_words(F.col("text"))
    counted = spread_documents(spark, sf, "text").select("doc_id", words.alias("w"))
    return counted.select("doc_id", F.size("w").alias("n_words"), F.size(encoding.subword_ids(F.col("w"), subwords(spark, sf))).alias("n_tokens"))


def _subword_encoded(spark: SparkSession, sf: str, length: int, pad: bool = True) -> DataFrame:
    return encoding.encode_subwords(spread_documents(spark, sf, "text"), tx.clean_words(F.col("text")), subwords(spark, sf), length, pad=pad, keep=["doc_id"])


@query("encode_subword_pad")
def encode_subword_pad(spark: SparkSession, sf: str) -> DataFrame:
    encoded = _subword_encoded(spark, sf, CAUSAL)
    return encoded.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


@query("encode_subword_truncate")
def encode_subword_truncate(spark: SparkSession, sf: str) -> DataFrame:
    encoded = _subword_encoded(spark, sf, MASKED, pad=False)
    return encoded.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.size("input_ids").alias("n_ids"))


@query("mlm_mask_subword")
def mlm_mask_subword(spark: SparkSession, sf: str) -> DataFrame:
    masked = encoding.mlm_mask(_subword_encoded(spark, sf, MASKED), "doc_id", subwords(spark, sf).size, p=0.3)
    return masked.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "labels")])


@query("causal_labels_subword")
def causal_labels_subword(spark: SparkSession, sf: str) -> DataFrame:
    encoded = _subword_encoded(spark, sf, CAUSAL)
    return encoded.select("doc_id", F.array_join(encoding.causal_labels(F.col("input_ids")), ",").alias("labels"))


@query("batch_infer", f"""
    WITH m AS (SELECT doc_id, string_split({_sql_mask(7)}, ' ') AS w FROM documents)
    SELECT doc_id, 'previous_word' AS model, array_to_string(list_transform(w, lambda x, i: CASE WHEN x <> '<mask>' THEN x WHEN i > 1 THEN w[i - 1] ELSE '' END), ' ') AS output FROM m
    UNION ALL SELECT doc_id, 'word_counter', len(w)::VARCHAR FROM m""")
def batch_infer(spark: SparkSession, sf: str) -> DataFrame:
    df = spread_documents(spark, sf, "text").select("doc_id", tx.mask_word(F.col("text"), draw(7, F.col("doc_id"))).alias("masked"))
    models = {"previous_word": inference.fill_with_previous(), "word_counter": inference.count_words}
    return inference.batch_infer(df, "doc_id", "masked", models, batch_size=16)


@query("fill_mask", f"""
    WITH {_PAIRS}, n AS (SELECT w1, w2, count(*) AS n FROM pairs GROUP BY 1, 2),
      m AS (SELECT doc_id, string_split({_sql_mask(7)}, ' ') AS s FROM documents),
      i AS (SELECT doc_id, s, list_position(s, '<mask>') AS hit FROM m),
      c AS (SELECT doc_id, lower(s[hit - 1]) AS l, lower(s[hit + 1]) AS r FROM i WHERE hit > 1 AND hit < len(s))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a.n * b.n DESC, a.w2) AS rank, a.w2 AS word, a.n * b.n AS score
    FROM c JOIN n a ON a.w1 = l JOIN n b ON b.w1 = a.w2 AND b.w2 = r QUALIFY rank <= 3""")
def fill_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The three best words for the masked one by the bigram counts of the whole corpus."""
    df = spread_documents(spark, sf, "text")
    masked = df.select("doc_id", tx.mask_word(F.col("text"), draw(7, F.col("doc_id"))).alias("masked"))
    counts = network.bigram_counts(df, "text", packed=True)
    return inference.fill_by_bigrams(masked, "doc_id", "masked", counts, 3)


# ---------------------------------------------------------------- graph centralities of the filtered word network

def hub_network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges, nodes = network.filter_by_centrality(packed_network(spark, sf), CENTRALITY)
    return materialize(edges), materialize(nodes)


_ADJ = f"""{_NETWORK},
    adj AS (SELECT w1 AS a, w2 AS b FROM inner_net WHERE w1 <> w2 UNION ALL SELECT w2, w1 FROM inner_net WHERE w1 <> w2)"""

_BETWEENNESS = f"""
    {_ADJ},
    walk(s, v, dist) AS (SELECT word, word, 0 FROM kept UNION ALL SELECT DISTINCT s, b, dist + 1 FROM walk JOIN adj ON a = v WHERE dist < 8),
    dist AS (SELECT s, v, min(dist) AS dist FROM walk GROUP BY s, v),
    sigma(s, v, d, n) AS (
      SELECT word, word, 0, 1::DOUBLE FROM kept
      UNION ALL
      SELECT q.s, adj.b, q.d + 1, sum(q.n) FROM sigma q JOIN adj ON adj.a = q.v JOIN dist t ON t.s = q.s AND t.v = adj.b AND t.dist = q.d + 1 GROUP BY q.s, adj.b, q.d + 1),
    between AS (
      SELECT x.v AS word, sum(x.n * y.n / z.n) AS c FROM sigma x JOIN sigma y ON y.s = x.v AND y.v <> x.v JOIN sigma z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
      WHERE x.s <> x.v GROUP BY 1)"""
_BC = "coalesce(c, 0) / greatest(((SELECT count(*) FROM kept) - 1) * ((SELECT count(*) FROM kept) - 2), 1)"


@query("betweenness", f"WITH RECURSIVE {_BETWEENNESS} SELECT k.word, round({_BC}, 9) AS betweenness FROM kept k LEFT JOIN between b ON b.word = k.word")
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = hub_network(spark, sf)
    return network.betweenness(edges, nodes).withColumn("betweenness", F.round("betweenness", 9))


# Rounds of the SQL iteration: many more than either side needs to agree in six digits.
_EIGENVECTOR = f"""{_NETWORK},
    links AS (SELECT w1 AS a, w2 AS b FROM net WHERE w1 <> w2 UNION ALL SELECT w2, w1 FROM net WHERE w1 <> w2
              UNION ALL SELECT w1, w1 FROM net WHERE w1 = w2 UNION ALL SELECT word, word FROM deg),
    eig(it, word, x) AS (
      SELECT 0, word, 1.0::DOUBLE / (SELECT count(*) FROM deg) FROM deg
      UNION ALL
      SELECT it + 1, word, s / sqrt(sum(s * s) OVER ()) FROM (SELECT e.it, l.b AS word, sum(e.x) AS s FROM eig e JOIN links l ON l.a = e.word WHERE e.it < 100 GROUP BY e.it, l.b))"""
_METRICS = f"""
    WITH RECURSIVE {_EIGENVECTOR}, {_BETWEENNESS.replace(_NETWORK + ",", "")}
    SELECT d.word, round(d.centrality, 6) AS degree, round(CASE WHEN k.word IS NOT NULL THEN {_BC} END, 6) AS betweenness, round(e.x, 6) AS eigenvector
    FROM cent d JOIN eig e ON e.word = d.word AND e.it = 100 LEFT JOIN kept k ON k.word = d.word LEFT JOIN between b ON b.word = d.word"""
_PRECISE = {"max_rounds": 1000, "tolerance": 1e-12}


@query("eigenvector", f"WITH RECURSIVE {_EIGENVECTOR} SELECT word, round(x, 6) AS eigenvector FROM eig WHERE it = 100")
def eigenvector(spark: SparkSession, sf: str) -> DataFrame:
    """Eigenvector centrality of every word of the network."""
    edges = materialize(word_network(spark, sf))
    return network.eigenvector(edges, **_PRECISE).withColumn("eigenvector", F.round("eigenvector", 6))


# Breadth-first search from every word, the last level and the one before at hand; then what a level owes to the one above.
_WHOLE_METRICS = f"""
    WITH RECURSIVE {_EIGENVECTOR},
    num AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word)::INT AS id FROM deg),
    hops AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM (SELECT w1, w2 FROM net WHERE w1 <> w2 UNION ALL SELECT w2, w1 FROM net WHERE w1 <> w2) e
             JOIN num x ON x.word = e.w1 JOIN num y ON y.word = e.w2),
    met(s, v, d, n, latest) AS (
      SELECT id, id, 0, 1::DOUBLE, true FROM num
      UNION ALL
      SELECT * FROM (
        WITH last AS MATERIALIZED (SELECT s, v, d, n FROM met WHERE latest),
        next AS MATERIALIZED (SELECT m.s, h.b AS v, m.d + 1 AS d, sum(m.n) AS n FROM last m JOIN hops h ON h.a = m.v
          ANTI JOIN met o ON o.s = m.s AND o.v = h.b GROUP BY m.s, h.b, m.d)
        SELECT s, v, d, n, true FROM next UNION ALL SELECT s, v, d, n, false FROM last WHERE EXISTS (FROM next))),
    paths AS MATERIALIZED (SELECT s, v, d, n FROM met WHERE d > 0 AND latest),
    owed(s, v, d, n, c) AS (
      SELECT s, v, d, n, 0::DOUBLE FROM paths WHERE d = (SELECT max(d) FROM paths)
      UNION ALL
      SELECT p.s, p.v, p.d, p.n, coalesce(p.n * q.g, 0) FROM (SELECT * FROM paths WHERE d = (SELECT max(d) - 1 FROM owed)) p
      LEFT JOIN (SELECT o.s, h.b AS v, sum((1 + o.c) / o.n) AS g FROM owed o JOIN hops h ON h.a = o.v GROUP BY 1, 2) q ON q.s = p.s AND q.v = p.v),
    through AS (SELECT word, sum(c) AS c FROM owed JOIN num ON id = v GROUP BY 1)
    SELECT d.word, round(d.centrality, 6) AS degree,
           round(coalesce(b.c, 0) / CASE WHEN (SELECT count(*) FROM deg) > 2 THEN ((SELECT count(*) FROM deg) - 1) * ((SELECT count(*) FROM deg) - 2) ELSE 1 END, 6) AS betweenness,
           round(e.x, 6) AS eigenvector
    FROM cent d JOIN eig e ON e.word = d.word AND e.it = 100 LEFT JOIN through b ON b.word = d.word"""


def _rounded(table: DataFrame) -> DataFrame:
    return table.select("word", *[F.round(c, 6).alias(n) for c, n in (("centrality", "degree"), ("betweenness", "betweenness"), ("eigenvector", "eigenvector"))])


@query("network_metrics", _WHOLE_METRICS)
def network_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Degree, betweenness and eigenvector centrality of every word of the whole network, highest degree first."""
    edges = materialize(word_network(spark, sf))
    whole = network.degree_centrality(edges).join(network.eigenvector(edges, **_PRECISE), "word")
    return _rounded(whole.join(network.betweenness(edges), "word")).orderBy(F.desc("degree"), "word")


@query("word_centralities", _METRICS)
def word_centralities(spark: SparkSession, sf: str) -> DataFrame:
    """Degree and eigenvector centrality of every word of the whole network, in no order.

    ``betweenness`` is that within the network of hub words and NULL for other words; ``network_metrics`` has it for all.
    """
    edges = materialize(word_network(spark, sf))
    hubs, kept = (materialize(t) for t in network.filter_by_centrality(edges, CENTRALITY))
    whole = network.degree_centrality(edges).join(network.eigenvector(edges, **_PRECISE), "word")
    return _rounded(whole.join(network.betweenness(hubs, kept), "word", "left"))
