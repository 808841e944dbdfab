"""DuckDB SQL for the numbered operators that SQL can express."""

from __future__ import annotations

from glyphmill.llm import chat, host_rules, mixing, queries, sharding

SQL: dict[str, str] = {}

# RE2 reads the same class as Java: a run of anything but ASCII white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _feistel(source: str, n: str, bits: str) -> str:
    """Subquery with the permuted ``x`` of every row (rn, x) of ``source``."""
    sql = f"SELECT rn, x >> {bits} AS l, x & ((1::BIGINT << {bits}) - 1) AS r FROM {source}"
    for a, b, c in sharding.round_keys(queries.SHARD_SEED):
        sql = f"SELECT rn, l, r, (r * {a} + {c}) & {sharding.MASK} AS t FROM ({sql})"
        sql = f"SELECT rn, l, r, (xor(t, t >> 15) * {b}) & {sharding.MASK} AS t FROM ({sql})"
        sql = f"SELECT rn, r AS l, xor(l, xor(t, t >> 13) >> (32 - {bits})) AS r FROM ({sql})"
    return f"SELECT rn, (l << {bits}) | r AS x FROM ({sql})"


SQL["op1_feistel_shards"] = f"""
WITH RECURSIVE powers AS (
  SELECT i, i AS v, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM powers WHERE step < 8
),
tab AS (SELECT list(v ORDER BY i) AS t FROM powers WHERE step = 8),
raw AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
                     lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])) AS c
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS hx FROM documents), tab
),
base AS (
  SELECT doc_id, size, xor(c, 4294967295) AS text_crc32,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, xor(c, 4294967295), size) - 1 AS rn
  FROM raw
),
dims AS (SELECT count(*) AS n, greatest(1, ((CASE WHEN count(*) < 2 THEN 0 ELSE length(ltrim((count(*) - 1)::BIGINT::BIT::VARCHAR, '0')) END) + 1) // 2) AS bits FROM documents),
start AS (SELECT rn, rn AS x FROM base),
walk AS (
  SELECT f.rn, f.x FROM ({_feistel("(SELECT rn, x, bits FROM start, dims)", "n", "(SELECT bits FROM dims)")}) f
  UNION ALL
  SELECT f.rn, f.x FROM ({_feistel("(SELECT rn, x FROM walk WHERE x >= (SELECT n FROM dims))", "n", "(SELECT bits FROM dims)")}) f
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {queries.SHARDS})::INT AS shard,
       x // {queries.SHARDS} AS slot, NULL::INT AS grown_shard
FROM base JOIN walk USING (rn) WHERE x < (SELECT n FROM dims)
"""

SQL["op3_snapshot_collapse"] = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
  FROM conversations
),
turns AS (SELECT conv_id, pos, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, to_json([role, text])::VARCHAR AS turn FROM placed),
prefixes AS (
  SELECT conv_id, pos + 1 AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM turns
),
ends AS (SELECT prefix, min(conv_id) AS conv_id FROM prefixes WHERE n = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE n < n_turns))
SELECT conv_id, pos // {chat.BLOCK} AS part, count(*) AS n_turns, string_agg(shown, '' ORDER BY pos) AS text
FROM turns SEMI JOIN kept USING (conv_id) GROUP BY conv_id, pos // {chat.BLOCK}
"""

_MULTIPLE = 10
SQL["op5_systematic_mix"] = f"""
WITH docs AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source
),
weighed AS (SELECT source, source_size, {queries.MIX_WEIGHTS}[rank % 3 + 1]::BIGINT AS w, source_size * {queries.MIX_MOST} AS cap, rank FROM sources),
filled AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS caps, coalesce(sum(w) OVER before, 0)::BIGINT AS ws,
         sum(source_size) OVER ()::BIGINT AS all_words, sum(w) OVER ()::BIGINT AS all_w
  FROM weighed
  WINDOW before AS (ORDER BY cap * ({_MULTIPLE} // w), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (SELECT *, ({queries.MIX_SHARE}::DOUBLE * all_words - caps) / (all_w - ws)::DOUBLE AS level FROM filled),
found AS (SELECT arg_min(level, cap * ({_MULTIPLE} // w) * 1000000 + rank) AS level FROM levels WHERE level * w <= cap),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM found) * w, cap::DOUBLE)) AS target FROM filled
),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target * {mixing.UNIT} / source_size)::BIGINT ELSE 0 END AS units,
         ('0x' || substr(md5('{queries.MIX_SEED}|' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 8))::BIGINT & 2147483647 AS draw
  FROM targets
),
ranked AS (
  SELECT d.*, source_size, target, units, draw % {mixing.UNIT} AS shift,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS rank
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (((rank * units + shift) // {mixing.UNIT}) - (((rank - 1) * units + shift) // {mixing.UNIT})) * size AS taken
FROM ranked
"""

SQL["op9_line_bitmaps"] = """
WITH held AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
shared AS (SELECT key, max(doc_id) AS first FROM held WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT h.doc_id, pos, line, s.key IS NULL OR h.doc_id = s.first AS stays FROM held h LEFT JOIN shared s ON h.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# A SHA-1 has 160 bits: 32 characters of five bits each, read from its bit string.
SQL["op2_seekable_warc"] = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages
),
named AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 1 + 5 * i + j, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest
  FROM hashed
),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM kept
"""

_N = host_rules.WINDOW
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL["op8_host_rules"] = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {_N - 2})) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {_N - 1}], ' ') AS words FROM starts),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {_N})) AS place FROM marked WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE trim(line, {_SPACE}) <> '' GROUP BY doc_id
),
counted AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)
),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars / greatest(n_words, 1)::DOUBLE < 3 OR word_chars / greatest(n_words, 1)::DOUBLE > 10 OR n_symbols * 10 > greatest(n_words, 1)
           OR n_dup_lines * 10 > greatest(n_lines, 1) * 3 AS soft_failed
  FROM counted
),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft_failed)::DOUBLE AS fails FROM judged GROUP BY source),
mean AS (SELECT sum(fails) / sum(n) AS m, sum(n) AS n, sum(n * n) AS squares, count(*) AS hosts, max(n) AS largest FROM hosts),
between_hosts AS (
  SELECT mean.*, m * (1 - m) AS chance,
         greatest(0, ((SELECT sum(h.n * (h.fails / h.n - m) ** 2) FROM hosts h) - (hosts - 1) * m * (1 - m)) / greatest(n - squares / n, 1e-9)) AS apart FROM mean
),
prior AS (
  SELECT m, least(greatest(CASE WHEN apart > 0 THEN greatest(0, chance / apart - 1) ELSE largest END, 1), greatest(largest, 1)) AS strength FROM between_hosts
),
rates AS (SELECT source, (fails + m * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {queries.MAX_HOST_RATE} AS kept,
       round(rate, 6) AS host_rate
FROM judged j JOIN rates r ON j.source IS NOT DISTINCT FROM r.source
"""

SQL["op12_filter_audit"] = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
),
marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
masks AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(m.toxic, FALSE) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * len(regexp_extract_all(t.text, '[A-Z]')) > 3 * length(t.text))::INT + 8 * regexp_matches(t.text, '[#$%&*|]')::INT
         + 16 * coalesce(first < t.doc_id, FALSE)::INT AS mask
  FROM texts t JOIN firsts f ON t.text = f.text LEFT JOIN marks m ON t.doc_id = m.doc_id
),
counted AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([1, 2, 4, 8, 16]) AS bit),
grown AS (
  SELECT '' AS filter_order, 0 AS used UNION ALL
  SELECT filter_order || filter, used + bit FROM grown, filters WHERE used & bit = 0
),
steps AS (
  SELECT o.filter_order, s.step::INT AS step, bit,
         coalesce(list_sum(list_transform(range(1, s.step), lambda i: 1 << (ascii(substr(o.filter_order, i::INT, 1)) - 65))), 0)::INT AS before
  FROM (SELECT filter_order FROM grown WHERE used = 31) o, range(1, 6) s(step), filters f WHERE f.filter = substr(o.filter_order, s.step::INT, 1)
),
seen AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM seen
"""
