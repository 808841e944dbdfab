import hashlib
import random
from collections import defaultdict

from helpers import docs_frame, make_docs
from pyspark.sql import functions as F

from glyphmill.llm import chat, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_dedup(rows):
    held = defaultdict(set)
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key_of(line)) >= 40:
                    held[key_of(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or key_of(x) not in gone or gone[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_shared_lines_against_plain_python(spark, hot_keys):
    rows = make_docs()
    docs = docs_frame(spark, rows).withColumn("mark", F.lit(1)).withColumn("bits", F.lit(2))
    joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    got = [
        (r.doc_id, r.n, r.d or 0, r.k)
        for r in joined.select("doc_id", F.size(line_dedup.lines(F.col("text"))).alias("n"), F.col("_n_dropped").alias("d"),
                               F.coalesce(line_dedup.kept_text(F.col("text"), F.col("_bits")), F.lit("")).alias("k")).collect()
    ]
    assert sorted(got, key=repr) == plain_dedup(rows)


def test_stage_keeps_columns_and_untouched_texts(spark):
    rows = make_docs()
    out = line_dedup.drop_shared_lines(docs_frame(spark, rows))
    assert out.columns == docs_frame(spark, rows).columns
    want = {(i, k) for i, _, d, k in plain_dedup(rows) if d}
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert want <= got and len(out.collect()) == len(rows)
    assert (None, "no id here") in got and (60, None) in got


def test_bitmaps_of_long_texts_and_far_lines(spark):
    line = "x" * 45
    rows = [(i, "\n".join(f"{i} {k}" for k in range(200)) + f"\n{line}\n" + "\n".join("tail" for _ in range(300)) + f"\n{line}", "", "", 0) for i in range(6)]
    rows.append((6, line, "", "", 0))
    out = {r.doc_id: r.text for r in line_dedup.drop_shared_lines(docs_frame(spark, rows)).collect()}
    assert out[6] == line and all(line not in out[i] and len(out[i].split("\n")) == 500 for i in range(6))
    four = line_dedup.drop_shared_lines(docs_frame(spark, rows[:4])).collect()
    assert all(r.text.count(line) == 2 for r in four)


def test_ids_that_name_two_texts(spark):
    line = "y" * 50
    rows = [(i, line, "", "", 0) for i in range(5)] + [(2, f"first\n{line}\nlast", "", "", 0)]
    out = sorted((r.doc_id, r.text) for r in line_dedup.drop_shared_lines(docs_frame(spark, rows)).collect())
    assert out == [(0, ""), (1, ""), (2, ""), (2, "first\nlast"), (3, ""), (4, line)]
    assert line_dedup.drop_shared_lines(docs_frame(spark, rows).limit(0)).count() == 0


def plain_chat(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r or "unknown", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: (v[0], v[1]))] for c, v in convs.items()}
    out = {}
    for c, v in turns.items():
        inner = any(o != c and len(w) > len(v) and w[: len(v)] == v for o, w in turns.items())
        first = all(w != v or o == c or (o is None, o or 0) > (c is None, c or 0) for o, w in turns.items())
        if not inner and first:
            out[c] = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)
    return out


def random_log(seed=5):
    rng, rows = random.Random(seed), []
    base = [[(rng.choice(["user", "assistant", None]), f"t{rng.randint(0, 9)}") for _ in range(rng.randint(2, 6))] for _ in range(8)]
    for c in range(60):
        conv = rng.choice(base)[: rng.randint(1, 6)] + ([("user", f"own {c}")] if rng.random() < 0.2 else [])
        rows += [(c, k * 3, r, x) for k, (r, x) in enumerate(conv)]
    return rows + [(None, 0, "user", "adrift"), (None, 1, None, None), (99, None, "user", "no turn"), (99, 1, "user", "")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_maximal_conversations(spark, hot_keys):
    rows = random_log()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("pos", F.lit(1)).withColumn("part", F.lit("x"))
    got = {r.conv_id: r.text for r in chat.collapse_and_render(turns).collect()}
    assert got == plain_chat(rows)


def test_long_conversations_roll_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [(1, t, "user", f"m{t}") for t in range(23)] + [(2, t, "user", f"m{t}") for t in range(11)] + [(3, t, "user", f"m{t}") for t in range(22)]
    rows += [(4, t, "user", f"m{t if t != 5 else 77}") for t in range(11)]
    parts = chat.collapse_and_render(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    text = defaultdict(str)
    for r in sorted(parts, key=lambda r: (r.conv_id, r.part)):
        text[r.conv_id] += r.text
        assert r.n_turns <= 4
    assert dict(text) == plain_chat(rows) and set(text) == {1, 4}
    assert chat.collapse_and_render(spark.createDataFrame([], SCHEMA)).count() == 0
