"""Text expressions against plain Python on text the driver tables do not have."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as tx

SAMPLES = [
    "", " ", "\t", " ", "a", "one", "one two", "one two three four",
    "قَلَمٌ جديد، ١٢٣", "x² snake_case MiXeD", "double  spaces here",
    "tab\tnewline\nnbsp ideographic　end", "It's 3.5% (or 4)!", "l'été à Paris…", " line sep",
]


@pytest.fixture(scope="module")
def rows(spark):
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, t string")
    out = df.select(
        "id", tx.not_blank(t).alias("filled"), tx.word_count(t).alias("wc"), tx.split_words(t).alias("words"),
        tx.clean_text(t).alias("clean"), tx.clean_words(t).alias("cw"), tx.shingles(t, 3).alias("sh"), tx.word_tokens(t).alias("tok"),
    ).collect()
    return {r["id"]: r for r in out}


@pytest.mark.parametrize("i", range(len(SAMPLES)))
def test_matches_python(rows, i):
    s, r = SAMPLES[i], rows[i]
    assert r["filled"] == bool(s.strip())
    assert r["words"] == s.split() and r["wc"] == len(s.split())
    assert r["clean"] == " ".join(re.sub(r"[^\w\s]", " ", s).lower().split())
    assert r["cw"] == r["clean"].split()
    tokens = re.findall(r"\b\w+\b", s.lower())
    assert r["tok"] == tokens
    assert set(r["sh"]) == {" ".join(tokens[k : k + 3]) for k in range(len(tokens) - 2)}


def test_causal_prefix_boundaries(spark):
    lengths = [1, 2, 44, 45, 46, 47]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in lengths], "n int, t string")
    got = {r["n"]: len(r["p"].split()) for r in df.select("n", tx.causal_prefix(F.col("t")).alias("p")).collect()}
    assert got == {n: n // 2 if n < 45 else n // 3 * 2 for n in lengths}


def test_mask_word_can_hit_an_empty_part(spark):
    df = spark.createDataFrame([("a  b", i) for i in range(3)], "t string, d long")
    got = {r["d"]: r["m"] for r in df.select("d", tx.mask_word(F.col("t"), F.col("d")).alias("m")).collect()}
    assert got == {0: "<mask>  b", 1: "a <mask> b", 2: "a  <mask>"}


@pytest.mark.parametrize("value", ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "a\nb\tc\rd", "nb sp", "rtl‏mark", "قلم", "\x01", "\U000e0001"])
def test_quoted_prints_like_python(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(tx.quoted(F.col("v")).alias("q")).first()["q"]
    assert got == repr(value)


def test_render_map(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "m string, n long")
    assert [r[0] for r in df.select(tx.render_map(["m", "n"])).collect()] == [str({"m": "x", "n": "1"}), str({"m": "None", "n": "2"})]
    assert df.select(tx.render_map([])).first()[0] == "{}"


def test_as_text(spark):
    df = spark.createDataFrame([("a", None)], "a string, b string")
    assert df.select(tx.join_as_text(F.col("a"), F.col("b"))).first()[0] == "a None"
    assert df.select(tx.as_text(F.col("b"), None)).first()[0] is None
