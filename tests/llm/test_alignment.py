import hashlib
from collections import Counter

import pytest
import sentencepiece
from helpers import docs_frame, make_docs
from tokenizers import Tokenizer

from glyphmill.llm import alignment, queries

ODD = [
    "two  spaces", " leading", "trailing ", "line\nend", "line \n end", "\nfirst", "\n", " ", "tab\there", "a\u00a0b", "\u2581mark", "x \u2581", "naïve café",
    "<|endoftext|> and <s> </s> <unk>", "日本語 テキスト", "🙂 🙂🙂", "don't 'tis it's", "nul \0 here", "\x1c sep \x1c", "aaaa" * 2000, "=" * 700 + "-" * 900, "\u3000wide", "12345 67,890",
    "a b a b a b", "é" * 300, "CRLF\r\nline", "x\u2028y \u2029",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)


def plain(rows, libraries):
    """The contract word by word, token by token; rows are (id, text)."""
    a, b = libraries
    letters = alignment.byte_letters()
    texts = []
    for _, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = []
                for tokens in (bytes_a, bytes_b):
                    at, out = 0, []
                    for t in tokens:
                        at += len(t)
                        out.append(at)
                    ends.append(out)
                both = set(ends[0]) & set(ends[1])
                left, right = [], []
                i = j = 0
                for cut in sorted(both):
                    while i < len(ids_a) and ends[0][i] <= cut:
                        left.append(ids_a[i])
                        i += 1
                    while j < len(ids_b) and ends[1][j] <= cut:
                        right.append(ids_b[j])
                        j += 1
                    groups.append((left, right))
                    left, right = [], []
        texts.append(groups)
    held = Counter()
    links = []
    for groups in texts:
        own = Counter()
        for left, right in groups:
            ca, cb = Counter(left), Counter(right)
            for x, n in ca.items():
                for y, m in cb.items():
                    own[x, y] += n * m
        links.append(own)
        held.update(own.keys())
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), groups, own in zip(rows, texts, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
                    sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


def run(spark, docs):
    got = alignment.align(docs, queries.BYTE_TOKENIZER, queries.TOKENIZER, keep=["doc_id"])
    return [tuple(r) for r in got.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_odd_texts_against_plain_python(spark, libraries, hot_keys, block, monkeypatch):
    # Tasks read the module's own values, so a small block is made by long texts as well.
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = [(r[0], r[1]) for r in make_docs()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, ODD[0])] * 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert sorted(map(repr, run(spark, docs))) == sorted(map(repr, plain(rows, libraries)))


def test_remembered_stretches_change_nothing(libraries, monkeypatch):
    aligner = alignment.Aligner(*[open(p, "rb").read() for p in (queries.BYTE_TOKENIZER, queries.TOKENIZER)])
    texts = [r[1] for r in make_docs()] + ODD
    whole = alignment.Aligner(*aligner.files)
    whole.by_stretch = False
    monkeypatch.setattr(alignment, "REMEMBER", 0)
    monkeypatch.setattr(alignment, "PAIRED", 3)
    for _ in range(2):
        for some in (texts[:7], texts):
            for got, want in zip(aligner.texts(some), whole.texts(some)):
                assert list(map(repr, got)) == list(map(repr, want))


def test_whole_query_against_plain_python(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(plain(rows, libraries))


def test_empty_table_and_clashing_columns(spark):
    docs = docs_frame(spark)
    assert alignment.align(docs.limit(0), queries.BYTE_TOKENIZER, queries.TOKENIZER).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS block", "'x' AS codes", "2 AS n_a", "3 AS row", "4 AS kind")
    out = alignment.align(clash, queries.BYTE_TOKENIZER, queries.TOKENIZER)
    assert out.select("row.*").columns == ["doc_id", "block", "codes", "n_a", "row", "kind"]
    assert out.count() == docs.count() and {tuple(r) for r in out.select("row.block", "row.n_a", "row.row").collect()} == {(1, 2, 3)}
