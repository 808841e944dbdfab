import re
from collections import Counter
from itertools import permutations

import pytest
from helpers import docs_frame, make_docs
from pyspark.sql import functions as F

from glyphmill.llm import audit


def plain_masks(rows, labels):
    """(part, mask, good, toxic) of every row, by the rules as written; rows are (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((t or "") == text and i is not None and doc_id is not None and i < doc_id for i, t, _ in rows)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
        out.append((lang or "", sum(f << i for i, f in enumerate(fails)), doc_id in good, doc_id in toxic))
    return out


def plain_audit(rows, labels):
    masks, out, removed_by = plain_masks(rows, labels), {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order):
                bit = 1 << "ABCDE".index(name)
                gone = [m for m in left if m[1] & bit]
                failing = [m for m in own if m[1] & bit]
                left = [m for m in left if not m[1] & bit]
                removed_by[part, name] += len(gone)
                out[part, "".join(order), step + 1] = (len(left), len(gone), len(failing) - len(gone), sum(m[1] == bit for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone))
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_rows():
    rows = [(r[0], r[1], r[2]) for r in make_docs()]
    rows += [(-5, rows[9][1], "de"), (500, rows[9][1], "fr"), (501, "", None), (-7, None, "fr"), (502, "SHOUT & more " * 300, "fr"), (-9, "SHOUT & more " * 300, None)]
    return rows + [(600 + i, rows[3][1], "en") for i in range(40)] + [(None, rows[3][1], "en")] * 9


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 70, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (-9, None, 1), (502, 1, None), (610, 1, 1)]


def write(spark, folder, rows, files):
    """One file after the other, so that batches bring smaller ids late."""
    for at in range(files):
        some = rows[at::files]
        spark.createDataFrame(some, "doc_id bigint, text string, lang string").withColumns({"mask": F.lit(1), "known": F.lit("x"), "part": F.lit(2), "spread": F.lit(3)}).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files, batches", [(1, 1), (6, 6), (6, 4)])
def test_stream_against_plain_python(spark, tmp_path, files, batches, monkeypatch):
    if files == batches:
        monkeypatch.setattr(audit, "GATHERED", 3)
        monkeypatch.setattr(audit, "TEXTS", 2)
    rows = sorted(odd_rows(), key=lambda r: -(r[0] or 0))
    folder = str(tmp_path / "documents.parquet")
    write(spark, folder, rows, files)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(0)).withColumn("spread", F.lit(5))
    counted = audit.counters(spark, folder, labels, batches=batches)
    assert {tuple(r[:4]): r.n for r in counted.collect()} == dict(Counter(plain_masks(rows, LABELS)))
    got = audit.interactions(counted).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == plain_audit(rows, LABELS)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_single_file_empty_table_and_no_labels(spark, tmp_path):
    docs, labels = docs_frame(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(f"{tmp_path}/one.parquet")
    assert audit.audit(spark, f"{tmp_path}/one.parquet", labels).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    docs.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    assert audit.audit(spark, f"{tmp_path}/none.parquet", labels).count() == 0
