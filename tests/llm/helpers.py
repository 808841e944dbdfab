"""Small documents with every odd case: NULLs, empty and long texts, copies, equal rows, clashing columns."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make_docs(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = ["  Shared LINE one that is longer than forty characters é ", "another shared line which is long enough to be seen, yes"]
    rows = []
    for i in range(n):
        lines = [sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared[i % 2].swapcase() if i % 6 == 0 else shared[i % 2])
        rows.append((i, "\n".join(lines), "en", ["a", "b", "c", None][i % 4] if i % 5 else "a", 7))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "b", 0), (n + 2, " \t\n ", "en", "b", 4), (n + 3, rows[0][1], "en", "a", 1)]
    rows += [(n + 4, sentence(5000), "en", "c", 1), rows[5], rows[5], (None, rows[7][1], "en", "a", 2), (None, "no id here", None, None, None)]
    return rows


def docs_frame(spark, rows=None):
    return spark.createDataFrame(make_docs() if rows is None else rows, DOC_SCHEMA).repartition(5)


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
