"""Quality rules with host verdicts: rule failures per host, shrunk by an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.rows import ASCII_SPACE, fresh
from glyphmill.operators.skew import join_by_key
from glyphmill.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str] | list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that are found at least twice in the text (first included)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Equal hashes are checked on the words themselves; neighbours in hash order suffice unless hashes collide.
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), bool)
    for k in range(window):
        equal &= ids[left + k] == ids[right + k]
    repeated = np.zeros(n, bool)
    if equal.all():
        repeated[left] = repeated[right] = True
    else:
        seen: dict[tuple, int] = {}
        for i in np.union1d(left, right).tolist():
            key = tuple(ids[i : i + window].tolist())
            if key in seen:
                repeated[i] = repeated[seen[key]] = True
            seen.setdefault(key, i)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(repeated), 1)
    np.add.at(cover, np.flatnonzero(repeated) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of ``COUNTS`` for one text; words are runs of anything but ASCII white space."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def count_texts(text: Column) -> Column:
    """Struct of ``COUNTS`` for a text column."""

    @F.pandas_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS, dtype="int64")

    return counts(text)


def base_failed() -> Column:
    """The fixed rules: under 20 words, or over 30 percent of the words in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rule name -> does the document fail it (never NULL)."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "base": base_failed(),
        "word_length": (mean < 3) | (mean > 10),
        "symbols": F.col("n_symbols") * 10 > words,
        "dup_lines": F.col("n_dup_lines") * 10 > lines * 3,
    }


def host_rates(docs: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, fails, rate``: the failure rate of each host, shrunk towards the rate of all hosts.

    The hosts' rates are taken as draws of a beta distribution whose two parameters are fitted by
    moments over the hosts (weighted by documents); a host's rate is then its posterior mean
    ``(fails + a) / (n + a + b)``. A host with few documents stays near the overall rate. Where the
    hosts do not differ beyond chance, the prior is worth as much as the largest host.
    """
    per_host = materialize(docs.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("bigint")).alias("fails")))
    sums = per_host.agg(F.sum("fails"), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1)), F.max("n")).first()
    fails, n, squares, hosts, largest = (float(x or 0) for x in sums)
    mean = fails / n if n else 0.0
    spread = per_host.agg(F.sum(F.col("n") * F.pow(F.col("fails") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    chance = mean * (1 - mean)
    # Between-host variance: weighted spread less what sampling alone would give.
    between = max(0.0, (spread - (hosts - 1) * chance) / max(n - squares / n, 1e-9)) if n else 0.0
    strength = max(0.0, chance / between - 1) if between > 0 else largest
    strength = min(max(strength, 1.0), max(largest, 1.0))
    posterior = (F.col("fails") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return per_host.withColumn("rate", posterior)


def judge(counted: DataFrame, host: str, max_rate: float = 0.6) -> DataFrame:
    """``counted`` (rows with ``COUNTS``) with ``base_failed``, ``host_rate`` and ``kept``.

    A document fails if it fails any rule; failures are added up by host and shrunk. A host whose
    shrunk rate is above ``max_rate`` is rejected with all its documents; on any other host a
    document is rejected only by the base rules. NULL hosts form one host. NULL and
    empty texts have no words and fail. An empty table gives an empty table.
    """
    failing = F.lit(False)
    for fails in rules().values():
        failing = failing | fails
    counted = counted.drop("base_failed", "host_rate", "kept")
    key, failed, size = fresh(counted, "_host", "_fails", "_n")
    named = counted.withColumns({key: F.when(F.col(host).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(host))), failed: failing, "base_failed": base_failed()})
    rates = materialize(host_rates(named, key, failed)).select(key, F.col("n").alias(size), F.col("rate").alias("host_rate"))
    total = rates.agg(F.sum(size)).first()[0] or 0
    # Copies have equal counts: the id spreads them.
    judged = join_by_key(named, rates, [key], size, total, ["doc_id"] if "doc_id" in named.columns else COUNTS)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate)).drop(key, failed, size)
