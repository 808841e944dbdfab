"""Stacking heterogeneous sources into one corpus schema, and unions of corpora."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import text as tx
from glyphmill.operators.ordering import numbered
from glyphmill.operators.schema import require_columns

BATCH_ROWS = 1000


@dataclass(frozen=True)
class SourceSpec:
    """How to stack one table.

    ``row_key`` names and orders the rows (whole numbers, texts, dates, booleans or nested ones);
    every other column that is not metadata is text.
    """

    name: str
    table: DataFrame
    row_key: list[str]
    metadata: list[str] = field(default_factory=list)
    source_column: str | None = None
    text_columns: list[str] | None = None


def source_label(spec: SourceSpec) -> Column:
    """The configured per-row label if the table has it, else the source's name."""
    if spec.source_column and spec.source_column in spec.table.columns:
        return F.col(spec.source_column).cast("string")
    return F.lit(spec.name)


def metadata_map(names: list[str]) -> Column:
    """Metadata as a map of strings (NULL values become the text ``None``)."""
    if not names:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[tx.as_text(F.col(f"`{n}`")) for n in names]))


def sort_text(value: Column, kind: T.DataType) -> Column:
    """Text that sorts like ``value``: any number of keys of any of these kinds then make one key. NULL comes first."""
    if isinstance(kind, T.StructType):
        body = F.concat(F.lit(""), *[sort_text(value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.array_join(F.transform(value, lambda x: F.concat(F.lit("+"), sort_text(x, kind.elementType))), ""), F.lit(" "))
    elif isinstance(kind, T.IntegralType):
        # Shifted so that negative numbers sort as text as well.
        body = F.lpad((value.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.BooleanType)):
        # Shorter texts come before longer ones that begin with them.
        body = F.concat(value.cast("string"), F.lit("\0"))
    else:
        raise ValueError(f"a row key cannot be of type {kind.simpleString()}")
    return F.when(value.isNull(), "0").otherwise(F.concat(F.lit("1"), body))


def stack_source(spec: SourceSpec, source_no: int = 0, keep_map: bool = False) -> DataFrame:
    """Rows ``(split, text, dataset_source, metadata, ord)``, one per input row and text column.

    ``ord`` is the row's position in the stacked corpus: source, batch of 1,000 rows, column, row.
    A table without a ``split`` column is all ``train``.
    """
    df = spec.table
    require_columns(df, [*spec.metadata, *spec.row_key, *(spec.text_columns or [])])
    aside = {*spec.metadata, *spec.row_key, "split"}
    texts = spec.text_columns or [c for c in df.columns if c not in aside]
    if not texts:
        raise ValueError(f"source {spec.name} has no text column")
    key = F.concat(*[sort_text(F.col(f"`{k}`"), df.schema[k].dataType) for k in spec.row_key])
    batch = F.lit(0).cast("bigint")
    if len(texts) > 1:
        # Several text columns alternate per batch of rows, counted in the order of the keys.
        df = numbered(df.withColumn("_key", key), F.col("_key"), name="_row_no")
        key, batch = F.col("_key"), F.expr(f"_row_no div {BATCH_ROWS}")
    wide = df.select(
        F.coalesce(F.col("split"), F.lit("train")).alias("_split") if "split" in df.columns else F.lit("train").alias("_split"),
        source_label(spec).alias("_source"),
        (metadata_map(spec.metadata) if keep_map else tx.render_map(spec.metadata)).alias("_metadata"),
        batch.alias("_batch"), key.alias("_key"),
        *[F.col(f"`{c}`").cast("string").alias(f"_t{i}") for i, c in enumerate(texts)],
    )
    if len(texts) == 1:
        long = wide.withColumnRenamed("_t0", "text").withColumn("_col", F.lit(0))
    else:
        long = wide.unpivot(
            ["_split", "_source", "_metadata", "_batch", "_key"], [f"_t{i}" for i in range(len(texts))], "_name", "text"
        ).withColumn("_col", F.substring("_name", 3, 10).cast("int"))
    place = F.struct(
        F.lit(source_no).alias("source_no"), F.col("_batch").alias("batch"), F.col("_col").alias("col"), F.col("_key").alias("key")
    )
    return long.select(
        F.col("_split").alias("split"), "text", F.col("_source").alias("dataset_source"),
        F.col("_metadata").alias("metadata"), place.alias("ord"),
    )


def concat_splits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by name with NULLs for columns only one side has; splits pass through."""
    return first.unionByName(second, allowMissingColumns=True)


def combine_sources(specs: list[SourceSpec], first_no: int = 0) -> DataFrame:
    """Stack every source and union them; earlier sources come first in ``ord``."""
    if not specs:
        raise ValueError("no source given")
    return reduce(concat_splits, [stack_source(s, first_no + i) for i, s in enumerate(specs)])


def mix(df: DataFrame, label: str, mixes: dict[str, dict[str, int]]) -> DataFrame:
    """Rows of each named mix: a source's rows as often as the mix asks for (column ``mix``)."""
    plan = F.create_map(*[F.lit(x) for kv in _mix_entries(mixes).items() for x in (kv[0], F.array(*[F.lit(m) for m in kv[1]]))])
    return df.withColumn("mix", F.explode(F.element_at(plan, F.col(label))))


def _mix_entries(mixes: dict[str, dict[str, int]]) -> dict[str, list[str]]:
    entries: dict[str, list[str]] = {}
    for name, parts in mixes.items():
        for source, copies in parts.items():
            entries.setdefault(source, []).extend([name] * copies)
    return entries
