"""Column checks and schema operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the table; it has {df.columns}")


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    require_columns(df, names)
    return df.drop(*names)


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*names)


def with_split(df: DataFrame, id_col: str, every: int = 100) -> DataFrame:
    """Name the last row of every hundred ``test`` and the others ``train``."""
    test = F.pmod(F.col(id_col), F.lit(every)) == every - 1
    return df.withColumn("split", F.when(test, "test").otherwise("train"))
