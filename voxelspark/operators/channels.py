"""Vector maps as scalar maps and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_channels(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """The entries of an array column as columns of their own, in order; null where the array is null or shorter. Other columns are kept."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns if c != vector}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)])


def merge_channels(df: DataFrame, parts: list[str], vector: str) -> DataFrame:
    """One array column of scalar and array columns, one behind the other; null where a part is null."""
    types = dict(df.dtypes)
    each = [F.col(c) if types[c].startswith("array") else F.array(c) for c in parts]
    whole = F.flatten(F.array(*[e.cast("array<double>") for e in each]))
    there = ~F.array_contains(F.array(*[F.col(c).isNull() for c in parts]), True)
    return df.select(*[c for c in df.columns if c not in parts], F.when(there, whole).alias(vector))
