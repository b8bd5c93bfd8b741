"""Column-name contracts and safe coercion."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Raise on missing columns; costs nothing because it only reads the schema."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def normalized_name(name: str) -> str:
    """Lower-case name without punctuation, used to match drifting vendor headers."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def find_column(df: DataFrame, aliases: Sequence[str], required: bool = True) -> str | None:
    """First alias present in the table, compared by :func:`normalized_name`."""
    by_name = {normalized_name(c): c for c in df.columns}
    for alias in aliases:
        match = by_name.get(normalized_name(alias))
        if match is not None:
            return match
    if required:
        raise ValueError(f"None of the columns {list(aliases)} is present.")
    return None


def project_aliases(df: DataFrame, mapping: dict[str, Sequence[str]]) -> DataFrame:
    """Rename the first matching alias of each target column; absent targets become NULL."""
    picked = []
    for target, aliases in mapping.items():
        source = find_column(df, aliases, required=False)
        picked.append((F.col(source) if source else F.lit(None).cast("double")).alias(target))
    return df.select(*picked)


def finite(value: Column | str) -> Column:
    """NULL for NaN and infinities: every measure uses NULL as its only missing marker."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_double(value: Column | str) -> Column:
    """Text or number to DOUBLE, NULL when it cannot be read."""
    c = F.col(value) if isinstance(value, str) else value
    return c.try_cast("double")


def to_timestamp(value: Column | str) -> Column:
    """Text to TIMESTAMP, NULL when it cannot be read; offset-free text means UTC."""
    c = F.col(value) if isinstance(value, str) else value
    return F.try_to_timestamp(c.cast("string"))


def clean_zero(value: Column) -> Column:
    """Turn -0.0 into 0.0 so equal values also hash alike."""
    return value + F.lit(0.0)


def at_least(value: Column, low: Column | float) -> Column:
    """Lower clip that keeps NULL; ``greatest`` alone would turn a missing value into the bound."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low) if isinstance(low, float) else low))


def at_most(value: Column, high: Column | float) -> Column:
    """Upper clip that keeps NULL."""
    return F.when(value.isNotNull(), F.least(value, F.lit(high) if isinstance(high, float) else high))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every DOUBLE column of a report."""
    return df.select(
        *[
            clean_zero(F.round(F.col(f"`{f.name}`"), digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
