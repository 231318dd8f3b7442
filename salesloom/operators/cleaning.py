"""Projections, filters and coercions; each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.contracts import canonical_name
from salesloom.functions.scalars import finite_or_zero, to_number, to_timestamp


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds a dot or a blank."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def canonical_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[canonical_name(c) for c in df.columns])


def with_original_headers(df: DataFrame, originals: list[str]) -> DataFrame:
    """Undo :func:`canonical_headers` for users of the original names."""
    back = {canonical_name(o): o.strip() for o in originals}
    return df.toDF(*[back.get(c, c) for c in df.columns])


def drop_columns(df: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if strict and absent:
        raise ValueError(f"no such columns: {absent}")
    return df.select([quoted(c) for c in df.columns if c not in names])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.toDF(*[names.get(c, c) for c in df.columns])


def keep_existing(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def missing_tokens_to_null(df: DataFrame, tokens: list[str]) -> DataFrame:
    return df.select(
        [F.when(~quoted(c).isin(tokens), quoted(c)).alias(c) for c in df.columns]
    )


def _coerced(column: Column, target: str) -> Column:
    if target == "timestamp":
        return to_timestamp(column)
    if target == "number":
        return to_number(column)
    if target == "integer":
        return to_number(column).try_cast("bigint")
    if target == "boolean":
        text = F.lower(column)
        return F.when(text == "true", True).when(text == "false", False)
    raise ValueError(f"unknown target type {target}")


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to their contract types; what does not parse becomes NULL."""
    return df.select(
        [
            _coerced(quoted(c), types[c]).alias(c) if c in types else quoted(c)
            for c in df.columns
        ]
    )


def require_clean(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Strict form of :func:`coerce`: a value that does not parse fails the job."""
    out = []
    for c in df.columns:
        if c in types:
            bad = quoted(c).isNotNull() & _coerced(quoted(c), types[c]).isNull()
            message = F.concat(F.lit(f"cannot read {c}: "), quoted(c))
            out.append(
                F.when(bad, F.raise_error(message)).otherwise(_coerced(quoted(c), types[c])).alias(c)
            )
        else:
            out.append(quoted(c))
    return df.select(out)


def text_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categoricals as text, with missing values as a category of their own."""
    return df.withColumns({c: F.coalesce(quoted(c).cast("string"), F.lit("nan")) for c in columns})


def align_to(df: DataFrame, features: list[str]) -> DataFrame:
    """Exactly the wanted columns in the wanted order; absent ones are 0."""
    return df.select(
        [quoted(c) if c in df.columns else F.lit(0).alias(c) for c in features]
    )


def date_range(df: DataFrame, column: str = "date", start=None, end=None) -> DataFrame:
    """Rows from start to end, both included; without bounds all rows.

    A plain date as ``end`` means its midnight. Where the table is stored by
    month (column ``period``), only the months of the range are read.
    """
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        limit = F.lit(str(bound)).cast("timestamp_ntz")
        df = df.where(F.col(column) >= limit if low else F.col(column) <= limit)
        if "period" in df.columns:
            month = F.date_format(limit, "yyyy-MM")
            df = df.where(F.col("period") >= month if low else F.col("period") <= month)
    return df


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(quoted(c).cast("double")) for c in columns})
