"""CSV tables of a retail export: all text on read, then the table contract.

Nothing is inferred from the data, so reading never needs a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesloom.contracts import JUNK_COLUMNS, LEDGER_COLUMNS, MISSING_TOKENS, REQUIRED, TYPES
from salesloom.operators import cleaning


def read_text_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text, missing-value tokens as NULL.

    Every file of a folder must have the same header in the same order, else the
    read fails: Spark compares each header with the first one. It cannot where the
    header has blank names; the headers are then compared file by file beforehand.
    ``multiline`` is for free text with line breaks inside quotes. Such a file
    cannot be split, so it stays off for fact tables.
    """
    def read(source: str | list[str], **options) -> DataFrame:
        reader = spark.read.options(header=True, multiLine=multiline, encoding="UTF-8", escape='"')
        return reader.options(**options).csv(source)

    df = read(path)
    if any(c == f"_c{i}" for i, c in enumerate(df.columns)):
        for file in df.inputFiles():
            if read(file).columns != df.columns:
                raise ValueError(f"{file} has other columns than the first file of {path}")
    else:
        df = read(path, enforceSchema=False)
    names = [
        f"Unnamed: {i}" if c == f"_c{i}" else c for i, c in enumerate(df.columns)
    ]
    return cleaning.missing_tokens_to_null(df.toDF(*names), MISSING_TOKENS)


def _prepared(spark: SparkSession, path: str, table: str, multiline: bool = False) -> DataFrame:
    df = cleaning.strip_headers(read_text_csv(spark, path, multiline))
    return cleaning.drop_columns(df, JUNK_COLUMNS[table])


def _required(df: DataFrame, table: str) -> DataFrame:
    missing = [c for c in REQUIRED[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return df


def clean_sales(df: DataFrame) -> DataFrame:
    """Text rows to clean sales.

    The order matters: rows without an amount go first, then equal rows are
    merged while they are still text, then types are set. An amount that is
    there but cannot be read stays in the table as NULL.
    """
    df = _required(cleaning.canonical_headers(df), "sales")
    df = df.dropna(subset=["amount"]).dropDuplicates()
    return cleaning.coerce(df, TYPES["sales"])


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    return clean_sales(_prepared(spark, path, "sales"))


def load_international(spark: SparkSession, path: str) -> DataFrame:
    return cleaning.canonical_headers(_prepared(spark, path, "international"))


def load_expenses(spark: SparkSession, path: str, keep_index: bool = False) -> DataFrame:
    df = read_text_csv(spark, path).toDF(*LEDGER_COLUMNS)
    if not keep_index:
        df = cleaning.drop_columns(df, JUNK_COLUMNS["expenses"])
    return cleaning.coerce(cleaning.canonical_headers(df), TYPES["expenses"])


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    df = _required(cleaning.canonical_headers(_prepared(spark, path, "inventory")), "inventory")
    return cleaning.coerce(df, TYPES["inventory"])


def load_warehouse(spark: SparkSession, path: str) -> DataFrame:
    """Price and procedure comparison: a small sheet of free text."""
    return _prepared(spark, path, "warehouse", multiline=True)


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A price list; only profiled, so prices stay text."""
    return cleaning.strip_headers(read_text_csv(spark, path))


LOADERS = {
    "sales": load_sales,
    "international": load_international,
    "expenses": load_expenses,
    "inventory": load_inventory,
    "warehouse": load_warehouse,
}


def load_and_clean(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The named tables, cleaned. ``paths`` maps table name to CSV file or folder."""
    return {name: LOADERS[name](spark, path) for name, path in paths.items()}
