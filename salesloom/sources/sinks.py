"""Results to CSV and tables to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.functions.scalars import month_period


def write_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none"
) -> None:
    """One CSV part per task, each with a header; a folder reads back as one table.

    Blanks at the ends of values are kept. A compressed part (``snappy``) is read by one
    task, as it was written by one.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def register_tables(tables: dict[str, DataFrame], limit: int | None = None) -> list[str]:
    """Make the tables visible to SQL. All rows, unless a limit is asked for."""
    for name, df in tables.items():
        (df if limit is None else df.limit(limit)).createOrReplaceTempView(name)
    return list(tables)


def store_sales(sales: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cleaned sales as Parquet, one folder per month.

    The rebalance makes files of even size: a month with most of the rows is
    split over many tasks, and small months do not leave a file per task.
    """
    by_month = sales.withColumn("period", month_period(F.col("date")))
    by_month.hint("rebalance", "period").write.mode(mode).partitionBy("period").parquet(path)


def stored_sales(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored sales; ``schema`` is that of the sales, to which the month is added."""
    with_period = T.StructType([*schema.fields, T.StructField("period", T.StringType())])
    return spark.read.schema(with_period).parquet(path)
