"""Welch's t-test and the chi-square test of independence as one aggregate each.

Both take optional ``by`` columns and then run one test per group in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.pvalues import chi2_one_df_p, t_test_p
from salesloom.functions.scalars import is_cancelled


def welch_statistics(
    df: DataFrame, flag: str = "b2b", value: str = "amount", by: list[str] | None = None
) -> DataFrame:
    """t and degrees of freedom for the mean of ``value`` where flag is true or false.

    The unit is the row. Groups where a side has fewer than two values have no test.
    """
    def side(side_flag: bool, f):
        return f(F.when(F.col(flag) == side_flag, F.col(value)))

    moments = df.groupBy(*(by or [])).agg(
        side(True, F.count).alias("n_true"),
        side(False, F.count).alias("n_false"),
        side(True, F.avg).alias("mean_true"),
        side(False, F.avg).alias("mean_false"),
        side(True, F.var_samp).alias("var_true"),
        side(False, F.var_samp).alias("var_false"),
    )
    a = F.col("var_true") / F.col("n_true")
    b = F.col("var_false") / F.col("n_false")
    t = F.try_divide(F.col("mean_true") - F.col("mean_false"), F.sqrt(a + b))
    dof = F.try_divide(
        (a + b) * (a + b),
        a * a / (F.col("n_true") - 1) + b * b / (F.col("n_false") - 1),
    )
    enough = (F.col("n_true") > 1) & (F.col("n_false") > 1)
    return moments.where(enough).select(
        *(by or []),
        "n_true", "n_false", "mean_true", "mean_false",
        t.alias("t_statistic"),
        dof.alias("df"),
    )


def welch_t_test(
    df: DataFrame, flag: str = "b2b", value: str = "amount", by: list[str] | None = None
) -> DataFrame:
    """The rounded test result; significance is judged on the exact p-value."""
    tested = welch_statistics(df, flag, value, by).withColumn(
        "p", t_test_p(F.col("t_statistic"), F.col("df"))
    )
    return tested.select(
        *(by or []),
        F.bround("t_statistic", 4).alias("t_statistic"),
        F.bround("p", 6).alias("p_value"),
        F.bround("mean_true", 2).alias("mean_true"),
        F.bround("mean_false", 2).alias("mean_false"),
        (F.col("p") < 0.05).alias("significant"),
    )


def contingency(
    df: DataFrame, rows: str = "fulfilment", status: str = "status", by: list[str] | None = None
) -> DataFrame:
    """Cancelled and active rows per value; a missing value counts as ``Unknown``."""
    hit = is_cancelled(F.col(status))
    return df.groupBy(*(by or []), F.coalesce(rows, F.lit("Unknown")).alias(rows)).agg(
        F.count(F.when(hit, 1)).alias("cancelled"),
        F.count(F.when(~hit, 1)).alias("active"),
    )


def chi_square_statistics(
    df: DataFrame, rows: str = "fulfilment", status: str = "status", by: list[str] | None = None
) -> DataFrame:
    """Chi-square with continuity correction, for tables of exactly two by two."""
    keys = by or []
    cells = contingency(df, rows, status, by)
    # The two rows of a table side by side; other table shapes drop out here.
    row = F.struct(rows, "cancelled", "active")
    table = (
        cells.groupBy(*keys)
        .agg(
            F.count("*").alias("values"),
            F.min(row).alias("r1"),
            F.max(row).alias("r2"),
            F.sum("cancelled").alias("c1"),
            F.sum("active").alias("c2"),
        )
        .where((F.col("values") == 2) & (F.col("c1") > 0) & (F.col("c2") > 0))
    )
    total = (F.col("c1") + F.col("c2")).cast("double")
    chi2 = F.lit(0.0)
    for r in ("r1", "r2"):
        row_sum = F.col(f"{r}.cancelled") + F.col(f"{r}.active")
        for c, name in (("c1", "cancelled"), ("c2", "active")):
            expected = row_sum * F.col(c) / total
            gap = F.abs(F.col(f"{r}.{name}") - expected)
            gap = gap - F.least(gap, F.lit(0.5))
            chi2 = chi2 + gap * gap / expected
    return table.select(*keys, chi2.alias("chi2"))


def chi_square_test(
    df: DataFrame, rows: str = "fulfilment", status: str = "status", by: list[str] | None = None
) -> DataFrame:
    tested = chi_square_statistics(df, rows, status, by).withColumn(
        "p", chi2_one_df_p(F.col("chi2"))
    )
    return tested.select(
        *(by or []),
        F.bround("chi2", 4).alias("chi2"),
        F.bround("p", 6).alias("p_value"),
        (F.col("p") < 0.05).alias("significant"),
    )


def hypothesis_tests(sales: DataFrame) -> dict[str, DataFrame]:
    """Both standard tests; a test that does not apply has no row."""
    return {
        "B2B vs B2C order value": welch_t_test(sales),
        "Fulfilment vs cancellation": chi_square_test(sales),
    }
