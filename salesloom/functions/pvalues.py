"""p-values on already aggregated rows: one row per test, so one small UDF is enough."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship this module with the functions, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return out


def incomplete_beta(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta function at x, with ``rest`` = 1 - x."""
    if x <= 0.0 or rest <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    front = math.exp(a * math.log1p(-rest) + b * math.log(rest) - log_beta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def two_sided_t(t: float, df: float) -> float:
    """Two-sided p-value; from a million degrees of freedom on by the normal limit.

    Up there the beta function loses digits, while the corrected normal limit is
    off by less than 1e-11.
    """
    if df > 1e6:
        z = abs(t) * (1.0 - 0.25 / df) / math.sqrt(1.0 + t * t / (2.0 * df))
        return math.erfc(z / math.sqrt(2.0))
    whole = df + t * t
    return incomplete_beta(df / 2.0, 0.5, df / whole, t * t / whole)


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else two_sided_t(a, b) for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def chi2_one_df_p(chi2: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) else math.erfc(math.sqrt(v / 2.0)) for v in chi2], dtype="float64"
    )
