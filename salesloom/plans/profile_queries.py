"""Profiles of the canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.operators import features, kpis, profiling
from salesloom.plans.clean_queries import _DOUBLED, with_copies
from salesloom.plans.kpi_queries import rounded
from salesloom.plans.registry import query

COLUMNS = [
    "order_id", "line_no", "supp", "date", "status", "fulfilment", "ship_service_level", "sku",
    "style", "category", "size", "qty", "amount", "currency", "ship_state", "b2b", "promotion_ids",
]
NUMBERS = ["line_no", "supp", "qty", "amount"]
_GAPS = " + ".join(f"count(*) - count({c})" for c in COLUMNS)


@query(
    "prf01_prf02_shape",
    f"SELECT count(*) AS rows, {len(COLUMNS)} AS columns, {_GAPS} AS missing_cells FROM sales_raw",
)
def _(t):
    return profiling.shape(t.sales_raw)


@query(
    "prf03_missing_by_column",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM sales_raw""" for c in COLUMNS
    ),
)
def _(t):
    return profiling.missing_by_column(t.sales_raw)


@query(
    "prf03_missing_in_key_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM sales_raw"""
        for c in ("order_id", "date", "sku", "qty", "amount")
    ),
)
def _(t):
    return profiling.missing_by_column(t.sales_raw, ["order_id", "date", "sku", "qty", "amount"])


_TYPES = {"line_no": "int", "supp": "bigint", "date": "timestamp_ntz", "qty": "int",
          "amount": "double", "b2b": "boolean"}


@query(
    "prf04_column_info",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{_TYPES.get(c, 'string')}' AS type,
                   count({c}) AS non_null FROM sales_raw"""
        for i, c in enumerate(COLUMNS)
    ),
)
def _(t):
    return profiling.column_info(t.sales_raw)


_SPREAD = ["mean", "std", "min", "q25", "q50", "q75", "max"]


def _describe_sql(column: str, value: str | None = None) -> str:
    v = value or column
    return f"""SELECT '{column}' AS "column", count({v}) AS count,
        round(CAST(avg({v}) AS DOUBLE), 4) AS mean, round(CAST(stddev_samp({v}) AS DOUBLE), 4) AS std,
        round(CAST(min({v}) AS DOUBLE), 4) AS min, round(CAST(quantile_cont({v}, 0.25) AS DOUBLE), 4) AS q25,
        round(CAST(quantile_cont({v}, 0.5) AS DOUBLE), 4) AS q50,
        round(CAST(quantile_cont({v}, 0.75) AS DOUBLE), 4) AS q75,
        round(CAST(max({v}) AS DOUBLE), 4) AS max FROM sales_raw"""


@query("prf05_describe_numeric", " UNION ALL ".join(_describe_sql(c) for c in NUMBERS))
def _(t):
    return rounded(profiling.describe_numeric(t.sales_raw), 4, *_SPREAD)


_TEXTS = [c for c in COLUMNS if c not in NUMBERS + ["date"]]


def _frequency_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
        min_by(v, (-n, v)) AS top, max(n) AS freq
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM sales_raw
              WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("prf05_describe_numeric_split", " UNION ALL ".join(_describe_sql(c) for c in NUMBERS))
def _(t):
    return rounded(profiling.describe_numeric(t.sales_raw), 4, *_SPREAD)


@query(
    "prf06_describe_all",
    f"""SELECT "column", count, NULL::BIGINT AS "unique", NULL AS top, NULL::BIGINT AS freq,
               {', '.join(_SPREAD)}
        FROM ({' UNION ALL '.join([_describe_sql(c) for c in NUMBERS] + [_describe_sql('date', 'epoch(date)')])})
        UNION ALL
        SELECT "column", count, "unique", top, freq, {', '.join(f'NULL::DOUBLE AS {s}' for s in _SPREAD)}
        FROM ({' UNION ALL '.join(_frequency_sql(c) for c in _TEXTS)})""",
)
def _(t):
    return rounded(profiling.describe_all(t.sales_raw), 4, *_SPREAD)


@query(
    "prf07_duplicate_rows",
    f"""SELECT (SELECT count(*) FROM {_DOUBLED}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DOUBLED}))
               AS duplicates""",
)
def _(t):
    return profiling.duplicate_rows(with_copies(t))


_MONTHS = "(SELECT *, CAST(month(date) AS INT) AS month FROM sales_raw)"
_CORR = ["qty", "amount", "month", "line_no"]


@query(
    "prf08_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM {_MONTHS}"
        for a in _CORR for b in _CORR
    ),
)
def _(t):
    rows = features.calendar_columns(t.sales_raw).select(_CORR)
    return rounded(profiling.correlations(rows), 9, "r")


def _bin_sql(v: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(least(floor(({v} - {lo}) * {bins} / ({hi} - {lo})), {bins - 1}) AS INT)"


@query(
    "prf09_histogram",
    f"""WITH m AS (SELECT min(amount) AS lo, max(amount) AS hi FROM sales)
        SELECT {_bin_sql('amount', 'lo', 'hi', 50)} AS bin,
               round(lo + {_bin_sql('amount', 'lo', 'hi', 50)} * (hi - lo) / 50, 6) AS lower_edge,
               count(*) AS count
        FROM sales, m GROUP BY ALL""",
)
def _(t):
    return rounded(profiling.histogram(t.sales, "amount"), 6, "lower_edge")


@query(
    "prf10_density",
    """WITH c AS (SELECT amount AS v, count(*) AS n FROM sales GROUP BY amount),
       m AS (SELECT count(amount) AS total, min(amount) AS lo, max(amount) AS hi,
                    stddev_samp(amount) * pow(count(amount), -0.2) AS bw FROM sales),
       g AS (SELECT CAST(i AS INT) AS point, lo + i * (hi - lo) / 199 AS x, total, bw
             FROM range(200) r(i), m)
       SELECT point, round(x, 6) AS x,
              round(sum(n * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw)) / (total * bw * sqrt(2 * pi()))), 12)
                AS density
       FROM g, c GROUP BY point, x""",
)
def _(t):
    return rounded(rounded(profiling.density(t.sales, "amount"), 12, "density"), 6, "x")


@query(
    "prf11_box_plot",
    """WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, median(amount) AS q2,
                         quantile_cont(amount, 0.75) AS q3 FROM sales),
       b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
       SELECT round(max(q1), 6) AS q1, round(max(q2), 6) AS median, round(max(q3), 6) AS q3,
              min(amount) FILTER (WHERE amount BETWEEN lo AND hi) AS whisker_low,
              max(amount) FILTER (WHERE amount BETWEEN lo AND hi) AS whisker_high,
              count(*) FILTER (WHERE NOT amount BETWEEN lo AND hi) AS outliers
       FROM sales, b""",
)
def _(t):
    return rounded(profiling.box_plot(t.sales, "amount"), 6, "q1", "median", "q3")


@query(
    "prf11_outlier_rows",
    """WITH o AS (SELECT order_id, sum(amount) AS monetary FROM sales GROUP BY order_id),
       q AS (SELECT quantile_cont(monetary, 0.25) AS q1, quantile_cont(monetary, 0.75) AS q3 FROM o)
       SELECT order_id, round(monetary, 2) AS monetary FROM o, q
       WHERE monetary < q1 - 1.5 * (q3 - q1) OR monetary > q3 + 1.5 * (q3 - q1)""",
)
def _(t):
    totals = t.sales.groupBy("order_id").agg(F.sum("amount").alias("monetary"))
    return rounded(profiling.outlier_rows(totals, "monetary"), 2, "monetary")


@query(
    "prf12_joint_distribution",
    f"""WITH m AS (SELECT min(qty) AS a, max(qty) AS b, min(amount) AS c, max(amount) AS d FROM sales)
        SELECT {_bin_sql('CAST(qty AS DOUBLE)', 'a', 'b', 20)} AS x_bin,
               {_bin_sql('amount', 'c', 'd', 20)} AS y_bin, count(*) AS count
        FROM sales, m GROUP BY ALL""",
)
def _(t):
    return profiling.joint_histogram(t.sales, "qty", "amount")


_PAIRS = [("amount", "qty"), ("amount", "month"), ("qty", "month")]


@query(
    "prf12_pair_distributions",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS x, '{y}' AS y, {_bin_sql(f'CAST({x} AS DOUBLE)', 'a', 'b', 20)} AS x_bin,
                   {_bin_sql(f'CAST({y} AS DOUBLE)', 'c', 'd', 20)} AS y_bin, count(*) AS count
            FROM {_MONTHS}, (SELECT min({x}) AS a, max({x}) AS b, min({y}) AS c, max({y}) AS d FROM {_MONTHS})
            WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL"""
        for x, y in _PAIRS
    ),
)
def _(t):
    rows = features.calendar_columns(t.sales_raw).select("amount", "qty", "month")
    return profiling.pair_histograms(rows, ["amount", "qty", "month"])


def _overlap_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM sales) AS values_a,
        (SELECT count(DISTINCT {c}) FROM inventory) AS values_b,
        (SELECT count(*) FROM (SELECT {c} FROM sales WHERE {c} IS NOT NULL
                               INTERSECT SELECT {c} FROM inventory)) AS values_shared"""


@query("set01_shared_columns", " UNION ALL ".join(_overlap_sql(c) for c in ("category", "size")))
def _(t):
    return profiling.shared_column_overlap(t.sales, t.inventory)


@query(
    "srt02_preview",
    """SELECT order_id, line_no, sku, supp, date, amount FROM sales
       ORDER BY date, order_id, line_no, sku, supp LIMIT 20""",
)
def _(t):
    key = ["date", "order_id", "line_no", "sku", "supp"]
    return kpis.preview(t.sales, 20, key).select("order_id", "line_no", "sku", "supp", "date", "amount")
