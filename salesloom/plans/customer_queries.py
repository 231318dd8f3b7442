"""Rolling means, features, RFM, ranks, segments and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.functions import ordered
from salesloom.operators import features, rfm, segments, stats_tests
from salesloom.operators.training import random_rows
from salesloom.plans.kpi_queries import rounded
from salesloom.plans.registry import query
from salesloom.workspace import file_state, remembered, stage

KEY = ["order_id", "line_no", "sku", "supp"]
KEYS = ", ".join(KEY)
ORDER = "date NULLS LAST, order_id, line_no, sku, supp"


_ROLLING = f"""SELECT {KEYS}, category, date, amount,
               round(avg(amount) OVER (PARTITION BY category ORDER BY {ORDER}
                     ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS revenue_7d_ma
        FROM sales"""


@query("win01_rolling_revenue", _ROLLING)
def _(t):
    rows = t.sales.select(*KEY, "category", "date", "amount")
    rolled = features.rolling_revenue(rows, KEY)
    return rounded(rolled, 6, "revenue_7d_ma")


# The name of the former second form; there is one plan now.
@query("win01_rolling_revenue_split", _ROLLING)
def _(t):
    rows = t.sales.select(*KEY, "category", "date", "amount")
    return rounded(features.rolling_revenue(rows, KEY), 6, "revenue_7d_ma")


@query(
    "win01_rolling_revenue_with_gaps",
    f"""SELECT {KEYS}, cat AS category, date, amount,
               CASE WHEN cat IS NOT NULL THEN
                 round(avg(amount) OVER (PARTITION BY cat ORDER BY {ORDER}
                       ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) END AS revenue_7d_ma
        FROM (SELECT *, CASE WHEN line_no <> 2 THEN category END AS cat FROM sales_raw)""",
)
def _(t):
    rows = t.sales_raw.select(
        *KEY, F.when(F.col("line_no") != 2, F.col("category")).alias("category"), "date", "amount"
    )
    return rounded(features.rolling_revenue(rows, KEY), 6, "revenue_7d_ma")


@query(
    "srt03_date_order",
    f"""SELECT {KEYS}, date, row_number() OVER (ORDER BY {ORDER}) - 1 AS position FROM sales""",
)
def _(t):
    rows = t.sales.select(*KEY, "date").withColumn(
        "_key", F.struct(F.col("date"), F.col("order_id"), F.col("line_no"), F.col("sku"), F.col("supp"))
    )
    rows = rows.withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    placed = ordered.total_before(rows, ["_all"], "_key", {"_one": "position"})
    return placed.select(*KEY, "date", F.col("position").cast("bigint").alias("position"))


FEATURES = f"""
f AS (SELECT *, CAST(isodow(date) - 1 AS INT) AS day_of_week,
             CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(month(date) AS INT) AS month,
             CASE WHEN qty > 0 THEN amount / qty ELSE 0 END AS price_per_unit,
             CAST(promotion_ids IS NOT NULL AS INT) AS has_promotion,
             CAST(amount > (SELECT quantile_cont(amount, 0.75) FROM sales) AS INT) AS is_high_value,
             avg(amount) OVER (PARTITION BY category ORDER BY {ORDER}
                               ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS revenue_7d_ma,
             CAST(status ILIKE '%cancel%' AS INT) AS cancelled
      FROM sales)"""


@query(
    "ml01_engineered_features",
    f"""WITH {FEATURES.strip()}
        SELECT {KEYS}, category, date, qty, amount, fulfilment, ship_service_level, b2b,
               day_of_week, is_weekend, month, round(price_per_unit, 9) AS price_per_unit,
               has_promotion, is_high_value, round(revenue_7d_ma, 6) AS revenue_7d_ma, cancelled
        FROM f""",
)
def _(t):
    columns = [*KEY, "category", "date", "qty", "amount", "fulfilment", "ship_service_level", "b2b"]
    rows = t.sales.select(*columns, "promotion_ids", "status")
    fe = features.engineer_features(rows, KEY)
    out = fe.select(
        *columns, "day_of_week", "is_weekend", "month", "price_per_unit", "has_promotion",
        "is_high_value", "revenue_7d_ma", "cancelled",
    )
    return rounded(rounded(out, 9, "price_per_unit"), 6, "revenue_7d_ma")


@query(
    "agg26_upper_quartile",
    "SELECT round(quantile_cont(amount, 0.75), 6) AS quantile FROM sales",
)
def _(t):
    return rounded(ordered.quantile(t.sales, "amount", 0.75), 6, "quantile")


@query(
    "agg26_quantiles_split",
    """SELECT q.c AS "column", q.p AS prob, round(CASE q.c
           WHEN 'amount' THEN (SELECT quantile_cont(amount, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) FROM sales)[q.i]
           ELSE (SELECT quantile_cont(qty, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) FROM sales)[q.i] END, 6)
           AS quantile
       FROM (SELECT c, i, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0][i]::DOUBLE AS p
             FROM (VALUES ('amount'), ('qty')) v(c), range(1, 8) r(i)) q""",
)
def _(t):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = ordered.quantiles(t.sales, ["amount", "qty"], probs)
    return rounded(out, 6, "quantile")


@query(
    "agg27_medians",
    f"""WITH {FEATURES.strip()}
        SELECT round(median(price_per_unit), 6) AS price_per_unit,
               round(median(revenue_7d_ma), 6) AS revenue_7d_ma FROM f""",
)
def _(t):
    rows = t.sales.select(*KEY, "category", "date", "qty", "amount", "promotion_ids", "status")
    columns = ["price_per_unit", "revenue_7d_ma"]
    fe = features.engineer_features(rows, KEY)
    medians = ordered.quantiles(fe, columns, [0.5])
    return medians.agg(
        *[F.round(F.max(F.when(F.col("column") == c, F.col("quantile"))), 6).alias(c) for c in columns]
    )


def _rfm_sql(having: str = "HAVING sum(amount) > 0", key: str = "order_id") -> str:
    return f"""rfm AS (
      SELECT {key}, CAST(floor((epoch((SELECT max(date) FROM sales)) + 86400 - epoch(max(date))) / 86400)
                         AS INT) AS recency,
             count({key}) AS frequency, sum(amount) AS monetary
      FROM sales WHERE {key} IS NOT NULL GROUP BY {key} {having})"""


@query(
    "agg22_rfm_per_order",
    f"WITH {_rfm_sql()} SELECT order_id, recency, frequency, round(monetary, 2) AS monetary FROM rfm",
)
def _(t):
    return rounded(rfm.compute_rfm(t.sales), 2, "monetary")


@query(
    "agg22_rfm_per_state_all_keys",
    f"""WITH {_rfm_sql('', 'ship_state')}
        SELECT ship_state, recency, frequency, round(monetary, 2) AS monetary FROM rfm""",
)
def _(t):
    return rounded(rfm.compute_rfm(t.sales, "ship_state", positive_only=False), 2, "monetary")


def _avg_rank(measure: str, order: str) -> str:
    return f"""rank() OVER (ORDER BY {measure} {order})
               + (count(*) OVER (PARTITION BY {measure}) - 1) / 2.0"""


# Sums of money are rounded to cents before they are ranked, so that both sides see
# the same ties.
_RANKED = f"""{_rfm_sql('')}, c AS (SELECT order_id, recency, frequency, round(monetary, 2) AS monetary FROM rfm),
  k AS (SELECT *, CAST({_avg_rank('recency', 'DESC')} AS DOUBLE) AS r_rank,
               CAST({_avg_rank('frequency', 'ASC')} AS DOUBLE) AS f_rank,
               CAST({_avg_rank('monetary', 'ASC')} AS DOUBLE) AS m_rank FROM c)"""


def _cents(t):
    return rounded(rfm.compute_rfm(t.sales, positive_only=False), 2, "monetary")


@query("win03_average_ranks", f"WITH {_RANKED} SELECT order_id, r_rank, f_rank, m_rank FROM k")
def _(t):
    return rfm.with_rfm_scores(_cents(t)).select("order_id", "r_rank", "f_rank", "m_rank")


@query("win03_average_ranks_split", f"WITH {_RANKED} SELECT order_id, r_rank, f_rank, m_rank FROM k")
def _(t):
    return rfm.with_rfm_scores(_cents(t)).select("order_id", "r_rank", "f_rank", "m_rank")


@query("win04_rfm_score", f"WITH {_RANKED} SELECT *, r_rank + f_rank + m_rank AS rfm_score FROM k")
def _(t):
    return rfm.with_rfm_scores(_cents(t))


_STATS = """st AS (SELECT avg(ln(1 + recency)) AS mr, stddev_pop(ln(1 + recency)) AS sr,
                          avg(ln(1 + frequency)) AS mf, stddev_pop(ln(1 + frequency)) AS sf,
                          avg(ln(1 + monetary)) AS mm, stddev_pop(ln(1 + monetary)) AS sm FROM rfm)"""
_SCALED = f"""{_rfm_sql()}, {_STATS}, z AS (
      SELECT rfm.*, (ln(1 + recency) - mr) / sr AS z_recency, (ln(1 + frequency) - mf) / sf AS z_frequency,
             (ln(1 + monetary) - mm) / sm AS z_monetary FROM rfm, st)"""


@query(
    "ml04_scaled_rfm",
    f"""WITH {_SCALED} SELECT order_id, round(z_recency, 8) AS z_recency,
        round(z_frequency, 8) AS z_frequency, round(z_monetary, 8) AS z_monetary FROM z""",
)
def _(t):
    out = segments.scale_rfm(rfm.compute_rfm(t.sales)).select("order_id", *segments.SCALED)
    return rounded(out, 8, *segments.SCALED)


# Centres to check the assignment and the labels with; the fitted ones are in ml21.
CENTRES = [[0.713, 0.391, 0.317], [-2.137, 0.173, 0.239], [0.291, -1.637, -1.871], [-0.437, 0.619, 0.553]]

_DISTANCES = ",\n".join(
    f"(z_recency - ({a})) * (z_recency - ({a})) + (z_frequency - ({b})) * (z_frequency - ({b}))"
    f" + (z_monetary - ({c})) * (z_monetary - ({c})) AS d{i}"
    for i, (a, b, c) in enumerate(CENTRES)
)
_CENTRE_ROWS = " UNION ALL ".join(
    f"SELECT '{i}' AS segment, {a} AS a, {b} AS b, {c} AS c" for i, (a, b, c) in enumerate(CENTRES)
)
_LABEL_CASE = """CASE WHEN f > 3 AND m > 5000 THEN 'Champions' WHEN r < 30 AND f > 1 THEN 'Loyal Customers'
      WHEN r < 60 AND m > 2000 THEN 'Potential Loyalists' WHEN m > 3000 AND f < 2 THEN 'Big Spenders'
      WHEN r > 180 THEN 'At Risk' WHEN r > 90 THEN 'Needs Attention' WHEN f > 5 THEN 'Frequent Buyers'
      ELSE 'Segment ' || segment END"""


def _segments_sql(back: str = "exp({}) - 1") -> str:
    return f"""{_SCALED},
    dist AS (SELECT *, {_DISTANCES} FROM z),
    seg AS (SELECT *, CASE least(d0, d1, d2, d3) WHEN d0 THEN '0' WHEN d1 THEN '1' WHEN d2 THEN '2'
                      ELSE '3' END AS segment FROM dist),
    centres AS (SELECT segment, {back.format('a * sr + mr')} AS r, {back.format('b * sf + mf')} AS f,
                       {back.format('c * sm + mm')} AS m FROM ({_CENTRE_ROWS}), st),
    labels AS (SELECT segment, r, f, m, {_LABEL_CASE} AS segment_label FROM centres),
    s AS (SELECT seg.*, segment_label FROM seg JOIN labels USING (segment))"""


def _segmented(t):
    base = stage(rfm.compute_rfm(t.sales), "rfm")
    assigned = segments.assign_to_centres(segments.scale_rfm(base), CENTRES)
    return segments.with_labels(assigned, segments.label_centres(base, CENTRES))


@query("ml21_assign_to_centres", f"WITH {_segments_sql()} SELECT order_id, segment FROM s")
def _(t):
    scaled = segments.scale_rfm(rfm.compute_rfm(t.sales))
    return segments.assign_to_centres(scaled, CENTRES).select("order_id", "segment")


def _labels_sql(back: str) -> str:
    return f"""WITH {_segments_sql(back)} SELECT segment, segment_label, round(r, 6) AS centre_recency,
               round(f, 6) AS centre_frequency, round(m, 3) AS centre_monetary FROM labels"""


def _labels(t, space: str):
    out = segments.label_centres(rfm.compute_rfm(t.sales), CENTRES, space)
    return rounded(rounded(out, 6, "centre_recency", "centre_frequency"), 3, "centre_monetary")


@query("ml22_segment_labels", _labels_sql("exp({}) - 1"))
def _(t):
    return _labels(t, "original")


@query("ml22_segment_labels_log_space", _labels_sql("{}"))
def _(t):
    return _labels(t, "log")


_PROFILE = """segment_label, count(DISTINCT order_id) AS customers,
    CAST(round_even(avg(recency), 1) AS DOUBLE) AS avg_recency,
    CAST(round_even(avg(frequency), 1) AS DOUBLE) AS avg_frequency,
    CAST(round_even(avg(monetary), 1) AS DOUBLE) AS avg_monetary"""


@query(
    "agg23_segment_profile",
    f"""WITH {_segments_sql()} SELECT {_PROFILE},
        CAST(round_even(sum(monetary), 1) AS DOUBLE) AS total_revenue FROM s GROUP BY segment_label""",
)
def _(t):
    return rfm.segment_profile(_segmented(t))


@query(
    "agg24_segment_summary",
    f"WITH {_segments_sql()} SELECT {_PROFILE} FROM s GROUP BY segment_label",
)
def _(t):
    return rfm.segment_summary(_segmented(t))


@query(
    "agg25_segment_revenue_share",
    f"""WITH {_segments_sql()}
        SELECT segment_label, count(DISTINCT order_id) AS customers, round(sum(monetary), 2) AS revenue,
               CAST(round_even(sum(monetary) / sum(sum(monetary)) OVER () * 100, 1) AS DOUBLE)
                 AS revenue_share
        FROM s GROUP BY segment_label""",
)
def _(t):
    return rounded(rfm.segment_revenue_share(_segmented(t)), 2, "revenue")


def _kmeans(t):
    """One k-means fit per application and state of the data serves both queries."""
    key = ("kmeans", t.sf_dir, file_state(t.spark, t.sf_dir))
    fit = remembered(t.spark, key, lambda: segments.segment_customers(rfm.compute_rfm(t.sales)))
    return fit.rows


@query("ml21_kmeans_segments")
def _(t):
    return _kmeans(t)


@query("ml21_kmeans_segment_profile")
def _(t):
    return rfm.segment_profile(_kmeans(t))


@query(
    "srt04_random_sample",
    """WITH r AS (SELECT order_id, CAST('0x' || substr(md5(order_id || '|42'), 1, 8) AS BIGINT) AS h,
                         count(*) AS frequency, round(sum(amount), 2) AS monetary
                  FROM sales GROUP BY order_id)
       SELECT order_id, frequency, monetary FROM r ORDER BY h, order_id LIMIT 2000""",
)
def _(t):
    base = rfm.compute_rfm(t.sales, positive_only=False).select("order_id", "frequency", "monetary")
    return rounded(random_rows(base, ["order_id"], 2000, seed=42), 2, "monetary")


_WELCH = """count(amount) FILTER (WHERE b2b) AS n1, count(amount) FILTER (WHERE NOT b2b) AS n2,
    avg(amount) FILTER (WHERE b2b) AS m1, avg(amount) FILTER (WHERE NOT b2b) AS m2,
    var_samp(amount) FILTER (WHERE b2b) AS v1, var_samp(amount) FILTER (WHERE NOT b2b) AS v2"""
_WELCH_OUT = """n1 AS n_true, n2 AS n_false, round(m1, 4) AS mean_true, round(m2, 4) AS mean_false,
    round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_statistic,
    round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df"""


def _welch(df):
    out = rounded(df, 4, "mean_true", "mean_false", "df")
    return rounded(out, 6, "t_statistic")


@query("sta01_welch_statistics", f"SELECT {_WELCH_OUT} FROM (SELECT {_WELCH} FROM sales)")
def _(t):
    return _welch(stats_tests.welch_statistics(t.sales))


@query(
    "sta01_welch_statistics_by_category",
    f"SELECT category, {_WELCH_OUT} FROM (SELECT category, {_WELCH} FROM sales GROUP BY category)",
)
def _(t):
    return _welch(stats_tests.welch_statistics(t.sales, by=["category"]))


# The p-value by Simpson's rule over the density of the t distribution.
_T_TEST = f"""WITH w AS (SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, m1, m2,
      (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS v
      FROM (SELECT {_WELCH} FROM sales)),
    g AS (SELECT *, i, abs(t) * i / 2000.0::DOUBLE AS x FROM w, range(2001) r(i)),
    p AS (SELECT any_value(t) AS t, any_value(m1) AS m1, any_value(m2) AS m2,
            1 - 2 * sum(exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2
                            - (v + 1) / 2 * ln(1 + x * x / v))
                    * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                * any_value(abs(t)) / 2000 / 3 AS p FROM g)
    SELECT CAST(round_even(t, 4) AS DOUBLE) AS t_statistic, CAST(round_even(p, 6) AS DOUBLE) AS p_value,
           CAST(round_even(m1, 2) AS DOUBLE) AS mean_true, CAST(round_even(m2, 2) AS DOUBLE) AS mean_false,
           p < 0.05 AS significant FROM p"""


@query("sta01_welch_t_test", _T_TEST)
def _(t):
    return stats_tests.welch_t_test(t.sales)


@query(
    "agg28_contingency",
    """SELECT fulfilment, count(*) FILTER (WHERE status ILIKE '%cancel%') AS cancelled,
              count(*) FILTER (WHERE NOT status ILIKE '%cancel%') AS active
       FROM sales GROUP BY fulfilment""",
)
def _(t):
    return stats_tests.contingency(t.sales)


def _chi2_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH o AS (SELECT {lead}fulfilment, status ILIKE '%cancel%' AS hit, count(*) AS n
                          FROM sales GROUP BY ALL),
      e AS (SELECT {lead}n, sum(n) OVER ({part} {', ' if by else 'PARTITION BY '}fulfilment) * 1.0
                   * sum(n) OVER ({part} {', ' if by else 'PARTITION BY '}hit)
                   / sum(n) OVER ({part}) AS x FROM o)
      SELECT {lead}round(sum((abs(n - x) - least(abs(n - x), 0.5)) ** 2 / x), 8) AS chi2
      FROM e {group}"""


@query("sta02_chi_square_statistics", _chi2_sql())
def _(t):
    return rounded(stats_tests.chi_square_statistics(t.sales), 8, "chi2")


@query("sta02_chi_square_by_category", _chi2_sql("category"))
def _(t):
    return rounded(stats_tests.chi_square_statistics(t.sales, by=["category"]), 8, "chi2")


# The p-value from the series of the error function.
_CHI2_TEST = f"""WITH c AS ({_chi2_sql().replace(", 8) AS chi2", ", 15) AS chi2")}),
    s AS (SELECT chi2, sum(exp((2 * n + 1) * ln(sqrt(chi2 / 2)) - lgamma(n + 1.5))) AS s
          FROM c, range(300) r(n) GROUP BY chi2),
    p AS (SELECT chi2, 1 - exp(-chi2 / 2) * s AS p FROM s)
    SELECT CAST(round_even(chi2, 4) AS DOUBLE) AS chi2, CAST(round_even(p, 6) AS DOUBLE) AS p_value,
           p < 0.05 AS significant FROM p"""


@query("sta02_chi_square_test", _CHI2_TEST)
def _(t):
    return stats_tests.chi_square_test(t.sales)
