"""Named queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesloom.sources.canonical import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = """
sales_raw AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id, l.l_linenumber AS line_no,
         l.l_suppkey AS supp, l.l_shipdate AS date,
         CASE l.l_returnflag WHEN 'R' THEN 'Cancelled' WHEN 'A' THEN 'Shipped'
              ELSE 'Shipped - Delivered to Buyer' END AS status,
         CASE l.l_linestatus WHEN 'F' THEN 'Amazon' ELSE 'Merchant' END AS fulfilment,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Expedited'
              ELSE 'Standard' END AS ship_service_level,
         CAST(p.p_partkey AS VARCHAR) AS sku, p.p_brand AS style,
         p.p_type AS category, CAST(p.p_size AS VARCHAR) AS size,
         CAST(l.l_quantity AS INT) AS qty,
         CASE WHEN l.l_orderkey % 50 = 0 THEN NULL ELSE l.l_extendedprice END AS amount,
         'INR' AS currency,
         CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE n.n_name END AS ship_state,
         c.c_mktsegment = 'MACHINERY' AS b2b,
         CASE WHEN l.l_discount >= 0.06 THEN 'PROMO' ELSE NULL END AS promotion_ids
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
sales AS (SELECT * FROM sales_raw WHERE amount IS NOT NULL),
inventory AS (
  SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS sku_code,
         p_brand AS design_no, CAST((p_partkey * 7) % 101 AS DOUBLE) AS stock,
         p_type AS category, CAST(p_size AS VARCHAR) AS size,
         split_part(p_name, ' ', 1) AS color
  FROM part),
expenses AS (
  SELECT s_suppkey AS idx,
         CASE WHEN s_suppkey = 0 THEN 'Particular' WHEN s_suppkey % 25 = 24 THEN 'Total'
              WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS income_particular,
         CASE WHEN s_suppkey = 0 THEN 'Amount' WHEN s_suppkey % 3 = 0 THEN NULL
              ELSE CAST(s_acctbal AS VARCHAR) END AS income_amount,
         s_name AS expense_particular,
         CASE WHEN s_suppkey = 0 THEN 'Amount' ELSE CAST(s_acctbal AS VARCHAR) END
              AS expense_amount
  FROM supplier)"""


def with_views(body: str) -> str:
    """Put the canonical views in front of a statement that may start with WITH."""
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {VIEWS.strip()},\n{body[5:]}"
    return f"WITH {VIEWS.strip()}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function of the tables under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


def runnable(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))
