"""The sales, inventory and ledger views over the star-schema test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The columns the views use. Declared, so opening a table costs no job.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_acctbal double",
    "documents": "doc_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


class Tables:
    """Lazy views over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def order_side(self) -> DataFrame:
        """One row per order with everything the fact needs from it.

        Joined before the fact so that line items shuffle twice (order key, part
        key) and not once per dimension. Adaptive execution picks the joins from
        the sizes it meets.
        """
        orders, customer = self.source("orders"), self.source("customer")
        nation = self.source("nation")
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .select(
                "o_orderkey",
                F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Expedited")
                .otherwise("Standard")
                .alias("ship_service_level"),
                "n_name",
                (F.col("c_mktsegment") == "MACHINERY").alias("b2b"),
            )
        )

    def sales_from(self, lineitem: DataFrame) -> DataFrame:
        """Canonical sales rows for a batch or a stream of line items."""
        part = self.source("part").select(
            "p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("size")
        )
        return (
            lineitem.join(self.order_side, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").cast("string").alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                F.col("l_suppkey").alias("supp"),
                F.col("l_shipdate").alias("date"),
                F.when(F.col("l_returnflag") == "R", "Cancelled")
                .when(F.col("l_returnflag") == "A", "Shipped")
                .otherwise("Shipped - Delivered to Buyer")
                .alias("status"),
                F.when(F.col("l_linestatus") == "F", "Amazon")
                .otherwise("Merchant")
                .alias("fulfilment"),
                "ship_service_level",
                F.col("p_partkey").cast("string").alias("sku"),
                F.col("p_brand").alias("style"),
                F.col("p_type").alias("category"),
                "size",
                F.col("l_quantity").cast("int").alias("qty"),
                F.when(F.col("l_orderkey") % 50 != 0, F.col("l_extendedprice")).alias("amount"),
                F.lit("INR").alias("currency"),
                F.when(F.col("l_orderkey") % 97 != 0, F.col("n_name")).alias("ship_state"),
                "b2b",
                F.when(F.col("l_discount") >= 0.06, "PROMO").alias("promotion_ids"),
            )
        )

    @cached_property
    def sales_raw(self) -> DataFrame:
        return self.sales_from(self.source("lineitem"))

    @cached_property
    def sales(self) -> DataFrame:
        return self.sales_raw.where(F.col("amount").isNotNull())

    @cached_property
    def inventory(self) -> DataFrame:
        return self.source("part").select(
            F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey").cast("string")).alias(
                "sku_code"
            ),
            F.col("p_brand").alias("design_no"),
            ((F.col("p_partkey") * 7) % 101).cast("double").alias("stock"),
            F.col("p_type").alias("category"),
            F.col("p_size").cast("string").alias("size"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
        )

    @cached_property
    def expenses(self) -> DataFrame:
        key, name = F.col("s_suppkey"), F.col("s_name")
        balance = F.col("s_acctbal").cast("string")
        return self.source("supplier").select(
            key.alias("idx"),
            F.when(key == 0, "Particular")
            .when(key % 25 == 24, "Total")
            .when(key % 3 != 0, name)
            .alias("income_particular"),
            F.when(key == 0, "Amount").when(key % 3 != 0, balance).alias("income_amount"),
            name.alias("expense_particular"),
            F.when(key == 0, "Amount").otherwise(balance).alias("expense_amount"),
        )

