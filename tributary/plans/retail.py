"""Retail: orders and products up to sales marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans import MONEY, flag, tidy


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("order_id").cast("bigint"), F.col("customer_id").cast("bigint"),
        F.col("order_date").cast("date"), tidy("order_status").alias("order_status"),
    )


def stg_products(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("product_id").cast("bigint"), F.trim("product_name").alias("product_name"),
        tidy("category").alias("category"), F.col("unit_price").cast(MONEY),
    )


def int_order_items(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with the product of the same number, as the model defines it."""
    return orders.join(products, F.col("order_id") == F.col("product_id"), "left")


def int_customer_order_summary(items: DataFrame) -> DataFrame:
    """Orders, spend and completed items per customer.

    Reducing to one row per order first turns the distinct count into a plain count.
    """
    per_order = items.groupBy("customer_id", "order_id").agg(
        F.sum("unit_price").alias("spend"), F.sum(flag(F.col("order_status") == "completed")).alias("completed")
    )
    return per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"),
        F.sum("spend").alias("lifetime_spend"),
        F.sum("completed").alias("completed_order_count"),
    )


def mart_retail_sales(summary: DataFrame) -> DataFrame:
    """Adds the completion rate, rounded to cents."""
    share = F.col("completed_order_count").cast(MONEY) / F.nullif("order_count", F.lit(0))
    return summary.withColumn("completion_rate", F.when(F.col("order_count") == 0, 0).otherwise(F.round(share, 2)))


def mart_top_products(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id", "product_name", "category").agg(
        F.count(F.lit(1)).alias("times_ordered"), F.sum("unit_price").alias("total_revenue")
    )
