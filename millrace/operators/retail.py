"""The retail reports. Dimensions that prove small are broadcast by the optimiser, not by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import size_pretty


def best_sellers(items: DataFrame, products: DataFrame, on: Column, name: str, quantity: Column, revenue: Column) -> DataFrame:
    """Quantity and revenue by product name (equal names merge), highest revenue first."""
    return items.join(products, on).groupBy(F.col(name).alias("product_name")).agg(quantity.alias("total_quantity"), revenue.alias("total_revenue")).orderBy(F.desc_nulls_first("total_revenue"), "product_name")


def sales_by_seller(receipts: DataFrame, sellers: DataFrame, on: Column, key: str, name: Column, receipt: str, total: Column) -> DataFrame:
    """Receipts and sales of each seller; grouped by key and name, only the name is shown."""
    g = receipts.join(sellers, on).groupBy(F.col(key), name.alias("seller_name")).agg(F.count(receipt).alias("receipts_count"), total.alias("total_sales"))
    return g.orderBy(F.desc_nulls_first("total_sales"), key).select("seller_name", "receipts_count", "total_sales")


def low_stock(inventory: DataFrame, products: DataFrame, on: Column, name: str, stock: str, minimum: str) -> DataFrame:
    """What is at or below its minimum."""
    return inventory.join(products, on).where(F.col(stock) <= F.col(minimum)).select(F.col(name).alias("product_name"), F.col(stock).alias("current_stock"), F.col(minimum).alias("min_stock_level"))


def daily_revenue(receipts: DataFrame, at: str, total: Column) -> DataFrame:
    """Receipts and revenue by day, latest first."""
    return receipts.groupBy(F.to_date(at).alias("sale_date")).agg(F.count("*").alias("receipts_count"), total.alias("daily_revenue")).orderBy(F.desc_nulls_first("sale_date"))


def product_categories(products: DataFrame, bridge: DataFrame, categories: DataFrame, product: str, category: str, product_name: str, category_name: str, primary_first: bool = False) -> DataFrame:
    """Products with their categories through the bridge; optionally the primary ones first."""
    j = bridge.join(products, product).join(categories, category).select(F.col(product_name).alias("product_name"), F.col(category_name).alias("category_name"), "is_primary")
    order = [F.asc_nulls_last("product_name")] + ([F.desc_nulls_first("is_primary")] if primary_first else []) + [F.asc_nulls_last("category_name")]
    return j.orderBy(*order)


def volume_report(rows: Column, table_bytes: Column, all_bytes: Column) -> list[Column]:
    """Three texts: rows, and sizes of the table and of its database."""
    text = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    return [
        text("TOTAL ROWS", rows.cast("string")).alias("row_count"), text("TABLE SIZE", size_pretty(table_bytes)).alias("table_size"),
        text("DB SIZE", size_pretty(all_bytes)).alias("db_size"),
    ]
