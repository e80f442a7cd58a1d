"""Structure of the retail and shop databases."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

# Columns of the two databases, as Spark DDL.
RETAIL = {
    "sellers": "seller_id int NOT NULL, first_name string NOT NULL, last_name string NOT NULL, employee_id string NOT NULL, position string NOT NULL, hire_date date NOT NULL, is_active boolean",
    "products": "product_id int NOT NULL, product_name string NOT NULL, barcode string, category string NOT NULL, price decimal(10,2) NOT NULL, unit string NOT NULL, in_stock boolean, created_at timestamp_ntz",
    "receipts": "receipt_id int NOT NULL, receipt_number string NOT NULL, seller_id int, total_amount decimal(10,2) NOT NULL, payment_method string, created_at timestamp_ntz, store_number string",
    "receipt_items": "item_id int NOT NULL, receipt_id int, product_id int, quantity decimal(8,3) NOT NULL, unit_price decimal(10,2) NOT NULL, total_price decimal(10,2) NOT NULL",
    "inventory": "inventory_id int NOT NULL, product_id int, current_stock decimal(8,3) NOT NULL, min_stock_level decimal(8,3) NOT NULL, last_updated timestamp_ntz",
    "categories": "category_id int NOT NULL, category_name string NOT NULL, parent_category_id int, description string, created_at timestamp_ntz",
    "product_categories": "product_id int NOT NULL, category_id int NOT NULL, is_primary boolean, assigned_at timestamp_ntz",
}
SHOP = {
    "users": "id int NOT NULL, email string NOT NULL, name string, created_at timestamp_ntz, updated_at timestamp_ntz, status string",
    "products": "id int NOT NULL, name string NOT NULL, price decimal(10,2), category string, created_at timestamp_ntz",
    "orders": "id int NOT NULL, user_id int, product_id int, quantity int, amount decimal(10,2), status string, created_at timestamp_ntz",
}
# Fixed values: (table, name, kind p/u/f/c, columns, referenced table, on delete).
SHOP_CONSTRAINTS = [
    ("users", "users_pkey", "p", ["id"], None, None),
    ("users", "users_email_key", "u", ["email"], None, None),
    ("products", "products_pkey", "p", ["id"], None, None),
    ("orders", "orders_pkey", "p", ["id"], None, None),
    ("orders", "orders_user_id_fkey", "f", ["user_id"], "users", None),
    ("orders", "orders_product_id_fkey", "f", ["product_id"], "products", None),
]
RETAIL_CONSTRAINTS = [
    ("sellers", "sellers_pkey", "p", ["seller_id"], None, None),
    ("sellers", "sellers_employee_id_key", "u", ["employee_id"], None, None),
    ("products", "products_pkey", "p", ["product_id"], None, None),
    ("products", "products_barcode_key", "u", ["barcode"], None, None),
    ("receipts", "receipts_pkey", "p", ["receipt_id"], None, None),
    ("receipts", "receipts_receipt_number_key", "u", ["receipt_number"], None, None),
    ("receipts", "receipts_seller_id_fkey", "f", ["seller_id"], "sellers", None),
    ("receipt_items", "receipt_items_pkey", "p", ["item_id"], None, None),
    ("receipt_items", "receipt_items_receipt_id_fkey", "f", ["receipt_id"], "receipts", None),
    ("receipt_items", "receipt_items_product_id_fkey", "f", ["product_id"], "products", None),
    ("inventory", "inventory_pkey", "p", ["inventory_id"], None, None),
    ("inventory", "inventory_product_id_fkey", "f", ["product_id"], "products", None),
    ("categories", "categories_pkey", "p", ["category_id"], None, None),
    ("categories", "categories_category_name_key", "u", ["category_name"], None, None),
    ("categories", "categories_parent_category_id_fkey", "f", ["parent_category_id"], "categories", None),
    ("product_categories", "product_categories_pkey", "p", ["product_id", "category_id"], None, None),
    ("product_categories", "product_categories_product_id_fkey", "f", ["product_id"], "products", "CASCADE"),
    ("product_categories", "product_categories_category_id_fkey", "f", ["category_id"], "categories", "CASCADE"),
]
# Most characters of texts, and defaults, by table.
RETAIL_LENGTHS = {
    "sellers": {"first_name": 50, "last_name": 50, "employee_id": 20, "position": 50},
    "products": {"product_name": 100, "barcode": 50, "category": 50, "unit": 20},
    "receipts": {"receipt_number": 20, "payment_method": 20, "store_number": 10},
    "categories": {"category_name": 50},
}
SHOP_LENGTHS = {"users": {"email": 100, "name": 100, "status": 20}, "products": {"name": 200, "category": 50}, "orders": {"status": 20}}
NOW = "localtimestamp()"
RETAIL_DEFAULTS = {
    "sellers": {"is_active": "true"}, "products": {"in_stock": "true", "created_at": NOW}, "receipts": {"created_at": NOW, "store_number": "'005'"},
    "inventory": {"last_updated": NOW}, "categories": {"created_at": NOW}, "product_categories": {"is_primary": "false", "assigned_at": NOW},
}
SHOP_DEFAULTS = {
    "users": {"created_at": NOW, "updated_at": NOW, "status": "'active'"}, "products": {"created_at": NOW},
    "orders": {"quantity": "1", "status": "'pending'", "created_at": NOW},
}


def structures(spark: SparkSession, schemas: dict[str, str], constraints: list[tuple], lengths: dict, defaults: dict) -> dict[str, StructType]:
    """For each table its columns with what they promise, as ``structure`` has it. A column that is a
    number of its own comes from the table's sequence where a load leaves it out."""
    entries: dict = {t: {} for t in schemas}
    for table, _, kind, columns, parent, on_delete in constraints:
        for n, c in enumerate(columns, 1):
            of = {"key": n} if kind == "p" else {"unique": True} if kind == "u" else {"references": f"{parent}.{_key(constraints, parent)}"}
            entries[table].setdefault(c, {}).update(of | ({"cascade": True} if on_delete == "CASCADE" else {}))
        if kind == "p" and len(columns) == 1:
            entries[table][columns[0]]["sequence"] = f"{table}_{columns[0]}_seq"
    out = {}
    for table, ddl in schemas.items():
        fields = []
        for f in spark.createDataFrame([], ddl).schema:
            more = {"not_null": True} if not f.nullable else {}
            more |= {k: v[table][f.name] for k, v in (("length", lengths), ("default", defaults)) if f.name in v.get(table, {})}
            fields.append(StructField(f.name, f.dataType, True, {**more, **entries[table].get(f.name, {})}))
        out[table] = StructType(fields)
    return out


def _key(constraints: list[tuple], table: str) -> str:
    return next(columns[0] for t, _, kind, columns, *_ in constraints if t == table and kind == "p")


def retail(spark: SparkSession) -> dict[str, StructType]:
    return structures(spark, RETAIL, RETAIL_CONSTRAINTS, RETAIL_LENGTHS, RETAIL_DEFAULTS)


def shop(spark: SparkSession) -> dict[str, StructType]:
    return structures(spark, SHOP, SHOP_CONSTRAINTS, SHOP_LENGTHS, SHOP_DEFAULTS)
