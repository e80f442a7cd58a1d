"""Seed rows of the retail and shop databases."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, StructType, TimestampNTZType

from . import catalog, structure

# The rows as they are inserted, without serial numbers and defaults.
SELLERS = """Иван|Петров|EMP001|Кассир|2022-01-15|true
Мария|Сидорова|EMP002|Старший кассир|2021-03-10|true
Алексей|Козлов|EMP003|Кассир|2023-05-20|true
Ольга|Николаева|EMP004|Администратор|2020-11-05|true
Дмитрий|Васильев|EMP005|Кассир|2022-08-12|false"""
PRODUCTS = """Хлеб Бородинский|4601234567890|Хлебобулочные изделия|45.50|шт|true
Молоко Простоквашино 2.5%|4602345678901|Молочные продукты|89.90|шт|true
Яйца куриные С0|4603456789012|Яйца|125.00|уп|true
Картофель мытый|4604567890123|Овощи|65.00|кг|true
Яблоки Гренни Смит|4605678901234|Фрукты|149.90|кг|true
Сыр Российский|4606789012345|Молочные продукты|450.00|кг|true
Колбаса Докторская|4607890123456|Колбасные изделия|320.00|кг|true
Вода минеральная|4608901234567|Напитки|35.00|шт|false
Шоколад Alpen Gold|4609012345678|Кондитерские изделия|75.50|шт|true
Кофе Jacobs|4610123456789|Бакалея|450.00|шт|true"""
RECEIPTS = """CHK00123456|1|285.40|card|2024-01-15 08:30:15
CHK00123457|2|520.90|cash|2024-01-15 09:15:22
CHK00123458|1|125.00|card|2024-01-15 10:05:47
CHK00123459|3|890.50|online|2024-01-15 11:20:33
CHK00123460|2|230.00|card|2024-01-15 12:45:18"""
RECEIPT_ITEMS = """1|1|1|45.50|45.50
1|2|2|89.90|179.80
1|10|1|60.10|60.10
2|3|1|125.00|125.00
2|6|0.5|450.00|225.00
2|7|0.3|320.00|96.00
2|9|2|75.50|151.00
3|3|1|125.00|125.00
4|4|2.5|65.00|162.50
4|5|1.2|149.90|179.88
4|6|0.8|450.00|360.00
4|7|0.6|320.00|192.00
5|1|1|45.50|45.50
5|2|1|89.90|89.90
5|9|1|75.50|75.50
5|10|1|19.10|19.10"""
INVENTORY = """1|50|10
2|120|30
3|80|20
4|200.5|50
5|150.2|40
6|25.8|5
7|18.9|4
8|0|20
9|75|15
10|45|10"""
CATEGORIES = """Продукты питания||Все пищевые продукты
Бытовая химия||Средства для уборки и гигиены
Хозтовары||Товары для дома
Молочные продукты|1|Молоко, сыры, йогурты
Хлебобулочные изделия|1|Хлеб, булки, выпечка
Мясо и колбасы|1|Мясо, колбасные изделия
Овощи и фрукты|1|Свежие овощи и фрукты
Бакалея|1|Крупы, макароны, консервы
Напитки|1|Соки, воды, газировка
Кондитерские изделия|1|Сладости, шоколад, печенье
Замороженные продукты|1|Заморозка, полуфабрикаты
Молоко|4|Различные виды молока
Сыры|4|Твердые и мягкие сыры
Йогурты|4|Йогурты, творожки
Кисломолочные продукты|4|Кефир, ряженка, сметана
Стиральные порошки|2|Средства для стирки
Моющие средства|2|Для мытья посуды и поверхностей
Гигиена|2|Мыло, шампуни, зубные пасты
Посуда|3|Тарелки, кружки, кастрюли
Текстиль|3|Полотенца, постельное белье"""
PRODUCT_CATEGORIES = """1|5|true
1|8|false
2|4|true
2|10|true
2|8|false
3|1|true
4|7|true
5|7|true
5|15|false
6|4|true
6|11|true
7|6|true
8|9|true
9|15|true
9|8|false
10|8|true
10|15|false"""
USERS = """alice@example.com|Alice Johnson|2024-01-15 10:00:00|2024-01-20 14:30:00
bob@example.com|Bob Smith|2024-02-01 09:15:00|2024-02-10 16:45:00
charlie@example.com|Charlie Brown|2024-03-10 11:20:00|2024-03-15 08:30:00"""
SHOP_PRODUCTS = """Laptop Gaming|1299.99|electronics
Wireless Mouse|35.50|electronics
Office Chair|199.99|furniture"""
ORDERS = """1|1|1|1299.99|completed
1|2|2|71.00|completed
2|3|1|199.99|shipped"""
# For each table its rows, whether they are numbered, and the columns that they give; the others have defaults.
_RETAIL = {
    "sellers": (SELLERS, True, "first_name last_name employee_id position hire_date is_active"),
    "products": (PRODUCTS, True, "product_name barcode category price unit in_stock"),
    "receipts": (RECEIPTS, True, "receipt_number seller_id total_amount payment_method created_at"),
    "receipt_items": (RECEIPT_ITEMS, True, "receipt_id product_id quantity unit_price total_price"),
    "inventory": (INVENTORY, True, "product_id current_stock min_stock_level"),
    "categories": (CATEGORIES, True, "category_name parent_category_id description"),
    "product_categories": (PRODUCT_CATEGORIES, False, "product_id category_id is_primary"),
}
_SHOP = {
    "users": (USERS, True, "email name created_at updated_at"),
    "products": (SHOP_PRODUCTS, True, "name price category"),
    "orders": (ORDERS, True, "user_id product_id quantity amount status"),
}


def _value(text: str, kind):
    """A field as a value of the column's type; an empty field is null."""
    if text == "":
        return None
    if isinstance(kind, DecimalType):
        return Decimal(text)
    if isinstance(kind, DateType):
        return date.fromisoformat(text)
    if isinstance(kind, TimestampNTZType):
        return datetime.fromisoformat(text)
    return {"boolean": lambda: text == "true", "int": lambda: int(text)}.get(kind.simpleString(), lambda: text)()


def _tables(spark: SparkSession, seeds: dict, shapes: dict[str, StructType], now: datetime | None) -> dict[str, DataFrame]:
    out = {}
    for name, (lines, serial, columns) in seeds.items():
        shape = shapes[name]
        given = ([shape.fieldNames()[0]] if serial else []) + columns.split()
        rows = []
        for n, line in enumerate(lines.split("\n"), 1):
            fields = ([str(n)] if serial else []) + line.split("|")
            rows.append(tuple(_value(x, shape[c].dataType) for c, x in zip(given, fields, strict=True)))
        df = spark.createDataFrame(rows, StructType([shape[c] for c in given]))
        if now:
            df = df.withColumns({f.name: F.lit(now).cast("timestamp_ntz") for f in shape if f.metadata.get("default") == catalog.NOW and f.name not in given})
        out[name] = structure.conform(df, shape)
    return out


def retail(spark: SparkSession, now: datetime | None = None) -> dict[str, DataFrame]:
    """The seven retail tables with their structure; ``now`` stands for the time of the load."""
    return _tables(spark, _RETAIL, catalog.retail(spark), now)


def shop(spark: SparkSession, now: datetime | None = None) -> dict[str, DataFrame]:
    """The three shop tables with their structure."""
    return _tables(spark, _SHOP, catalog.shop(spark), now)
