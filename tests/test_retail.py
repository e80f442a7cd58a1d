"""The retail reports on the seed rows, with their order, and the shop's tables end to end."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from millrace.operators import constraints, retail
from millrace.plans import runner
from millrace.sources import catalog, seeds
from millrace.sources.store import Store


@pytest.fixture(scope="module")
def r(spark):
    return seeds.retail(spark)


def rows(df):
    return [tuple(x) for x in df.collect()]


def test_counts_and_constraints(r):
    counts = {"sellers": 5, "products": 10, "receipts": 5, "receipt_items": 16, "inventory": 10, "categories": 20, "product_categories": 17}
    assert {t: df.count() for t, df in r.items()} == counts
    for table, _, kind, columns, parent, _ in catalog.RETAIL_CONSTRAINTS:
        if kind == "p":
            assert constraints.primary_key(r[table], columns).count() == 0
        elif kind == "u":
            assert constraints.unique(r[table], columns).count() == 0
        else:
            key = next(c for t, _, k, c, *_ in catalog.RETAIL_CONSTRAINTS if t == parent and k == "p")[0]
            assert constraints.foreign_key(r[table], columns[0], r[parent], key).count() == 0
    assert constraints.check(r["receipts"], "payment_method in ('cash', 'card', 'online')").count() == 0
    assert r["receipts"].where("store_number = '005'").count() == 5


def test_best_sellers(r):
    on = r["receipt_items"].product_id == r["products"].product_id
    got = retail.best_sellers(r["receipt_items"], r["products"], on, "product_name", F.sum("quantity"), F.sum("total_price"))
    assert rows(got) == [
        ("Сыр Российский", D("1.300"), D("585.00")), ("Колбаса Докторская", D("0.900"), D("288.00")), ("Молоко Простоквашино 2.5%", D("3.000"), D("269.70")),
        ("Яйца куриные С0", D("2.000"), D("250.00")), ("Шоколад Alpen Gold", D("3.000"), D("226.50")), ("Яблоки Гренни Смит", D("1.200"), D("179.88")),
        ("Картофель мытый", D("2.500"), D("162.50")), ("Хлеб Бородинский", D("2.000"), D("91.00")), ("Кофе Jacobs", D("2.000"), D("79.20")),
    ]
    assert got.agg(F.sum("total_revenue")).first()[0] == D("2131.78")


def test_sales_low_stock_revenue(r):
    s, name = r["sellers"], F.concat_ws(" ", "first_name", "last_name")
    receipts = r["receipts"].withColumnRenamed("seller_id", "sold_by")
    got = retail.sales_by_seller(receipts, s, receipts.sold_by == s.seller_id, "seller_id", name, "receipt_id", F.sum("total_amount"))
    assert rows(got) == [("Алексей Козлов", 1, D("890.50")), ("Мария Сидорова", 2, D("750.90")), ("Иван Петров", 2, D("410.40"))]
    i = r["inventory"]
    got = retail.low_stock(i, r["products"], i.product_id == r["products"].product_id, "product_name", "current_stock", "min_stock_level")
    assert rows(got) == [("Вода минеральная", D("0.000"), D("20.000"))]
    assert rows(retail.daily_revenue(r["receipts"], "created_at", F.sum("total_amount"))) == [(date(2024, 1, 15), 5, D("2051.80"))]


def test_categories(r):
    args = (r["products"], r["product_categories"], r["categories"], "product_id", "category_id", "product_name", "category_name")
    got = rows(retail.product_categories(*args))
    assert len(got) == 17 and [x[0] for x in got] == sorted(x[0] for x in got)
    first = rows(retail.product_categories(*args, True))
    assert set(first) == set(got) and first == sorted(first, key=lambda x: (x[0], not x[2], x[1]))


@pytest.fixture
def shop(spark, tmp_path):
    source = Store(spark, str(tmp_path / "shop"))
    for t, df in seeds.shop(spark).items():
        source.write(t, df)
    return runner.Config(
        source.path, str(tmp_path / "copy"), "full", edges=(("orders", "users"), ("orders", "products")), keys={t: ["id"] for t in ("users", "products", "orders")},
        foreign_keys=(("orders", "user_id", "users", "id"), ("orders", "product_id", "products", "id")), unique=(("users", ["email"]),), checks=(("orders", "quantity > 0"),),
        not_null={"users": ["id", "email"], "products": ["name"]},
    )


@pytest.mark.parametrize("through", [None, "csv"])
def test_shop_is_moved_whole(spark, tmp_path, shop, through):
    from dataclasses import replace

    config = replace(shop, csv=str(tmp_path / through) if through else None, analyze=True)
    report = runner.run(spark, config)
    assert report.ok and {t: x["rows"] for t, x in report.tables.items()} == {"users": 3, "products": 3, "orders": 3}
    assert len(report.violations) == 3 + 1 + 2 + 1 + 3 and not any(report.violations.values())
    source, target = Store(spark, config.source), Store(spark, config.target)
    for t in ("users", "products", "orders"):
        a, b = source.read(t), target.read(t)
        assert a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).count() == 0
    assert {r["column_name"]: r["nulls"] for r in report.statistics["users"]}["email"] == 0 and target.size("users") > 0
    assert all(x["rows_per_second"] is not None for x in report.tables.values())
