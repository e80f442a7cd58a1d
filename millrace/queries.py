"""The queries on the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField

from millrace.functions import scalars, variants
from millrace.operators import constraints, introspection, retail, strategies
from millrace.plans import backup, graph, loads, runner
from millrace.sources import catalog_source, datagen, delimited, structure
from millrace.sources.databases import Database
from millrace.sources.store import Store, staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MARK = "1998-01-01 00:00:00"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


# Reports


@query("SELECT * FROM region")
def scan_all(spark, sf_dir):
    return t(spark, sf_dir, "region")


def _scan(name: str) -> None:
    def scan(spark, sf_dir):
        return t(spark, sf_dir, name)

    QUERIES[f"scan_{name}"], ORACLE[f"scan_{name}"] = scan, f"SELECT * FROM {name}"


for _name in ("nation", "customer", "orders", "lineitem"):
    _scan(_name)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def where_filter(spark, sf_dir):
    return strategies.where_filter(t(spark, sf_dir, "orders"), {"orders": "o_orderstatus = 'F'"}.get("orders"))


@query(f"""
SELECT p_name AS product_name, {_sum('l_quantity')} AS total_quantity, {_sum('l_extendedprice')} AS total_revenue FROM lineitem
JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY total_revenue DESC, product_name
""")
def top_products(spark, sf_dir):
    return retail.best_sellers(t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "p_name", scalars.exact_sum("l_quantity"), scalars.exact_sum("l_extendedprice"))


@query(f"""
SELECT c_name || ' ' || c_mktsegment AS seller_name, COUNT(o_orderkey) AS receipts_count, {_sum('o_totalprice')} AS total_sales FROM orders
JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, seller_name ORDER BY total_sales DESC, c_custkey
""")
def sales_by_seller(spark, sf_dir):
    name = F.concat("c_name", F.lit(" "), "c_mktsegment")
    return retail.sales_by_seller(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "c_custkey", name, "o_orderkey", scalars.exact_sum("o_totalprice"))


@query("""
SELECT p_name AS product_name, l_quantity AS current_stock, p_size AS min_stock_level FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity <= p_size
""")
def low_stock(spark, sf_dir):
    return retail.low_stock(t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "p_name", "l_quantity", "p_size")


@query(f"""
SELECT CAST(o_orderdate AS DATE) AS sale_date, COUNT(*) AS receipts_count, {_sum('o_totalprice')} AS daily_revenue FROM orders GROUP BY 1
ORDER BY 1 DESC NULLS FIRST
""")
def daily_revenue(spark, sf_dir):
    return retail.daily_revenue(t(spark, sf_dir, "orders"), "o_orderdate", scalars.exact_sum("o_totalprice"))


def _bridge(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).agg((F.min("l_linenumber") == 1).alias("is_primary"))


def _categories(order: str) -> str:
    return f"WITH b AS (SELECT l_partkey, l_suppkey, MIN(l_linenumber) = 1 AS is_primary FROM lineitem GROUP BY 1, 2) SELECT p_name AS product_name, s_name AS category_name, is_primary FROM b JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey ORDER BY {order}"


@query(_categories("1, 2"))
def product_categories(spark, sf_dir):
    return retail.product_categories(t(spark, sf_dir, "part"), _bridge(spark, sf_dir), t(spark, sf_dir, "supplier"), "p_partkey", "s_suppkey", "p_name", "s_name")


@query(_categories("1, 3 DESC, 2"))
def product_categories_primary_first(spark, sf_dir):
    return retail.product_categories(t(spark, sf_dir, "part"), _bridge(spark, sf_dir), t(spark, sf_dir, "supplier"), "p_partkey", "s_suppkey", "p_name", "s_name", True)


_PRETTY_SQL = "(CASE WHEN {n} < 10240 THEN {n}::VARCHAR || ' bytes' WHEN {n} < 10484992 THEN (({n} + 512) // 1024)::VARCHAR || ' kB' WHEN {n} < 10736893952 THEN (({n} + 524288) // 1048576)::VARCHAR || ' MB' ELSE (({n} + 536870912) // 1073741824)::VARCHAR || ' GB' END)"


@query(f"""
WITH d AS (SELECT COUNT(*) AS n, CAST(SUM(COALESCE(octet_length(encode(text)), 0)) AS BIGINT) AS b
FROM documents), o AS (SELECT CAST(SUM(COALESCE(octet_length(encode(text)), 0)) AS BIGINT) AS c
FROM benchmark) SELECT 'TOTAL ROWS: ' || n::VARCHAR AS row_count, 'TABLE SIZE: ' || {_PRETTY_SQL.format(n='b')} AS table_size, 'DB SIZE: ' || {_PRETTY_SQL.format(n='(b + c)')} AS db_size
FROM d, o
""")
def volume_report(spark, sf_dir):
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long")
    rows = t(spark, sf_dir, "documents").agg(F.count("*").alias("n"), size.alias("b"))
    both = rows.withColumn("one", F.lit(1)).join(t(spark, sf_dir, "benchmark").agg(size.alias("c")).withColumn("one", F.lit(1)), "one")
    return both.select(*retail.volume_report(F.col("n"), F.col("b"), F.col("b") + F.col("c")))


# CSV: what an export writes for each row, text in quotes and null as nothing


@query("""
SELECT o_orderkey::VARCHAR || ',' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '\"' || o_orderstatus || '\"' END || ',' || '\"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE replace(o_orderpriority, '-', '\"\"') END || '\"' AS value
FROM orders WHERE o_orderkey % 2 = 0
""")
def csv_export(spark, sf_dir):
    return delimited.lines(_with_gaps(spark, sf_dir).where("o_orderkey % 2 = 0"))


@query("""
SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE replace(o_orderpriority, '-', '\"') END AS o_orderpriority
FROM orders
""")
def csv_round_trip(spark, sf_dir):
    path, df = staging(spark, "csv"), _with_gaps(spark, sf_dir)
    delimited.export(df, path)
    return delimited.load(spark, path, df.schema)


@query("""
SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE replace(o_orderpriority, '-', '"' || chr(10)) END AS v FROM orders
""")
def csv_one_column(spark, sf_dir):
    """A table of one column, whose nulls are empty lines, with line breaks and quotes in its texts."""
    path, key = staging(spark, "csv"), F.col("o_orderkey") % 5
    text = F.replace("o_orderpriority", F.lit("-"), F.lit('"\n'))
    df = t(spark, sf_dir, "orders").select(F.when(key == 1, F.lit("")).when(key != 0, text).alias("v"))
    delimited.export(df, path)
    return delimited.load(spark, path, df.schema)


def _with_gaps(spark, sf_dir):
    """Orders with nulls, empty strings and quotes."""
    priority = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit('"')))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), priority.alias("o_orderpriority"))


# Counts and validation

_COUNTED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _counts(spark, sf_dir, keep=lambda name, df: df):
    each = [keep(n, t(spark, sf_dir, n)).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in _COUNTED]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def _loaded(name: str, df: DataFrame) -> DataFrame:
    return df.where("o_orderkey % 2 = 0") if name == "orders" else df


_COUNT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in _COUNTED)
_LOADED_SQL = _COUNT_SQL.replace("FROM orders", "FROM orders WHERE o_orderkey % 2 = 0")
_VALID_SQL = f"SELECT table_name, CAST(COALESCE(s.n, 0) AS BIGINT) AS source_rows, CAST(COALESCE(t.n, 0) AS BIGINT) AS target_rows, COALESCE(s.n, 0) = COALESCE(t.n, 0) AS matches FROM ({_COUNT_SQL}) s FULL JOIN (SELECT * FROM ({_LOADED_SQL}) WHERE table_name <> 'events') t USING (table_name)"


@query(_COUNT_SQL)
def table_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(_VALID_SQL)
def validate_counts(spark, sf_dir):
    return runner.validate_counts(_counts(spark, sf_dir), _counts(spark, sf_dir, _loaded).where("table_name <> 'events'"))


@query(f"""
SELECT CAST(SUM(source_rows) AS BIGINT) AS source_total, CAST(SUM(target_rows) AS BIGINT) AS target_total, COUNT(*) FILTER (WHERE NOT matches) AS mismatches
FROM ({_VALID_SQL})
""")
def validate_totals(spark, sf_dir):
    return runner.validate_totals(validate_counts(spark, sf_dir))


# Loads


def _even(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")


def _odd(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("o_orderkey % 2 = 1")


@query(f"SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '{MARK}'")
def load_full(spark, sf_dir):
    return strategies.apply("full", _even(spark, sf_dir), t(spark, sf_dir, "orders"), condition=f"o_orderdate > timestamp_ntz'{MARK}'")


@query(f"SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1 AND o_orderdate > TIMESTAMP '{MARK}'")
def load_append(spark, sf_dir):
    return strategies.append(_even(spark, sf_dir), strategies.where_filter(_odd(spark, sf_dir), f"o_orderdate > timestamp_ntz'{MARK}'"))


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def incremental_filter(spark, sf_dir):
    return strategies.incremental_filter(t(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00")


@query(f"SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '{MARK}' UNION ALL SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '{MARK}'")
def load_incremental(spark, sf_dir):
    old = t(spark, sf_dir, "orders").where(f"o_orderdate <= timestamp_ntz'{MARK}'")
    return strategies.incremental(old, t(spark, sf_dir, "orders"), "o_orderdate", MARK, ["o_orderkey"], "ignore")


def _changed(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderstatus", F.lit("X"))


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderstatus ELSE 'X' END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders
""")
def load_upsert(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    return strategies.upsert(orders.where("o_orderkey % 4 < 3"), _changed(orders.where("o_orderkey % 4 >= 2")), ["o_orderkey"])


def _pairs(spark, sf_dir, flag: str, condition: str):
    return t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().where(condition).withColumn("state", F.lit(flag))


_PAIRS = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


@query(f"SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'old' ELSE 'new' END AS state FROM {_PAIRS}")
def load_upsert_composite(spark, sf_dir):
    return strategies.upsert(_pairs(spark, sf_dir, "old", "l_partkey % 3 < 2"), _pairs(spark, sf_dir, "new", "l_partkey % 3 >= 1"), ["l_partkey", "l_suppkey"])


@query("SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 50")
def load_upsert_no_pk(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    return strategies.upsert(events, events.where("value > 50"), None)


@query(f"SELECT * FROM {_PAIRS}")
def load_upsert_all_key(spark, sf_dir):
    pairs = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return strategies.upsert(pairs.where("l_partkey % 3 < 2"), pairs.where("l_partkey % 3 >= 1"), ["l_partkey", "l_suppkey"])


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_conflicting(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    return strategies.delete_conflicting(orders, orders.where("o_orderstatus = 'P'"), ["o_orderkey"])


ORDERS = {
    "o_orderkey": {"key": 1}, "o_orderstatus": {"not_null": True, "default": "'O'", "length": 1}, "o_orderpriority": {"length": 15, "comment": "1 is most urgent"},
    "o_orderdate": {"default": "current_timestamp()"},
}


def _store(spark, name: str) -> Store:
    return Store(spark, staging(spark, name))


def _orders(spark, sf_dir) -> DataFrame:
    return structure.declare(t(spark, sf_dir, "orders"), ORDERS)


_CHANGED_SQL = """
SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice, o_orderdate,
    o_orderpriority
FROM orders WHERE o_orderkey % 5 = 0
"""


def _changes(spark, sf_dir) -> DataFrame:
    """A fifth of the orders: half of these with a new status, half under keys that are not there yet."""
    key = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 0, 1_000_000_000).otherwise(0)
    df = t(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    return df.withColumns({"o_orderkey": key.cast("long"), "o_orderstatus": F.lit("X")})


@query(f"SELECT * FROM ({_CHANGED_SQL}) UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 <> 5")
def store_upsert(spark, sf_dir):
    """An upsert written to a store: staged, checked, parts with its keys rewritten."""
    store = _store(spark, "upsert")
    store.write("orders", _orders(spark, sf_dir), ["o_orderkey"])
    loads.load(store, "orders", _changes(spark, sf_dir), "upsert", ["o_orderkey"])
    return store.read("orders")


@query("""
WITH c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderkey % 10 = 0) AS fresh, COUNT(*) FILTER (WHERE o_orderkey % 10 = 5) AS met,
    COUNT(*) FILTER (WHERE o_orderkey % 5 = 0) AS taken FROM orders)
SELECT 'full' AS mode, n AS taken, n AS inserted, CAST(0 AS BIGINT) AS updated, n AS total, true AS same FROM c
UNION ALL SELECT 'upsert', taken, fresh, met, n + fresh, true FROM c
""")
def run_counts(spark, sf_dir):
    """What two runs report of the rows that they took, inserted and updated, counted while they wrote."""
    source, target, rows = _store(spark, "source"), staging(spark, "target"), []
    source.write("orders", _orders(spark, sf_dir))
    for mode in ("full", "upsert"):
        report = runner.run(spark, runner.Config(source.path, target, mode))
        got = report.tables["orders"]
        rows.append((mode, got["rows"], got["inserted"], got["updated"], Store(spark, target).count("orders"), report.values["orders"]))
        source.write("orders", structure.declare(_changes(spark, sf_dir), ORDERS))
    return spark.createDataFrame(rows, "mode string, taken long, inserted long, updated long, total long, same boolean")


@query(f"""
WITH c AS ({_CHANGED_SQL}), o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM c
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 5)
SELECT * FROM o WHERE o_orderstatus <> 'F' AND o_orderkey > 100
""")
def jdbc_orders(spark, sf_dir):
    """Orders in a database, an upsert run from a store into it, and a filtered read in ranges of the key."""
    db = _database(spark)
    db.create("orders", _orders(spark, sf_dir).schema)
    db.load("orders", t(spark, sf_dir, "orders"), "append")
    source = _store(spark, "changes")
    source.write("orders", structure.declare(_changes(spark, sf_dir), ORDERS))
    runner.run(spark, runner.Config(source.path, db.url, "upsert", strict=True))
    return db.read("orders").where("o_orderstatus <> 'F' AND o_orderkey > 100").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _database(spark) -> Database:
    """A database in memory, emptied. It lives in the driver's JVM, so only a local session can share it."""
    db = Database(spark, "jdbc:derby:memory:millrace;create=true")
    for name in db.tables():
        db.drop(name)
    return db


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def backup_restore(spark, sf_dir):
    """A table loaded, backed up, loaded again, backed up by what is new, and restored to the first snapshot."""
    store, copy = _store(spark, "live"), _store(spark, "backup")
    store.write("orders", _even(spark, sf_dir))
    backup.backup(store, copy)
    store.append("orders", _odd(spark, sf_dir))
    backup.backup(store, copy)
    backup.restore(copy, store, "orders", 0)
    return store.read("orders")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def load_with_defaults(spark, sf_dir):
    """Orders of which half come without a status and take the default of a cloned table."""
    source, target = _store(spark, "source"), _store(spark, "target")
    source.write("orders", _orders(spark, sf_dir).limit(0))
    target.clone_schema("orders", source)
    target.append("orders", _even(spark, sf_dir).drop("o_orderstatus", "o_orderdate"))
    target.append("orders", _odd(spark, sf_dir))
    return target.read("orders").drop("o_orderdate")


@query("SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin, CAST(CASE WHEN o_orderkey % 2 = 1 THEN 1 END AS INTEGER) AS batch FROM orders")
def alter_table(spark, sf_dir):
    """Columns added to a loaded table: its rows have the default, later ones what they bring."""
    store = _store(spark, "alter")
    store.write("orders", _even(spark, sf_dir))
    store.alter("orders", {}, [StructField("origin", StringType(), True, {"default": "'old'"}), StructField("batch", IntegerType())])
    store.alter("orders", {"origin": {"default": "'new'"}})
    store.append("orders", _odd(spark, sf_dir).withColumn("batch", F.lit(1)))
    return store.read("orders")


@query("SELECT * FROM orders WHERE 1 = 1 UNION ALL SELECT * FROM orders WHERE 1 = 0")
def where_constant(spark, sf_dir):
    """The filters of a load that takes everything and of one that takes nothing."""
    orders = t(spark, sf_dir, "orders")
    return strategies.where_filter(orders, "1 = 1").unionByName(strategies.where_filter(orders, "1 = 0"))


@query("""
WITH c AS (SELECT COUNT(*) FILTER (WHERE o_orderkey % 2 = 0) AS even, COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS odd FROM orders)
SELECT CAST(0 AS BIGINT) AS load, even AS ids, CAST(1 AS BIGINT) AS low, even AS high FROM c WHERE even > 0
UNION ALL SELECT 1, odd, even + 1, even + odd FROM c WHERE odd > 0
""")
def sequence_ids(spark, sf_dir):
    """Two loads whose rows are numbered by the target's sequence: how many ids, from which to which."""
    store, rows = _store(spark, "sequence"), t(spark, sf_dir, "orders")
    shape = structure.declare(rows.withColumn("id", F.lit(0).cast("long")), {"id": {"key": 1, "sequence": "orders_id_seq"}})
    store.create("orders", shape.schema)
    for part in (_even(spark, sf_dir), _odd(spark, sf_dir)):
        loads.load(store, "orders", part, "append", ["id"])
    load = (F.col("o_orderkey") % 2).alias("load")
    return store.read("orders").groupBy(load).agg(F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


_VARIANT_IN = """'{"type": "' || event_type || '",  "k": 0, "props": ' || props || ', "k": ' || event_id || ', "ids": [1, ' || user_id || ']}'"""
_VARIANT_OUT = """'{"k": ' || event_id || ', "ids": [1,' || user_id || '], "type": "' || event_type || '", "props": ' || replace(props, ' ', '') || '}'"""


@query(f"SELECT event_id, event_id AS k, user_id AS second, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS inner_k, {_VARIANT_OUT} AS document FROM events")
def json_variant(spark, sf_dir):
    """JSON with a repeated key and loose blanks as VARIANT, stored, read back, looked into and printed."""
    store = _store(spark, "variant")
    events = t(spark, sf_dir, "events").select("event_id", F.expr(_VARIANT_IN).alias("document"))
    store.write("events", variants.parsed(events, "document"))
    found = {"k": ("$.k", "long"), "second": ("$.ids[1]", "long"), "inner_k": ("$.props.k", "long")}
    got = {n: variants.get("document", *where) for n, where in found.items()}
    return store.read("events").select("event_id", *[c.alias(n) for n, c in got.items()], variants.jsonb_text("document").alias("document"))


# Catalog: names and types from the tables' own footers, keys found in the data

_TYPE_SQL = """
CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
    ELSE lower(column_type) END
"""


def _described(name: str) -> str:
    return f"SELECT column_name, CAST(row_number() OVER () AS INTEGER) AS ordinal_position, {_TYPE_SQL} AS data_type FROM (DESCRIBE {name})"


_COLUMNS_SQL = "(" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, * FROM ({_described(n)})" for n in _COUNTED) + ")"
# First and second column of each table, and columns named as another table's first, for the SQL.
_FIRST = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"),
    "part": ("p_partkey", "p_name"), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey"), "events": ("event_id", "ts"),
    "documents": ("doc_id", "text"), "embeddings": ("vec_id", "embedding"), "pages": ("page_id", "url"), "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality"), "conversations": ("conv_id", "turn"),
}
_NAMED = [
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("labels", "doc_id", "documents"),
    ("documents", "doc_id", "labels"),
]


def _key_sql(table: str) -> str:
    a, b = _FIRST[table]
    two = f"COUNT(*) = COUNT(DISTINCT ({a}, {b})) AND COUNT(*) = COUNT({a}) AND COUNT(*) = COUNT({b})"
    return f"SELECT '{table}' AS table_name, CASE WHEN COUNT(*) = COUNT(DISTINCT {a}) THEN ['{a}'] WHEN {two} THEN ['{a}', '{b}'] END AS columns FROM {table}"


def _parent_sql(child: str, column: str, parent: str) -> str:
    key = _FIRST[parent][0]
    orphans = f"SELECT 1 FROM {child} c WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"
    return f"SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS ref_table, '{key}' AS ref_column WHERE NOT EXISTS ({orphans})"


_KEYS_CTE = f"""
k AS (SELECT * FROM ({" UNION ALL ".join(map(_key_sql, _FIRST))}) WHERE columns IS NOT NULL),
f AS (SELECT f.* FROM ({" UNION ALL ".join(_parent_sql(*x) for x in _NAMED)}) f JOIN k ON k.table_name = f.ref_table AND k.columns = [f.ref_column])
"""


def _columns(spark, sf_dir):
    return catalog_source.read(spark, sf_dir, "columns", *_COUNTED)


def _declared(spark, sf_dir, kind: str) -> DataFrame:
    """A catalog table of a store with empty clones of the tables, whose keys are those that hold in the data."""
    store, tables = _store(spark, "catalog"), {n: t(spark, sf_dir, n) for n in _COUNTED}
    for name, entries in introspection.discover(tables).items():
        store.create(name, structure.declare(tables[name], entries).schema)
    return catalog_source.read(spark, store.path, kind)


@query(f"SELECT DISTINCT table_name FROM {_COLUMNS_SQL} ORDER BY 1")
def list_tables(spark, sf_dir):
    return introspection.list_tables(catalog_source.read(spark, sf_dir, "tables", *_COUNTED))


_LISTED = f"SELECT table_name, string_agg(column_name, ', ' ORDER BY ordinal_position) AS columns FROM {_COLUMNS_SQL} GROUP BY 1"


@query(_LISTED)
def table_columns(spark, sf_dir):
    return introspection.table_columns(_columns(spark, sf_dir))


@query(_LISTED)
def table_columns_of_data(spark, sf_dir):
    """The same look-up over a store that the tables' structure has been cloned into."""
    store = _store(spark, "clones")
    for name in _COUNTED:
        store.create(name, t(spark, sf_dir, name).schema)
    return introspection.table_columns(catalog_source.read(spark, store.path, "columns"))


@query(f"WITH {_KEYS_CTE} SELECT table_name, array_to_string(columns, ', ') AS key_columns FROM k")
def primary_key_columns(spark, sf_dir):
    tables = catalog_source.read(spark, sf_dir, "tables", *_COUNTED)
    return introspection.primary_key_columns(_columns(spark, sf_dir), _declared(spark, sf_dir, "constraints"), tables)


@query(f"""
WITH {_KEYS_CTE}, u AS (SELECT table_name, unnest(columns) AS column_name FROM k)
SELECT table_name, string_agg(column_name || ' = EXCLUDED.' || column_name, ', ' ORDER BY ordinal_position) AS assignments
FROM {_COLUMNS_SQL} ANTI JOIN u USING (table_name, column_name) GROUP BY 1
""")
def update_columns(spark, sf_dir):
    return introspection.update_columns(_columns(spark, sf_dir), _declared(spark, sf_dir, "constraints"))


@query(f"WITH {_KEYS_CTE} SELECT DISTINCT ref_table FROM f")
def referenced_tables(spark, sf_dir):
    return introspection.referenced_tables(_declared(spark, sf_dir, "constraints"))


_CHANGES = ("ts", "o_orderdate", "l_shipdate")


@query(f"""
SELECT table_name, arg_min(column_name, list_position({list(_CHANGES)}, column_name)) AS column_name FROM {_COLUMNS_SQL}
WHERE column_name IN {_CHANGES} AND data_type IN ('timestamp_ntz', 'timestamp', 'date') GROUP BY 1
""")
def detect_timestamp_column(spark, sf_dir):
    return introspection.detect_timestamp_column(_columns(spark, sf_dir), _CHANGES)


@query(f"""
WITH {_KEYS_CTE}
SELECT table_name, table_name || '_pkey' AS conname, 'p' AS contype, 'PRIMARY KEY (' || array_to_string(columns, ', ') || ')' AS definition FROM k
UNION ALL SELECT table_name, table_name || '_' || column_name || '_fkey', 'f',
    'FOREIGN KEY (' || column_name || ') REFERENCES ' || ref_table || '(' || ref_column || ')' FROM f
""")
def constraint_list(spark, sf_dir):
    return introspection.constraint_list(_declared(spark, sf_dir, "constraints"))


@query(_described("orders"))
def empty_clone(spark, sf_dir):
    source, clone = _store(spark, "source"), _store(spark, "clone")
    source.write("orders", t(spark, sf_dir, "orders"))
    clone.clone_schema("orders", source)
    return catalog_source.read(spark, clone.path, "columns", "orders").select("column_name", "ordinal_position", "data_type")


@query(_described("customer"))
def clone_schema(spark, sf_dir):
    """Columns of one of the tables, whose footer alone is opened."""
    return catalog_source.read(spark, sf_dir, "columns", "customer").select("column_name", "ordinal_position", "data_type")


@query(f"""
SELECT column_name, ordinal_position, data_type, column_name NOT IN ('o_orderkey', 'o_orderstatus') AS is_nullable,
    CASE column_name WHEN 'o_orderstatus' THEN '''O''' WHEN 'o_orderdate' THEN 'current_timestamp()' END AS column_default,
    CAST(CASE column_name WHEN 'o_orderstatus' THEN 1 WHEN 'o_orderpriority' THEN 15 END AS INTEGER) AS max_length
FROM ({_described("orders")})
""")
def clone_structure(spark, sf_dir):
    """A clone of a table that was loaded, with its defaults, lengths and columns without nulls."""
    source, clone = _store(spark, "source"), _store(spark, "clone")
    source.write("orders", _orders(spark, sf_dir))
    clone.clone_schema("orders", source)
    return catalog_source.read(spark, clone.path, "columns").drop("table_schema", "table_name")


@query(f"""
WITH RECURSIVE {_KEYS_CTE}, e AS (SELECT DISTINCT table_name AS child, ref_table AS parent FROM f),
w AS (SELECT DISTINCT table_name AS name, 0 AS level FROM {_COLUMNS_SQL} UNION SELECT e.child, w.level + 1 FROM w JOIN e ON e.parent = w.name)
SELECT name AS table_name, CAST(MAX(level) AS INTEGER) AS level FROM w GROUP BY 1
""")
def load_order(spark, sf_dir):
    found = introspection.edges(_declared(spark, sf_dir, "constraints"))
    return spark.createDataFrame(list(graph.levels(sorted(_COUNTED), found).items()), "table_name string, level int")


@query(f"""
WITH RECURSIVE {_KEYS_CTE}, w AS (SELECT 'nation' AS name UNION SELECT f.table_name FROM w JOIN f ON f.ref_table = w.name)
SELECT name AS table_name FROM w
""")
def cascade_closure(spark, sf_dir):
    found = introspection.edges(_declared(spark, sf_dir, "constraints"))
    return spark.createDataFrame([(x,) for x in graph.cascade(["nation"], found)], "table_name string")


# Constraints


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def check_pk(spark, sf_dir):
    return constraints.primary_key(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT p_name, COUNT(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1")
def check_unique(spark, sf_dir):
    return constraints.unique(t(spark, sf_dir, "part"), ["p_name"])


@query("SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def check_fk(spark, sf_dir):
    return constraints.foreign_key(t(spark, sf_dir, "orders"), "o_custkey", t(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT * FROM orders WHERE NOT o_orderstatus IN ('F', 'O')")
def check_values(spark, sf_dir):
    return constraints.check(t(spark, sf_dir, "orders"), "o_orderstatus IN ('F', 'O')")


@query("""
SELECT 'o_orderkey' AS column_name, COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS nulls FROM orders
UNION ALL SELECT 'o_orderstatus', COUNT(*) FILTER (WHERE NULLIF(o_orderstatus, 'P') IS NULL) FROM orders
""")
def check_not_null(spark, sf_dir):
    return constraints.not_null(t(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")), ["o_orderkey", "o_orderstatus"])


@query("SELECT c_custkey, c_name, CAST(1 AS INTEGER) AS quantity, 'pending' AS status FROM customer")
def fill_defaults(spark, sf_dir):
    return constraints.fill_defaults(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"quantity": 1, "status": "pending", "c_name": "none"})


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def delete_cascade(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    left, rest = constraints.delete_cascade(c, "c_custkey", c.where("c_acctbal < 0"), o, "o_custkey")
    return left.join(rest, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


# Generator and scalar functions

def _md5(salt: str) -> str:
    return f"md5(id::VARCHAR || '{salt}')"


_VERSION = "CAST(CAST('0x' || substr(md5(id::VARCHAR || 'v'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 10 AS INTEGER)"
_IDS = "(SELECT unnest(range(1, (SELECT COUNT(*) + 1 FROM part))) AS id)"
_ARRAY = "[md5(id::VARCHAR || 'a' || i::VARCHAR) FOR i IN range(1, 11)]"
_JSON = "to_json({'id': id, " + ", ".join(f"'data{n}': {_md5(f'd{n}')}" for n in range(1, 6)) + f", 'array_data': {_ARRAY}, 'metadata': {{'created': '2024-01-01', 'updated': '2024-01-01', 'version': {_VERSION}}}}})::VARCHAR"


@query(f"""
SELECT id, length(repeat({_md5('x')} || {_md5('y')}, 32)) AS n_chars, md5(repeat({_md5('x')} || {_md5('y')}, 32)) AS large_md5, {_JSON} AS json_data, lower(hex(unhex({_md5('b')} || {_md5('c')}))) AS binary_hex
FROM {_IDS}
""")
def generate_rows(spark, sf_dir):
    g = datagen.generate(spark, t(spark, sf_dir, "part").count())
    return g.select("id", F.length("large_data").cast("long").alias("n_chars"), F.md5(F.col("large_data").cast("binary")).alias("large_md5"), "json_data", F.lower(F.hex("binary_data")).alias("binary_hex"))


_KEYED = "(SELECT o_orderkey AS id FROM orders)"


@query(f"""
SELECT id, length(repeat({_md5('x')} || {_md5('y')}, 32)) AS n_chars, md5(repeat({_md5('x')} || {_md5('y')}, 32)) AS large_md5, md5({_JSON}) AS json_md5, lower(hex(unhex({_md5('b')} || {_md5('c')}))) AS binary_hex
FROM {_KEYED}
""")
def generate_rows_by_key(spark, sf_dir):
    """A generated row for each order, so the job grows with the data."""
    g = datagen.generate_for(_ids(spark, sf_dir))
    large = F.md5(F.col("large_data").cast("binary")).alias("large_md5")
    return g.select("id", F.length("large_data").cast("long").alias("n_chars"), large, F.md5(F.col("json_data").cast("binary")).alias("json_md5"), F.lower(F.hex("binary_data")).alias("binary_hex"))


def _ids(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


@query(f"SELECT id, {_JSON} AS json_data FROM {_KEYED}")
def json_build(spark, sf_dir):
    return _ids(spark, sf_dir).select("id", datagen.json_column().alias("json_data"))


@query(f"SELECT id, to_json({_ARRAY})::VARCHAR AS array_data FROM {_KEYED}")
def json_array_build(spark, sf_dir):
    array = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.md5(F.concat(F.col("id").cast("string"), F.lit("a"), i.cast("string")).cast("binary")))
    return _ids(spark, sf_dir).select("id", F.to_json(array).alias("array_data"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity / 2 AS INTEGER) AS half FROM lineitem")
def cast_round(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.to_int_half_even(F.col("l_quantity") / 2).alias("half"))


_SCALED = "CAST(floor((n + {half}) / {unit}::DOUBLE) AS BIGINT)::VARCHAR"
_PRETTY = "CASE WHEN abs(n) < 10240 THEN n::VARCHAR || ' bytes' " + " ".join(f"WHEN abs(n) < {20479 << (10 * k - 1)} THEN {_SCALED.format(half=1 << (10 * k - 1), unit=1 << (10 * k))} || ' {u}'" for k, u in ((1, "kB"), (2, "MB"), (3, "GB"))) + f" ELSE {_SCALED.format(half=1 << 39, unit=1 << 40)} || ' TB' END"


@query(f"SELECT id, {_PRETTY} AS size FROM (SELECT id, (id % 100000) * (id % 100000) * (id % 100000) * 1021 AS n FROM {_KEYED})")
def size_pretty(spark, sf_dir):
    part = F.col("id") % 100_000  # of any key; sizes from bytes to many TB
    return _ids(spark, sf_dir).select("id", scalars.size_pretty(part * part * part * 1021).alias("size"))


@query("SELECT c_custkey, regexp_replace('postgresql://' || c_mktsegment || ':' || c_name || '@host:5432/db', ':[^:]*@', ':***@') AS dsn FROM customer")
def mask_dsn(spark, sf_dir):
    dsn = F.concat(F.lit("postgresql://"), "c_mktsegment", F.lit(":"), "c_name", F.lit("@host:5432/db"))
    return t(spark, sf_dir, "customer").select("c_custkey", scalars.mask_dsn(dsn).alias("dsn"))


@query(f"""
SELECT id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS duration
FROM (SELECT id, id * 7 AS s FROM {_KEYED})
""")
def format_duration(spark, sf_dir):
    return _ids(spark, sf_dir).select("id", scalars.format_duration(F.col("id") * 7).alias("duration"))


@query("SELECT * FROM (SELECT n_name AS line FROM nation ORDER BY n_nationkey LIMIT 10) UNION ALL SELECT '... and ' || (COUNT(*) - 10)::VARCHAR || ' more' FROM nation")
def dry_run_summary(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    first = nation.orderBy("n_nationkey").limit(10).select(F.col("n_name").alias("line"))
    return first.unionByName(nation.agg(F.concat(F.lit("... and "), (F.count("*") - 10).cast("string"), F.lit(" more")).alias("line")))


# An extension: a hierarchy walked from its roots, suppliers under the one with a third of their number


@query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS category_id, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent_id FROM supplier),
w AS (SELECT category_id, category_id AS root, 0 AS depth FROM c WHERE parent_id IS NULL
    UNION ALL SELECT c.category_id, w.root, w.depth + 1 FROM w JOIN c ON c.parent_id = w.category_id)
SELECT * FROM w
""")
def category_tree(spark, sf_dir):
    parent = F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3))
    t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("category_id"), parent.alias("parent_id")).createOrReplaceTempView("millrace_categories")
    return spark.sql(
        "WITH RECURSIVE w AS (SELECT category_id, category_id AS root, 0 AS depth FROM millrace_categories WHERE parent_id IS NULL "
        "UNION ALL SELECT c.category_id, w.root, w.depth + 1 FROM w JOIN millrace_categories c ON c.parent_id = w.category_id) SELECT * FROM w"
    )
