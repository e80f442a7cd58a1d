"""CSV, columns that differ, databases, the catalog, VARIANT, sequences, scheduling, structure and backups."""

import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import variants
from millrace.operators import introspection, strategies
from millrace.plans import backup, loads, runner
from millrace.sources import catalog_source, delimited, structure
from millrace.sources.databases import Database, jdbc_url
from millrace.sources.sequences import Sequence
from millrace.sources.store import Store
from millrace.sources.structure import ColumnMismatch


def table(spark, rows, schema="id int, v string"):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# CSV


@pytest.mark.parametrize("values", [["a", None, "", None], ["a\nb", None, "", None, "\n", "x\r\ny\n"], [None], ["\r", None, " ", '"', '""\n"'], []])
def test_csv_of_one_column(spark, tmp_path, values):
    df = table(spark, [(v,) for v in values], "v string")
    delimited.export(df, str(tmp_path / "c"))
    assert got(delimited.load(spark, str(tmp_path / "c"), "v string")) == got(df)


@pytest.mark.parametrize("end", ["", "\n", ",\r\n"])
def test_csv_of_long_and_odd_fields(spark, tmp_path, end):
    texts = ['"' * 100_001 + end, "z" * 200_000, "\r", "a\rb", "  x ", "\t", "#c", "\\", '\\"', "\x00n", " ", "''", '",', "t", ""]
    df = table(spark, [(n, x, None) for n, x in enumerate(texts)], "i int, s string, e string")
    delimited.export(df, str(tmp_path / "c"))
    assert got(delimited.load(spark, str(tmp_path / "c"), df.schema)) == got(df)


@pytest.mark.parametrize(
    "text,schema,want",
    [
        ('1,"x"\r\n2,\r\n3,""\r\n', "i int, s string", [(1, "x"), (2, None), (3, "")]),
        ('1,"x\r\ny"\r\n2,\r\n3,""', "i int, s string", [(1, "x\r\ny"), (2, None), (3, "")]),
        ('x\r\n\r\n""\r\n', "s string", [("",), ("x",), (None,)]),
        ('"x\r\nz"\r\n\r\n""\r\n', "s string", [("",), ("x\r\nz",), (None,)]),
        ("1,a", "i int, s string", [(1, "a")]),
        ("1,a\n2\n", "i int, s string", None),
        ("1,a\n2,b,c\n", "i int, s string", None),
        ("1,a\n\n", "i int, s string", None),
        ("x,a\n", "i int, s string", None),
    ],
)
def test_csv_files_of_others(spark, tmp_path, text, schema, want):
    (tmp_path / "a.csv").write_text(text, newline="")
    if want is None:  # fields too few, too many, or of another type
        with pytest.raises(Exception):
            delimited.load(spark, str(tmp_path), schema).collect()
    else:
        assert got(delimited.load(spark, str(tmp_path), schema)) == sorted(want, key=repr)


def test_a_large_csv_file_is_read_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.range(200_000).select("id", F.concat(F.lit('"'), F.repeat(F.lit("x"), 40)).alias("s"))
        delimited.export(df.coalesce(1), str(tmp_path / "c"))
        back = delimited.load(spark, str(tmp_path / "c"), df.schema)
        assert back.rdd.getNumPartitions() > 5 and back.count() == 200_000 and back.exceptAll(df).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_run_through_csv_loses_nothing_and_leaves_nothing(spark, tmp_path):
    source, target = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    source.write("one", table(spark, [("a",), (None,), ("",), ("x\ny",)], "v string"))
    report = runner.run(spark, runner.Config(source.path, target.path, "full", csv=str(tmp_path / "csv")))
    assert report.ok and got(target.read("one")) == got(source.read("one")) and list((tmp_path / "csv").iterdir()) == []


# Columns that differ

MODES = ("full", "append", "incremental", "upsert")


@pytest.mark.parametrize("mode", MODES)
def test_columns_that_differ_are_an_error_or_added(spark, tmp_path, mode):
    source, target = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    config = lambda **more: runner.Config(source.path, target.path, mode, keys={"t": ["id"]}, incremental_column="id", **more)
    target.write("t", table(spark, [(1, "a"), (2, "b")]))
    source.write("t", table(spark, [(2 if mode == "upsert" else 3, "c", 7)], "id int, v string, more int"))
    report = runner.run(spark, config())
    assert not report.ok and "more" in report.tables["t"]["error"]
    if mode != "full":  # which has emptied the table
        assert got(target.read("t")) == [(1, "a"), (2, "b")]
    target.write("t", table(spark, [(1, "a"), (2, "b")]))
    assert runner.run(spark, config(add_columns=True)).ok
    want = {"full": [(3, "c", 7)], "upsert": [(1, "a", None), (2, "c", 7)]}.get(mode, [(1, "a", None), (2, "b", None), (3, "c", 7)])
    assert got(target.read("t")) == sorted(want, key=repr)

    target.write("t", table(spark, [(1, "a")]))
    source.write("t", table(spark, [(9,)], "id int"))  # a column is missing
    report = runner.run(spark, config(marks={"t": 5}))
    assert not report.ok and "have no column v" in report.tables["t"]["error"]
    assert runner.run(spark, config(marks={"t": 5}, add_columns=True)).ok and (9, None) in got(target.read("t"))

    target.write("t", table(spark, [(1, "a")]))
    source.write("t", table(spark, [("12", 5)], "id string, v int"))  # other types, whose values fit
    assert runner.run(spark, config(marks={"t": "0"})).ok and (12, "5") in got(target.read("t"))
    source.write("t", table(spark, [("x", 5)], "id string, v int"))  # and one that doesn't
    assert not runner.run(spark, config(marks={"t": "0"})).ok


def test_strategies_refuse_columns_that_differ(spark):
    a, more, less = table(spark, [(1, "a")]), table(spark, [(1, "b", 2)], "id int, v string, w int"), table(spark, [(1,)], "id int")
    for mode in MODES:
        for other in (more, less):
            with pytest.raises(ColumnMismatch):
                strategies.apply(mode, a, other, ["id"])


def test_values_are_validated(spark, tmp_path, monkeypatch):
    source, target = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    source.write("t", table(spark, [(n, str(n)) for n in range(50)]))
    assert runner.run(spark, runner.Config(source.path, target.path, "full")).values == {"t": True}
    assert runner.run(spark, runner.Config(source.path, target.path, "full", values=False)).values == {"t": None}
    read = loads._Staged.read
    monkeypatch.setattr(loads._Staged, "read", lambda s: read(s).withColumn("v", F.lit("lost")))
    report = runner.run(spark, runner.Config(source.path, target.path, "full"))
    assert report.values == {"t": False} and not report.ok and report.validation[0] == {"table": "t", "source": 50, "target": 50}


# Databases


@pytest.fixture
def database(spark):
    db = Database(spark, "jdbc:derby:memory:tests;create=true", partitions=3)
    yield db
    for t in sorted(db.tables(), key=lambda t: t not in ("orders", "child")):
        db.drop(t)


SHOP = {"id": {"key": 1}, "v": {"length": 5, "not_null": True, "default": "'new'"}}


def test_urls_of_databases(spark):
    assert jdbc_url("postgresql://me:p%40ss@host:5432/shop") == ("jdbc:postgresql://host:5432/shop", {"user": "me", "password": "p@ss"})
    with pytest.raises(ValueError):
        Database(spark, "jdbc:unknown:x")


def test_a_database_is_read_in_ranges_with_filters_pushed(spark, database, capsys):
    database.create("orders", structure.declare(table(spark, []), SHOP).schema)
    assert database.load("orders", table(spark, [(n, "abc"[n % 3]) for n in range(300)]), "append") == (300, 300, 0)
    df = database.read("orders")
    assert df.rdd.getNumPartitions() == 3 and df.count() == database.count("orders") == 300 and structure.keys(df.schema) == ["id"]
    few = df.where("v = 'b' AND id > 100").select("id")
    few.explain()
    plan = capsys.readouterr().out
    assert "*EqualTo(v,b)" in plan and "ReadSchema: struct<id:int>" in plan and "Filter" not in plan.replace("PushedFilters", "")
    assert few.count() == len([n for n in range(101, 300) if n % 3 == 1])


def test_a_database_keeps_what_a_structure_promises(spark, database):
    database.create("parent", structure.declare(table(spark, []), SHOP).schema)
    child = structure.declare(table(spark, [], "id int, parent_id int, at timestamp_ntz"), {"id": {"key": 1}, "parent_id": {"references": "parent.id"}, "at": {"default": "current_timestamp()"}})
    database.create("child", child.schema)
    assert database.references("child") == [("parent_id", "parent", "id")] and database.keys("child") == ["id"]
    database.execute('INSERT INTO "parent" ("id") VALUES (1)')
    assert got(database.read("parent")) == [(1, "new")]
    for bad in (table(spark, [(1, "x")]), table(spark, [(2, None)]), table(spark, [(3, "toolong")]), table(spark, [(4, "a"), (4, "b")])):
        with pytest.raises(Exception):
            database.load("parent", bad, "append")
    with pytest.raises(Exception):  # no such parent
        database.load("child", table(spark, [(1, 9, datetime(2024, 1, 1))], "id int, parent_id int, at timestamp_ntz"), "append")
    with pytest.raises(ColumnMismatch):
        database.load("parent", table(spark, [(1,)], "id int"), "append")
    assert got(database.read("parent")) == [(1, "new")] and database.count("child") == 0
    assert database.tables() == ["child", "parent"]  # no staging table is left


def test_runs_between_a_database_and_a_store(spark, database, tmp_path):
    source = Store(spark, str(tmp_path / "a"))
    source.write("orders", structure.declare(table(spark, [(1, "a"), (2, "b")]), SHOP))
    assert runner.run(spark, runner.Config(source.path, database.url, "full")).ok
    source.write("orders", structure.declare(table(spark, [(2, "B"), (3, "c")]), SHOP))
    report = runner.run(spark, runner.Config(source.path, database.url, "upsert"))
    assert report.ok and (report.tables["orders"]["rows"], report.tables["orders"]["inserted"], report.tables["orders"]["updated"]) == (2, 1, 1)
    assert got(database.read("orders")) == [(1, "a"), (2, "B"), (3, "c")]
    assert not runner.run(spark, runner.Config(source.path, database.url, "append")).ok and database.count("orders") == 3
    back = str(tmp_path / "b")
    assert runner.run(spark, runner.Config(database.url, back, "upsert")).ok  # the key is the database's own
    assert got(Store(spark, back).read("orders")) == got(database.read("orders")) and Store(spark, back).keys("orders") == ["id"]


# Catalog


def test_the_catalog_opens_only_the_tables_asked_for(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("users", structure.declare(table(spark, [(1, "a")]), SHOP))
    store.write("orders", structure.declare(table(spark, [], "b int, a int, user_id int"), {"a": {"key": 1}, "b": {"key": 2}, "user_id": {"references": "users.id", "cascade": True}}))
    (tmp_path / "s" / "torn.parquet").write_bytes(b"no footer")
    columns, constraints = (catalog_source.read(spark, store.path, k, "users", "orders") for k in ("columns", "constraints"))
    assert got(catalog_source.read(spark, store.path, "columns", "users").drop("table_schema")) == [("users", "id", 1, "int", False, None, None), ("users", "v", 2, "string", False, "'new'", 5)]
    assert columns.where("table_name = 'users'").count() == 2 and columns.count() == 5  # filters of one query don't stay for the next
    with pytest.raises(Exception):
        catalog_source.read(spark, store.path, "columns").collect()
    assert got(introspection.primary_key_columns(columns, constraints)) == [("orders", "a, b"), ("users", "id")]
    plan = introspection.key_columns(columns, constraints)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(conkey" in plan
    assert got(introspection.constraint_list(constraints))[1][3] == "FOREIGN KEY (user_id) REFERENCES users(id) ON DELETE CASCADE"
    assert got(catalog_source.read(spark, store.path, "tables").select("table_name")) == [("orders",), ("torn",), ("users",)]
    assert introspection.edges(constraints) == [("orders", "users")]
    assert catalog_source.read(spark, str(tmp_path / "nothing"), "tables").count() == 0


def test_keys_found_in_data(spark):
    tables = {
        "p": table(spark, [(1, "x"), (2, "x")], "p_partkey int, p_name string"), "l": table(spark, [(1, 1), (1, 2)], "l_partkey int, l_n int"),
        "n": table(spark, [(None, 1), (3, 1)], "n_partkey int, n_x int"), "e": table(spark, [], "e_key int"),
    }
    assert introspection.discover(tables) == {
        "p": {"p_partkey": {"key": 1}}, "l": {"l_partkey": {"key": 1, "references": "p.p_partkey"}, "l_n": {"key": 2}}, "n": {}, "e": {"e_key": {"key": 1}},
    }


def test_declared_keys_and_parents_guide_a_run(spark, tmp_path):
    source, target = Store(spark, str(tmp_path / "a")), str(tmp_path / "b")
    source.write("a_child", structure.declare(table(spark, [(1, 1), (2, 5)], "id int, p int"), {"id": {"key": 1}, "p": {"references": "z_parent.id"}}))
    source.write("z_parent", structure.declare(table(spark, [(1, "a")]), SHOP))
    for _ in range(2):
        report = runner.run(spark, runner.Config(source.path, target, "upsert"))
    assert list(report.tables) == ["z_parent", "a_child"] and Store(spark, target).count("a_child") == 2
    assert report.violations["a_child.p"] == 1 and report.violations["z_parent primary key"] == 0


# VARIANT


def test_variants(spark, tmp_path):
    rows = [(1, '{"zz": 1, "b":2, "b":3, "a":{"y":1,"x":[1, 2]}, "aa":"q\\"\\u00e9", "":null}'), (2, '[1, {"b":1,"a":2}]'), (3, None), (4, "7"), (5, "{}"), (6, '{"k": 1.50}')]
    store = Store(spark, str(tmp_path / "s"))
    store.write("t", variants.parsed(table(spark, rows, "i int, p string"), "p"))
    df = store.read("t")
    assert dict(df.dtypes)["p"] == "variant"
    printed = dict(got(df.select("i", variants.jsonb_text("p"))))
    assert printed == {1: '{"": null, "a": {"x":[1,2],"y":1}, "b": 3, "aa": "q\\"é", "zz": 1}', 2: '[1,{"a":2,"b":1}]', 3: None, 4: "7", 5: "{}", 6: '{"k": 1.5}'}
    assert got(df.where("i < 3").select("i", variants.get("p", "$.b", "int"), variants.get("p", "$.a.x[1]", "int"), variants.get("p", "$[1].b", "int"))) == [(1, 3, 2, None), (2, None, None, 1)]
    with pytest.raises(Exception):
        variants.parsed(table(spark, [(1, "{")], "i int, p string"), "p").collect()
    assert got(variants.parsed(table(spark, [(1, "{")], "i int, p string"), "p", lenient=True).select(variants.text("p"))) == [(None,)]
    loads.load(store, "t", variants.parsed(table(spark, [(1, "[]")], "i int, p string"), "p"), "upsert", ["i"])
    assert dict(got(store.read("t").select("i", variants.text("p"))))[1] == "[]"


# Sequences


def test_sequences_leave_no_gap_and_repeat_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("t", structure.declare(table(spark, [], "id long, v string"), {"id": {"key": 1, "sequence": "t_id_seq"}}).schema)
    rows = lambda n, k: spark.range(n).select(F.col("id").cast("string").alias("v")).repartition(k)
    assert loads.load(store, "t", rows(100, 7), "append", ["id"]).rows == 100
    assert loads.load(store, "t", rows(0, 1), "append", ["id"]).rows == 0
    assert loads.load(store, "t", rows(50, 3), "append", ["id"]).rows == 50
    assert sorted(r.id for r in store.read("t").collect()) == list(range(1, 151)) and Sequence(store, "t_id_seq").last() == 150
    given = loads.load(store, "t", table(spark, [(500, "own")], "id long, v string"), "append", ["id"])  # numbers of its own
    assert given.rows == 1 and Sequence(store, "t_id_seq").last() == 150 and store.tables() == ["t"]
    taken, many = [], Sequence(store, "many", 10)

    def take():
        for _ in range(5):
            taken.append(Sequence(store, "many", 10).take(3))

    threads = [threading.Thread(target=take) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(taken) == list(range(10, 70, 3)) and many.last() == 69


# Scheduling and counts


def test_a_slow_table_does_not_hold_up_others(spark, tmp_path):
    """The child of a quick parent is loaded while another table of the parent's level still loads."""
    source, target = Store(spark, str(tmp_path / "a")), str(tmp_path / "b")
    for name in ("slow", "parent", "child", "grandchild"):
        source.write(name, table(spark, [(1, "a")]))
    ended, load = {}, runner.Run._load

    class Slow(runner.Run):
        def _load(self, t):
            pool = self.spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            if t == "slow":
                for _ in range(600):
                    if "grandchild" in ended:
                        break
                    time.sleep(0.1)
            out = load(self, t)
            ended[t] = (time.time(), pool)
            return out

    r = Slow(spark, runner.Config(source.path, target, "full", threads=2, edges=(("child", "parent"), ("grandchild", "child"))))
    r.schema()
    r.data()
    assert all(x["status"] == "loaded" for x in r.report.tables.values())
    assert ended["parent"] < ended["child"] < ended["grandchild"] < ended["slow"]


def test_a_source_is_read_once_and_its_rows_are_counted(spark, tmp_path):
    source, target = Store(spark, str(tmp_path / "a")), str(tmp_path / "b")
    seen = spark.sparkContext.accumulator(0)

    def look(n):
        seen.add(1)
        return n >= 0

    spark.udf.register("looked_at", F.udf(look, "boolean").asNondeterministic())
    source.write("t", table(spark, [(n, str(n)) for n in range(100)]))
    for mode, want in (("full", (100, 100, 0)), ("upsert", (100, 0, 100)), ("append", None)):
        before = seen.value
        report = runner.run(spark, runner.Config(source.path, target, mode, keys={"t": ["id"]}, where={"t": "looked_at(id)"}))
        assert seen.value - before == 100, mode
        got_ = report.tables["t"]
        assert got_["status"] == "failed" if want is None else (got_["rows"], got_["inserted"], got_["updated"]) == want and report.ok
    assert Store(spark, target).count("t") == 100
    source.write("t", table(spark, [(n, "x") for n in range(90, 120)]))
    got_ = runner.run(spark, runner.Config(source.path, target, "upsert", keys={"t": ["id"]})).tables["t"]
    assert (got_["rows"], got_["inserted"], got_["updated"]) == (30, 20, 10)


def test_loads_by_whole_keys_and_what_a_failed_one_leaves(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("t", table(spark, [(1, "a"), (2, "b"), (None, "n")]))
    out = loads.load(store, "t", table(spark, [(2, "b"), (3, "c"), (None, "n")]), "upsert", ["id", "v"])
    assert (out.rows, out.inserted, out.updated, out.same) == (3, 2, 0, True)
    assert got(store.read("t")) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "n"), (None, "n")], key=repr)
    before = {p.name for p in (tmp_path / "s" / "t").iterdir() if p.name.startswith("p-")}
    for mode, rows in (("append", [(3, "c")]), ("upsert", [(7, "a"), (7, "b")])):
        with pytest.raises(strategies.KeyConflict):
            loads.load(store, "t", table(spark, rows), mode, ["id"])
    assert {p.name for p in (tmp_path / "s" / "t").iterdir() if p.name.startswith("p-")} == before


def rows_read(spark, action):
    """Rows that the stages of an action have read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    none = sc._gateway.new_array(jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    known = {stages().apply(k).stageId() for k in range(stages().size())}
    out = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    now = stages()
    return out, sum(now.apply(k).inputRecords() for k in range(now.size()) if now.apply(k).stageId() not in known)


def test_a_few_keys_are_looked_up_without_reading_the_others(spark, tmp_path):
    """Parts whose ranges all overlap: statistics exclude none of them, Bloom filters nearly all."""
    store, n = Store(spark, str(tmp_path / "s")), 20_000
    shape = structure.declare(spark.range(0), {"id": {"key": 1}})
    store.write("t", shape)
    for k in range(6):
        store.append("t", spark.range(n).select((F.col("id") * 12 + 2 * k).alias("id")).coalesce(1))
    changes = spark.createDataFrame([(12 * 77 + 4,), (12 * 15_000 + 4,), (7,), (None,)], "id long").coalesce(1)
    touched, read = rows_read(spark, lambda: store._touched("t", changes, ["id"]))
    assert list(touched.values()) == [2] and list(touched) == store.parts("t")[3:4]
    assert n <= read < 2 * n  # of 6 n rows
    many = spark.range(3, 12 * n, 12 * n // 300).toDF("id")
    (touched, read) = rows_read(spark, lambda: store._touched("t", many, ["id"]))
    assert sum(touched.values()) == 0 or read >= 5 * n
    loaded, read = rows_read(spark, lambda: loads.load(store, "t", spark.createDataFrame([(5,)], "id long"), "append", ["id"]))
    assert loaded.rows == 1 and read < n
    with pytest.raises(strategies.KeyConflict):
        loads.load(store, "t", spark.createDataFrame([(12 * 77 + 4,)], "id long"), "append", ["id"])


# Structure


def test_a_clone_refuses_nulls_and_fills_defaults(spark, tmp_path):
    source, target = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    shape = {"id": {"key": 1}, "v": {"length": 3, "default": "'new'", "comment": "a word"}, "at": {"default": "current_timestamp()", "not_null": True}, "w": {"not_null": True}}
    source.write("t", structure.declare(table(spark, [(1, "a", datetime(2024, 1, 1), 5)], "id int, v string, at timestamp_ntz, w int"), shape))
    target.clone_schema("t", source)
    assert target.count("t") == 0 and {f.name: f.metadata for f in target.read("t").schema} == shape
    assert target.keys("t") == ["id"] and structure.describe(target.read("t").schema)[1] == ("v", 2, "string", False, "'new'", 3, "a word")
    target.append("t", table(spark, [(1, 5)], "id int, w int"))
    row = target.read("t").first()
    assert (row.id, row.v, row.w) == (1, "new", 5) and abs((row.at - datetime.now()).total_seconds()) < 24 * 3600
    target.append("t", table(spark, [(2, None, 5)], "id int, v string, w int"))  # an explicit null stays
    assert {r.id: r.v for r in target.read("t").collect()} == {1: "new", 2: None}
    for rows, schema in (([(3, None)], "id int, w int"), ([(None, 5)], "id int, w int"), ([(3, "long", 5)], "id int, v string, w int"), ([(3,)], "id int")):
        with pytest.raises(Exception):
            target.append("t", table(spark, rows, schema))
        with pytest.raises(Exception):
            loads.load(target, "t", table(spark, rows, schema), "upsert", ["id"])
    assert target.count("t") == 2
    loads.load(target, "t", table(spark, [(2, "x", 6)], "id int, v string, w int"), "upsert", ["id"])
    assert {f.name: f.metadata for f in target.read("t").schema} == shape  # also after a merge
    with pytest.raises(ColumnMismatch):
        structure.declare(target.read("t"), {"none": {}})


def test_the_reference_tables_declare_what_they_promise(spark, tmp_path):
    from millrace.sources import catalog, seeds

    store = Store(spark, str(tmp_path / "s"))
    for t, df in (seeds.shop(spark) | {"categories": seeds.retail(spark)["categories"]}).items():
        store.write(t, df)
    assert store.keys("orders") == ["id"] and store.references("orders") == [("product_id", "products", "id"), ("user_id", "users", "id")]
    assert store.references("categories") == [("parent_category_id", "categories", "category_id")]
    found = catalog_source.read(spark, store.path, "columns", "orders").where("column_name = 'status'").first()
    assert (found.column_default, found.max_length, found.is_nullable) == ("'pending'", 20, True)
    Sequence(store, "users_id_seq").take(3)  # for the rows that are there
    new = table(spark, [("dan@example.com",)], "email string").withColumn("name", F.lit("Dan"))
    loads.load(store, "users", new, "append", ["id"])
    row = store.read("users").where("name = 'Dan'").first()
    assert (row.id, row.status) == (4, "active") and row.created_at is not None
    with pytest.raises(Exception):  # longer than the column
        store.append("users", table(spark, [(5, "x" * 101)], "id int, email string").withColumn("name", F.lit("x")))
    assert catalog.retail(spark)["product_categories"]["category_id"].metadata["cascade"] is True


def test_alter_and_merge_keep_structure(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField

    store = Store(spark, str(tmp_path / "s"))
    store.write("t", structure.declare(table(spark, [(1, "a")]), SHOP))
    store.alter("t", {"v": {"not_null": None, "comment": "was needed"}}, [StructField("w", IntegerType(), True, {"default": "7"}), StructField("x", StringType())])
    assert got(store.read("t")) == [(1, "a", 7, None)]
    store.alter("t", {"w": {"default": "8"}})
    store.append("t", table(spark, [(2, None)]).withColumn("x", F.lit("y")))
    assert got(store.read("t")) == sorted([(1, "a", 7, None), (2, None, 8, "y")], key=repr)
    up = lambda old, new: strategies.upsert(old, new, ["id"]).groupBy("id").agg(*[F.first(c).alias(c) for c in ("v", "w", "x")])
    store.merge("t", table(spark, [(1, "b", 1, "z")], "id int, v string, w int, x string"), ["id"], up)
    assert got(store.read("t")) == sorted([(1, "b", 1, "z"), (2, None, 8, "y")], key=repr)
    assert store.keys("t") == ["id"] and store.read("t").schema["v"].metadata == {"length": 5, "default": "'new'", "comment": "was needed"}
    with pytest.raises(ColumnMismatch):
        store.alter("t", {"none": {}})
    target = Store(spark, str(tmp_path / "b"))
    store.create("n", structure.declare(table(spark, []), {"id": {"sequence": "n_seq"}}).schema)
    Sequence(store, "n_seq").take(41)
    assert runner.run(spark, runner.Config(store.path, target.path, "full")).ok and Sequence(target, "n_seq").last() == 41


# Backups


def test_a_backup_copies_what_it_lacks_and_restores_any_snapshot(spark, tmp_path):
    store, copy = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    store.write("t", structure.declare(table(spark, [(n, "a") for n in range(500)]), SHOP), ["id"])
    first = backup.backup(store, copy)["t"]
    assert first == store.size("t") > 0 and backup.backup(store, copy) == {"t": 0}
    store.append("t", table(spark, [(900, "b")]))
    second = backup.backup(store, copy)["t"]
    assert 0 < second < first and sorted(backup.snapshots(copy, "t")) == [0, 1] and got(copy.read("t")) == got(store.read("t"))
    assert copy.keys("t") == ["id"]
    store.truncate("t")
    store.vacuum("t")
    assert backup.restore(copy, store, "t", 0) == first and store.count("t") == 500
    assert backup.restore(copy, store, "t") > 0 and store.count("t") == 501
    other = Store(spark, str(tmp_path / "c"))
    backup.restore(copy, other, "t")
    assert got(other.read("t")) == got(copy.read("t"))


def test_of_two_loads_at_a_time_one_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("t", table(spark, [(1, "a")]))
    after, parts, failed = store._pointers("t")[-1], store.parts("t"), []

    def point():
        try:
            store._point("t", parts, after)
        except RuntimeError:
            failed.append(1)

    threads = [threading.Thread(target=point) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(failed) == 3 and store.count("t") == 1


@pytest.mark.parametrize("mode", MODES)
def test_loads_of_nothing(spark, tmp_path, mode):
    source, target = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    source.write("t", table(spark, [(1, "a")]))
    source.write("none", table(spark, []))
    target.write("t", table(spark, [(5, "e")]))
    config = runner.Config(source.path, target.path, mode, keys={"t": ["id"], "none": ["id", "v"]}, where={"t": "1 = 0"})
    report = runner.run(spark, config)
    assert report.ok and [report.tables[t]["rows"] for t in ("t", "none")] == [0, 0] and report.values == {"t": True, "none": True}
    assert got(target.read("t")) == ([] if mode == "full" else [(5, "e")]) and target.count("none") == 0
