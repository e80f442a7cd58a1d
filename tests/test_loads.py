"""Strategies, constraints, load order and runs on small tables with awkward rows."""

import json
import signal
from datetime import datetime
from decimal import Decimal

import pytest

from millrace.operators import constraints, strategies
from millrace.plans import graph, runner
from millrace.sources import delimited
from millrace.sources.store import Store
from millrace.streaming import upsert


def table(spark, rows, schema="id int, v string"):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OLD, NEW = [(1, "a"), (2, "b"), (None, "n")], [(2, "B"), (3, "c"), (None, "m")]


def test_upsert_replaces_and_adds(spark):
    out = strategies.upsert(table(spark, OLD), table(spark, NEW), ["id"])
    assert got(out) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")], key=repr)


def test_upsert_binds_columns_by_name(spark):
    out = strategies.upsert(table(spark, OLD), table(spark, NEW).select("v", "id"), ["id"])
    assert out.columns == ["id", "v"] and (2, "B") in got(out)


def test_upsert_without_keys_appends_and_whole_row_keys_only_insert(spark):
    a, b = table(spark, [(1, "a")]), table(spark, [(1, "a"), (2, "b")])
    assert got(strategies.upsert(a, b, None)) == [(1, "a"), (1, "a"), (2, "b")]
    assert got(strategies.upsert(a, b, ["id", "v"])) == [(1, "a"), (2, "b")]


def test_empty_sides(spark):
    none, some = table(spark, []), table(spark, [(1, "a")])
    assert got(strategies.upsert(none, some, ["id"])) == got(strategies.upsert(some, none, ["id"])) == [(1, "a")]
    assert got(strategies.full(some, none)) == []


def test_repeated_keys_are_an_error(spark):
    twice = table(spark, [(1, "a"), (1, "b")])
    with pytest.raises(strategies.KeyConflict):
        strategies.apply("upsert", table(spark, OLD), twice, ["id"])
    with pytest.raises(strategies.KeyConflict):
        strategies.apply("append", table(spark, OLD), table(spark, [(1, "z")]), ["id"])
    strategies.check_keys(table(spark, [(None, "a"), (None, "b")]), ["id"])  # nulls never match
    strategies.check_absent(table(spark, OLD), table(spark, [(3, "c"), (None, "m"), (None, "n")]), ["id"])
    for rows in ([(1, "z")], [(3, "a"), (3, "b")]):
        with pytest.raises(strategies.KeyConflict):
            strategies.check_absent(table(spark, OLD), table(spark, rows), ["id"])


def test_incremental_is_strict_and_drops_null_marks(spark):
    rows = table(spark, [(1, "2024-01-01"), (2, "2024-01-02"), (3, None)])
    assert got(strategies.incremental_filter(rows, "v", "2024-01-01")) == [(2, "2024-01-02")]
    assert rows.count() == strategies.incremental_filter(rows, "v", None).count()
    with pytest.raises(ValueError):
        strategies.apply("other", rows, rows)


def test_constraints(spark):
    rows = table(spark, [(1, "card"), (1, "cash"), (None, None), (None, "gift")])
    assert got(constraints.primary_key(rows, ["id"])) == [(1, 2), (None, 2)]
    assert got(constraints.unique(rows, ["id"])) == [(1, 2)]
    assert got(constraints.check(rows, "v in ('cash', 'card')")) == [(None, "gift")]
    assert got(constraints.not_null(rows, ["id", "v"])) == [("id", 2), ("v", 1)]
    assert got(constraints.foreign_key(table(spark, [(1, "x"), (9, "y"), (None, "z")]), "id", table(spark, OLD), "id")) == [(9, "y")]
    parent, child = constraints.delete_cascade(table(spark, OLD), "id", table(spark, [(1, "")]), table(spark, [(7, 1), (8, 2)], "c int, p int"), "p")
    assert (1, "a") not in got(parent) and got(child) == [(8, 2)]


def test_order_of_tables():
    edges = [("orders", "users"), ("orders", "products"), ("items", "orders"), ("users", "users"), ("a", "b"), ("b", "a"), ("users", "elsewhere")]
    tables = ["items", "orders", "users", "products", "a", "b"]
    out = graph.order(tables, edges)
    assert sorted(out) == sorted(tables)
    assert all(out.index(p) < out.index(c) for c, p in edges[:3])
    assert graph.levels(tables, edges)["items"] == 2
    assert graph.cascade(["users"], edges) == ["items", "orders", "users"]


@pytest.fixture
def stores(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.write("users", table(spark, [(1, "a"), (2, "b"), (3, "c")]))
    a.write("orders", table(spark, [(10, 1), (11, 3)], "id int, user_id int"))
    return a, b


def load(spark, stores, mode, **over):
    edges, fks = (("orders", "users"),), (("orders", "user_id", "users", "id"),)
    return runner.run(spark, runner.Config(stores[0].path, stores[1].path, mode, edges=edges, foreign_keys=fks, **over))


def test_full_run_counts_filtered_rows_and_reports_orphans(spark, stores):
    assert load(spark, stores, "full").ok
    report = load(spark, stores, "full", where={"users": "id < 3"})
    assert [v["source"] == v["target"] for v in report.validation] == [True, True]
    assert report.violations == {"orders.user_id": 1} and not report.ok
    with pytest.raises(runner.LoadFailed):
        load(spark, stores, "full", where={"users": "id < 3"}, strict=True)


def test_upsert_run_repeats_without_change_and_counts_keyless_tables(spark, stores):
    keys = {"users": ["id"]}  # orders has none: its rows are appended
    assert load(spark, stores, "upsert", keys=keys).ok
    report = load(spark, stores, "upsert", keys=keys)
    assert report.ok and stores[1].count("users") == 3 and stores[1].count("orders") == 4


def test_failed_table_is_reported_and_left_as_it_was(spark, stores):
    keys = {"users": ["id"]}
    load(spark, stores, "full")
    report = load(spark, stores, "append", keys=keys)
    assert report.tables["users"]["status"] == "failed" and not report.ok
    assert stores[1].count("users") == 3 and stores[1].count("orders") == 2  # its child is not loaded


def test_children_of_a_failed_parent_are_skipped(spark, stores):
    load(spark, stores, "full")
    report = load(spark, stores, "append", keys={"users": ["id"]})
    assert report.tables["users"]["status"] == "failed" and report.tables["orders"]["status"] == "skipped" and not report.ok
    assert stores[1].count("orders") == 2


def test_null_keys_are_validated(spark, stores):
    stores[0].write("users", table(spark, [(1, "a"), (None, "n"), (None, "m")]))
    report = load(spark, stores, "upsert", keys={"users": ["id"]}, tables=("users",))
    assert report.validation == [{"table": "users", "source": 3, "target": 3}] and stores[1].count("users") == 3


def test_constraints_are_reported(spark, stores):
    stores[0].write("users", table(spark, [(1, "a"), (1, "a"), (3, None)]))
    report = load(spark, stores, "full", keys={"users": ["id"]}, unique=(("users", ["v"]),), checks=(("users", "id < 3"),), not_null={"users": ["id", "v"]})
    assert report.violations == {"users primary key": 1, "users unique v": 1, "orders.user_id": 0, "users check id < 3": 1, "users.id not null": 0, "users.v not null": 1}
    assert not report.ok


def test_marks_are_kept_in_the_target(spark, stores):
    first = load(spark, stores, "incremental", incremental_column="id", tables=("users",))
    assert first.marks == {"users": "3"} and stores[1].count("users") == 3
    stores[0].write("users", table(spark, [(2, "b"), (3, "c"), (4, "d")]))
    second = load(spark, stores, "incremental", incremental_column="id", tables=("users",))
    assert second.marks == {"users": "4"} and stores[1].count("users") == 4 and "_marks" not in stores[1].tables()
    again = load(spark, stores, "incremental", incremental_column="id", tables=("users",), marks={"users": "3"})
    assert again.validation == [{"table": "users", "source": 5, "target": 5}]


def test_a_torn_load_leaves_the_table_as_it_was(spark, stores):
    a = stores[0]
    fs, p = a._fs(f"{a.path}/users/_pending-x")
    fs.create(p).close()  # a pointer that was begun
    assert a.count("users") == 3
    bad = a.read("users").selectExpr("id", "raise_error(v) AS v")
    with pytest.raises(Exception):
        a.append("users", bad)
    assert a.count("users") == 3 and len(a.parts("users")) == 1
    old = a.read("users")
    a.append("users", table(spark, [(9, "z")]))
    assert old.count() == 3 and a.count("users") == 4 and len(a.parts("users")) == 2
    after = a._pointers("users")[-2]
    with pytest.raises(RuntimeError):  # another load came first
        a._point("users", [], after)
    a.vacuum("users")
    assert a.count("users") == 4 and not fs.exists(p)
    a.drop("users")
    assert a.tables() == ["orders"]


def test_a_merge_rewrites_only_parts_with_its_keys(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else rows this few share a part
    try:
        store, up = Store(spark, str(tmp_path / "s")), lambda old, new: strategies.upsert(old, new, ["id"])
        store.write("t", table(spark, [(n, str(n)) for n in range(200)] + [(None, "n")]), ["id"])
        before = store.parts("t")
        assert len(before) > 3
        old, changes = store.read("t"), table(spark, [("new", 7), ("more", 500), ("null", None)], "v string, id long")
        want = got(strategies.upsert(old, changes.select(changes.id.cast("int").alias("id"), "v"), ["id"]))
        store.merge("t", changes, ["id"], up)
        assert got(store.read("t")) == want and dict(store.read("t").dtypes) == {"id": "int", "v": "string"}
        assert len(set(before) - set(store.parts("t"))) == 1  # the part that held 7
        assert old.count() == 201  # a reader that began before the load
        store.vacuum("t")
        assert got(store.read("t")) == want
        now = store.parts("t")
        for rows in ([], [(None, "x")], [(900, "absent")]):
            store.merge("t", table(spark, rows), ["id"], up)
            assert set(now) <= set(store.parts("t"))  # nothing is rewritten
        assert store.count("t") == len(want) + 2
        store.append("t", spark.createDataFrame([(901, "y")], "id long, v string"), ["id"])
        store.merge("t", table(spark, [(901, "Y")]), ["id"], up)
        assert (901, "Y") in got(store.read("t")) and (901, "y") not in got(store.read("t"))
        with pytest.raises(Exception):  # beyond the column's type
            store.append("t", spark.createDataFrame([(1 << 40, "z")], "id long, v string"))
        store.write("two", spark.createDataFrame([(a, b, 0) for a in range(20) for b in "xy"], "a int, b string, c int"), ["b", "a"])
        whole = lambda old, new: strategies.upsert(old, new, ["b", "a"])
        store.merge("two", spark.createDataFrame([("x", 3, 1), ("z", 3, 1), (None, 3, 1)], "b string, a int, c int"), ["b", "a"], whole)
        assert store.count("two") == 42 and store.read("two").where("c = 1").count() == 3
        store.write("none", table(spark, []), ["id"])
        store.merge("none", table(spark, [(1, "a")]), ["id"], up)
        assert got(store.read("none")) == [(1, "a")]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clean_backup_and_stop(spark, stores, tmp_path):
    load(spark, stores, "full")
    assert load(spark, stores, "append", clean=True).ok and stores[1].count("users") == 3
    copy = Store(spark, str(tmp_path / "copy"))
    assert runner.backup(stores[1], copy) == ["orders", "users"] and copy.count("users") == 3
    left = []
    with pytest.raises(KeyboardInterrupt), runner.stoppable(spark, "tag", lambda: left.append(1)):
        signal.raise_signal(signal.SIGTERM)
    assert left == [1]


def test_config_retry_and_command(spark, stores, tmp_path, capsys):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"source": stores[0].path, "target": stores[1].path, "mode": "full", "tables": "users , orders", "threads": 2}))
    config = runner.Config.load(str(path), threads=3, dry_run=None)
    assert config.tables == ("users", "orders") and config.threads == 3 and not config.dry_run
    with pytest.raises(ValueError):
        runner.Config("a", "b", "other")
    assert runner.main([str(path), "--dry-run"]) == 0 and stores[1].tables() == []
    assert json.loads(capsys.readouterr().out)["tables"]["users"]["status"] == "planned"
    assert runner.main([str(path)]) == 0 and stores[1].count("users") == 3
    tries = []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert runner.retry(action, delay=0) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        runner.retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, delay=0)
    assert runner.progress(1, 4, 8) == "[##......] 25% (1/4)" and "100%" in runner.progress(0, 0)
    assert runner.throughput(10, 3) == 3 and runner.throughput(1, 0) is None


def test_csv_keeps_nulls_and_empty_strings(spark, tmp_path):
    schema = "i int, s string, b boolean, d decimal(10,2), t timestamp_ntz, x binary"
    when = datetime(2024, 1, 15, 8, 30, 15)
    rows = [(1, "", True, Decimal("1.50"), when, b"ab"), (2, None, None, None, None, None), (None, 'a "b", c\nd', False, Decimal("0.00"), when, b""), (4, ",", True, None, None, None), (5, "\n", None, None, None, None)]
    df = table(spark, rows, schema)
    delimited.export(df, str(tmp_path / "csv"))
    back = delimited.load(spark, str(tmp_path / "csv"), schema)
    assert got(back) == got(df) and back.schema.simpleString() == df.schema.simpleString()
    (tmp_path / "copy.csv").write_text('7,plain,t,2.00,2024-01-15 08:30:15,\\x6162\n8,"",,,,\n')
    assert got(delimited.load(spark, str(tmp_path / "copy.csv"), schema)) == sorted([(7, "plain", True, Decimal("2.00"), when, b"ab"), (8, "", None, None, None, None)], key=repr)


def test_dry_run_writes_nothing(spark, stores):
    report = load(spark, stores, "full", dry_run=True)
    assert report.tables["orders"] == {"status": "planned", "level": 1}
    assert stores[1].tables() == []


def test_dry_run_plans_every_table(spark, tmp_path):
    names = [f"t{n:02}" for n in range(13)]
    source = Store(spark, str(tmp_path / "many"))
    for t in names:
        source.write(t, spark.range(1).toDF("id"))
    config = runner.Config(source=str(tmp_path / "many"), target=str(tmp_path / "none"), mode="full", dry_run=True)
    assert runner.run(spark, config).tables == {t: {"status": "planned", "level": 0} for t in names}


def test_stream_of_changes(spark, stores, tmp_path):
    schema = "id int, v string, at int"
    table(spark, [(1, "x", 1), (1, "y", 2), (2, "z", 1)], schema).write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        upsert.start(changes, stores[1], "t", ["id"], "at", str(tmp_path / "cp")).awaitTermination(60)
    assert got(stores[1].read("t")) == [(1, "y", 2), (2, "z", 1)]
    table(spark, [(1, "late", 1), (2, "newer", 3), (3, "w", 1), (None, "n", 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    upsert.start(changes, stores[1], "t", ["id"], "at", str(tmp_path / "cp")).awaitTermination(60)
    assert got(stores[1].read("t")) == sorted([(1, "y", 2), (2, "newer", 3), (3, "w", 1), (None, "n", 1)], key=repr)
