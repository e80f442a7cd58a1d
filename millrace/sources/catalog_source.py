"""The catalog of a folder of Parquet tables, or of a store, as a Spark data source.

``millrace_catalog`` has three tables, chosen by the option ``kind``:

    tables       table_schema, table_name, table_type
    columns      table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default, max_length
    constraints  table_schema, table_name, conname, contype (p, u, f), conkey (ordinal positions), columns, ref_table, ref_columns, on_delete

Rows come from the tables' own footers, a table at a time and in as many tasks as there are tables:
names and types from the Parquet schema, keys and defaults from the metadata that ``structure`` puts
there. The option ``tables`` says which footers are opened. Filters are not pushed into the source:
Spark 4.1 keeps what one query has pushed for every later query of the same DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from . import structure

FORMAT = "millrace_catalog"
SCHEMAS = {
    "tables": "table_schema string, table_name string, table_type string",
    "columns": "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean, column_default string, max_length int",
    "constraints": (
        "table_schema string, table_name string, conname string, contype string, conkey array<int>, columns array<string>, "
        "ref_table string, ref_columns array<string>, on_delete string"
    ),
}
_SPARK = b"org.apache.spark.sql.parquet.row.metadata"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, sep, rest = path.partition("://")
    if sep:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme == "s3a" else path)
    return pafs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


def _listed(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda i: i.base_name)


def _tables(fs: pafs.FileSystem, base: str) -> dict[str, str]:
    """Paths of tables by name: what is called name.parquet, and folders with a store's pointer."""
    found = {}
    for i in _listed(fs, base):
        if i.base_name.startswith(("_", ".")):
            continue
        if i.base_name.endswith(".parquet"):
            found[i.base_name.removesuffix(".parquet")] = i.path
        elif i.type == pafs.FileType.Directory and any(x.base_name.startswith("current-") for x in _listed(fs, i.path)):
            found[i.base_name] = i.path
    return found


def _file(fs: pafs.FileSystem, path: str) -> str:
    """A file of the table, of its newest part if it is a store's."""
    if fs.get_file_info(path).type == pafs.FileType.File:
        return path
    pointers = [i for i in _listed(fs, path) if i.base_name.startswith("current-")]
    if pointers:
        with fs.open_input_stream(pointers[-1].path) as f:
            path = f"{path}/{f.read().decode().split()[-1]}"
    files = [i for i in _listed(fs, path) if i.base_name.endswith(".parquet")]
    return files[0].path if files else _file(fs, next(i.path for i in _listed(fs, path) if i.type == pafs.FileType.Directory))


def _shape(fs: pafs.FileSystem, path: str) -> StructType:
    schema = pq.read_schema(fs.open_input_file(_file(fs, path)))
    if written := (schema.metadata or {}).get(_SPARK):
        return StructType.fromJson(json.loads(written))
    plain = pa.schema([pa.field(f.name, f.type) for f in schema])
    return from_arrow_schema(plain, prefer_timestamp_ntz=True)


def constraint_rows(table: str, shape: StructType) -> list[tuple]:
    """Primary key, unique columns and foreign keys that a structure declares."""
    place, key, out = {f.name: n for n, f in enumerate(shape, 1)}, structure.keys(shape), []
    if key:
        out.append(("public", table, f"{table}_pkey", "p", [place[c] for c in key], key, None, None, None))
    for f in shape:
        if f.metadata.get("unique"):
            out.append(("public", table, f"{table}_{f.name}_key", "u", [place[f.name]], [f.name], None, None, None))
        if parent := f.metadata.get("references"):
            t, _, c = parent.rpartition(".")
            out.append(("public", table, f"{table}_{f.name}_fkey", "f", [place[f.name]], [f.name], t, [c], "CASCADE" if f.metadata.get("cascade") else None))
    return out


def _rows(kind: str, table: str, shape: StructType) -> list[tuple]:
    if kind == "columns":
        return [("public", table, name, n, data_type, not fixed, default, length) for name, n, data_type, fixed, default, length, _ in structure.describe(shape)]
    return constraint_rows(table, shape)


@dataclass
class _Table(InputPartition):
    name: str
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "tables")
        self.names = set(json.loads(options["tables"])) if "tables" in options else None

    def partitions(self) -> list[InputPartition]:
        fs, base = _open(self.path)
        return [_Table(n, p) for n, p in _tables(fs, base).items() if self.names is None or n in self.names] or [_Table("", "")]

    def read(self, partition: _Table) -> Iterator[tuple]:
        if partition.path:
            fs, _ = _open(self.path)
            yield from [("public", partition.name, "BASE TABLE")] if self.kind == "tables" else _rows(self.kind, partition.name, _shape(fs, partition.path))


class Catalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "tables")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, kind: str, *tables: str) -> DataFrame:
    """One of the catalog's tables for the tables below ``path``, all or those named."""
    spark.dataSource.register(Catalog)
    r = spark.read.format(FORMAT).option("kind", kind)
    return (r.option("tables", json.dumps(tables)) if tables else r).load(path)
