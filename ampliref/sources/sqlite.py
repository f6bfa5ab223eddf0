"""Import of SQLite files, once, into Parquet."""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path, self.table = [f.name for f in schema.fields], options["path"], options["table"]
        self.kinds = [f.dataType.typeName() for f in schema.fields]
        self.parts = int(options.get("partitions", "8"))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        cast = {"string": str, "long": int, "double": float}
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            columns = ", ".join(map(_quoted, self.names))
            for row in con.execute(f"select {columns} from {_quoted(self.table)} where rowid between ? and ?", partition.value):
                yield tuple(None if v is None else cast[k](v) for v, k in zip(row, self.kinds))


class SQLiteSource(DataSource):
    """format "sqlite" with options path, table and partitions: ranges of rowid are read in parallel."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        kinds = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            found = con.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError("Table not found: " + self.options["table"])
        return ", ".join(f"`{c[1]}` {kinds.get((c[2] or '').upper().split('(')[0], 'string')}" for c in found)

    def reader(self, schema):
        return _Reader(schema, self.options)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def import_sqlite(spark: SparkSession, path: str, out_dir: str) -> list[str]:
    """Writes each table of a SQLite file as <out_dir>/<table>.parquet; the file must be where the executors can read it."""
    if not Path(path).exists():
        raise FileNotFoundError("Database file does not exist: " + path)
    spark.dataSource.register(SQLiteSource)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        tables = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
    for t in tables:
        spark.read.format("sqlite").option("path", path).option("table", t).load().write.mode("overwrite").parquet(f"{out_dir}/{t}.parquet")
    return tables
