"""Tables of a SQLite file as a Spark source: ``spark.read.format("thermolith_sqlite")``.

Options: ``path``, ``table``, ``partitions`` (ranges of row ids read side by side). The file
must lie where executors can open it. Older result stores are read this way.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"INTEGER": T.LongType(), "REAL": T.DoubleType()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class Reader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.n, self.schema = options["path"], options["table"], int(options.get("partitions", "4")), schema

    def partitions(self) -> list[Range]:
        with _open(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        columns = ", ".join(_quoted(f.name) for f in self.schema)
        with _open(self.path) as c:
            for row in c.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (part.first, part.end)):
                yield tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for f, v in zip(self.schema, row))


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "thermolith_sqlite"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as c:
            found = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(name, KINDS.get(kind.upper(), T.StringType())) for _, name, kind, *_ in found])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SQLiteSource)
