"""Relational tables behind a Python DB-API driver as a Spark data source."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import TABLES

FETCH_ROWS = 10_000
OPERATORS = ("=", "<", "<=", ">", ">=")
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _name(identifier: str) -> str:
    """A column or table name; it becomes part of a statement, so nothing but a plain name passes."""
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", identifier):
        raise ValueError(f"not a plain name: {identifier!r}")
    return identifier


def _moment(value) -> datetime:
    """A point in time from a driver's value; without a zone it is UTC, as everywhere in the package."""
    value = datetime.fromisoformat(value) if isinstance(value, str) else value
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value


def _converter(kind: T.DataType):
    """From the driver's value to the column's type; SQLite, for one, keeps times as texts and booleans as numbers."""
    if isinstance(kind, T.TimestampType):
        return _moment
    if isinstance(kind, T.DateType):
        return lambda v: date.fromisoformat(v[:10]) if isinstance(v, str) else v.date() if isinstance(v, datetime) else v
    if isinstance(kind, T.DecimalType):
        return lambda v: v if isinstance(v, Decimal) else Decimal(str(v))
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float
    if isinstance(kind, _NUMBERS):
        return int
    return str if isinstance(kind, T.StringType) else lambda v: v


@dataclass
class KeyRange(InputPartition):
    """Keys from ``low`` (inclusive) to ``high`` (exclusive); rows without a key are in the range without ``low``."""

    low: object
    high: object


class TableReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.module, self.connect = options["module"], json.loads(options["connect"])
        self.table, self.key = _name(options["dbtable"]), options.get("partitionColumn")
        self.parts, self.schema = int(options.get("numPartitions", "8")), schema
        self.where = [(f"{_name(c)} {op} ?", [value]) for c, op, value in json.loads(options.get("conditions", "[]"))]

    def _open(self):
        driver = importlib.import_module(self.module)
        mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}.get(driver.paramstyle)
        if mark is None:
            raise ValueError(f"parameter style {driver.paramstyle!r} of {self.module} is not known")
        return driver.connect(**self.connect), mark

    @staticmethod
    def _rows(db, mark: str, columns: list[str], table: str, where: list[tuple[str, list]], tail: str = "") -> Iterator[tuple]:
        text = f"SELECT {', '.join(columns)} FROM {table}" + (" WHERE " + " AND ".join(f"({c})" for c, _ in where) if where else "") + tail
        with closing(db.cursor()) as cursor:
            cursor.execute(text.replace("?", mark), [v for _, values in where for v in values])
            while block := cursor.fetchmany(FETCH_ROWS):
                yield from block

    def partitions(self) -> list[KeyRange]:
        """Ranges of about equally many rows: the boundaries are read off the key's index, one step after the other."""
        if not self.key or self.parts < 2:
            return [KeyRange(None, None)]
        key, bounds = _name(self.key), []
        db, mark = self._open()
        with closing(db):
            total = next(self._rows(db, mark, [f"count({key})"], self.table, self.where))[0]
            step, after = -(-total // self.parts), (f"{key} IS NOT NULL", [])
            while step and len(bounds) < self.parts - 1:
                found = next(self._rows(db, mark, [key], self.table, [*self.where, after], f" ORDER BY {key} LIMIT 1 OFFSET {step}"), None)
                if found and bounds and found[0] == bounds[-1]:  # one key fills a range: go on behind it
                    found = next(self._rows(db, mark, [key], self.table, [*self.where, (f"{key} > ?", [bounds[-1]])], f" ORDER BY {key} LIMIT 1"), None)
                if not found:
                    break
                bounds.append(found[0])
                after = (f"{key} >= ?", [found[0]])
        return [KeyRange(low, high) for low, high in zip([None, *bounds], [*bounds, None])]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        where = list(self.where)
        if partition.low is not None:
            where.append((f"{self.key} >= ?", [partition.low]))
        if partition.high is not None:
            where.append((f"{self.key} < ?" + (f" OR {self.key} IS NULL" if partition.low is None else ""), [partition.high]))
        convert = [_converter(f.dataType) for f in self.schema]
        db, mark = self._open()
        with closing(db):
            for row in self._rows(db, mark, [_name(f.name) for f in self.schema] or ["1"], self.table, where):
                yield tuple(None if v is None else c(v) for v, c in zip(row, convert))


class RelationalSource(DataSource):
    """``spark.read.format("dbapi")`` with the options ``module``, ``connect`` (JSON arguments), ``dbtable``, ``partitionColumn``, ``numPartitions``, ``conditions`` (JSON).

    Conditions are given with the read and not pushed down from later filters: Spark 4.1 keeps the reader of a
    DataFrame with the filters of its first use, so a second use without them would miss rows. Only the columns of the schema are selected: without one those of the known table, with
    ``.schema(...)`` any of them. Each range is read over a connection of its own, so the table must
    not change meanwhile, as with JDBC.
    """

    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def schema(self) -> str:
        return TABLES[self.options["dbtable"]]

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(self.options, schema)


def read_dbapi(
    spark: SparkSession, table: str, module: str, connect: dict, key: str | None = "id", partitions: int = 8, columns: list[str] | None = None,
    conditions: list[tuple] = (),
) -> DataFrame:
    """One of the known relational tables over a DB-API driver that the executors have, in ``partitions`` ranges of ``key``.

    ``conditions`` are triples of column, operator (``=``, ``<``, ``<=``, ``>``, ``>=``) and value, all of which must hold. The database
    applies those whose answer cannot depend on its collation or way of keeping times: on numbers
    and booleans, and equality of texts, which it may take more widely. Spark applies all of them again.
    """
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; known: {sorted(TABLES)}")
    full = T.StructType.fromDDL(TABLES[table])
    wanted = columns or full.fieldNames()
    for c, op, _ in conditions:
        if op not in OPERATORS or c not in full.fieldNames():
            raise ValueError(f"not a condition on {table}: {c!r} {op!r}")
    native = lambda c, op: isinstance(full[c].dataType, (*_NUMBERS, T.BooleanType)) or op == "=" and isinstance(full[c].dataType, T.StringType)
    options = {"module": module, "connect": json.dumps(connect), "dbtable": table, "numPartitions": str(partitions),
               "conditions": json.dumps([(c, op, v) for c, op, v in conditions if native(c, op)])} | ({"partitionColumn": key} if key else {})
    schema = T.StructType([full[c] for c in dict.fromkeys([*wanted, *[c for c, _, _ in conditions]])])
    spark.dataSource.register(RelationalSource)
    df = spark.read.format("dbapi").schema(schema).options(**options).load()
    test = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    for c, op, value in conditions:
        df = df.filter(getattr(F.col(c), test[op])(F.lit(value)))
    return df.select(*wanted)
