"""Tables of a database as a Spark data source, in a batch or as a stream whose offset is the cursor (S2, S4, S5, 2.11d).

The database is reached through any Python DB-API module on the executors, read-only. Rows are read in ranges of the cursor column, a task each; filters and
columns go to the database. A stream's offset is the newest cursor value that it has seen: a batch reads what lies between two of them, and each
restart goes on from the last one.

    spark.dataSource.register(TableSource)
    spark.read.format("dbapi").options(module="sqlite3", connect='["/shared/x.db"]', table="messages", cursor="loaded_at", ranges=8).schema(...).load()
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    """Rows with low < cursor <= high; None is no bound, and the range without bounds also holds rows without a cursor."""

    def __init__(self, low: object, high: object):
        self.low, self.high = low, high


COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def told(f: Filter) -> tuple[str, list] | None:
    """A filter on a column as SQL with its values, if the database takes it as Spark means it."""
    name = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
    if name is None:
        return None
    plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
    if type(f) in COMPARED and plain(f.value):
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and f.value and all(map(plain, f.value)):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    return None


class _Table:
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.fieldNames(), dict(options)
        self.where: list[tuple[str, list]] = []

    @property
    def cursor(self) -> str | None:
        return self.options.get("cursor")

    def rows(self, sql: str, values: list) -> Iterator[tuple]:
        """Streams rows, so that a range need not fit into memory. Only reading statements are made here."""
        module = importlib.import_module(self.options["module"])
        given = json.loads(self.options.get("connect", "[]"))
        connection = module.connect(**given) if isinstance(given, dict) else module.connect(*given)
        try:
            c = connection.cursor()
            # modules differ in how they write a value's place
            c.execute(sql if getattr(module, "paramstyle", "qmark") == "qmark" else sql.replace("?", "%s"), values)
            while some := c.fetchmany(int(self.options.get("fetch", 5_000))):
                yield from some
        finally:
            connection.close()

    def ends(self) -> tuple:
        name = quoted(self.cursor)
        return next(self.rows(f"SELECT min({name}), max({name}) FROM {quoted(self.options['table'])}", []))

    def selected(self, part: Range) -> Iterator[tuple]:
        parts = list(self.where)
        if part.low is not None:
            parts.append((f"{quoted(self.cursor)} > ?", [part.low]))
        if part.high is not None:
            parts.append((f"{quoted(self.cursor)} <= ?", [part.high]))
        where = " AND ".join(p for p, _ in parts)
        sql = f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.options['table'])}" + (f" WHERE {where}" if where else "")
        yield from self.rows(sql, [v for _, vs in parts for v in vs])


class TableReader(_Table, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            sql = told(f)
            if sql is None:
                yield f
            else:
                self.where.append(sql)

    def partitions(self) -> list[Range]:
        ranges = int(self.options.get("ranges", 1))
        if ranges <= 1 or not self.cursor:
            return [Range(None, None)]
        name, table = quoted(self.cursor), quoted(self.options["table"])
        # cuts by the number of rows, found in the database; equal cursors stay together, and rows without one go with the first range
        sql = f"SELECT DISTINCT max(c) FROM (SELECT {name} AS c, ntile({ranges}) OVER (ORDER BY {name}) AS n FROM {table} WHERE {name} IS NOT NULL) GROUP BY n ORDER BY 1"
        cuts = [r[0] for r in self.rows(sql, [])]
        if not cuts:
            return [Range(None, None)]
        bounds = [None, *cuts[:-1], None]
        return [*(Range(a, b) for a, b in zip(bounds, bounds[1:]) if a is not None or b is not None), NoCursor()] if len(cuts) > 1 else [Range(None, None)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if isinstance(partition, NoCursor):
            own = _Table.__new__(_Table)
            own.columns, own.options, own.where = self.columns, self.options, [*self.where, (f"{quoted(self.cursor)} IS NULL", [])]
            return own.selected(Range(None, None))
        return self.selected(partition)


class NoCursor(Range):
    """Rows without a cursor, which no bound holds."""

    def __init__(self):
        super().__init__(None, None)


class TableStream(_Table, DataSourceStreamReader):
    """Offsets are {"cursor": newest value seen}. Rows that come to the table later with an older cursor than that are not read; a source that loads late
    rows is read again by ``state.first_arrivals`` or ``since_cursors`` with an overlap."""

    def initialOffset(self) -> dict:
        return {"cursor": json.loads(self.options["from"]) if "from" in self.options else None}

    def latestOffset(self) -> dict:
        return {"cursor": self.ends()[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["cursor"] is None or start["cursor"] == end["cursor"]:
            return []
        return [Range(start["cursor"], end["cursor"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.selected(partition)

    def commit(self, end: dict) -> None:
        pass


class TableSource(DataSource):
    """Options: module and connect (a JSON list or object for its connect()), table, cursor, ranges, fetch, from (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(schema, self.options)

    def streamReader(self, schema: StructType) -> TableStream:
        return TableStream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)


def read_all(spark: SparkSession, sources: dict[str, Callable[[SparkSession], DataFrame]], take: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Read each source by itself and hand its rows to ``take``, which must carry them out; a source that fails leaves the others running. Gives the failed ones'
    messages, cut at 1000 characters."""
    failed = {}
    for name, read in sources.items():
        try:
            take(name, read(spark))
        except Exception as error:  # noqa: BLE001 - whatever a source does wrong is its own failure
            failed[name] = f"{type(error).__name__}: {error}"[:1000]
    return failed
