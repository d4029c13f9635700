"""SQL databases as sources and sinks: states in a table, content of a table, contents into a table.

Databases are named by an address or given as a connection. jdbc: addresses go through the JVM's drivers, sqlite: addresses and files through Python,
others need SQLAlchemy. What is small goes through one connection in one transaction; bulk content goes through Spark's own JDBC source and sink.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.tree import Branch
from .states import content_from, pack_state, unpack_state

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def quoted(name: str) -> str:
    """A table's or column's name, which must be a plain one; it isn't quoted, so that its case follows the database."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


class Database:
    """Statements over one connection; a `with` block is one transaction."""

    def __init__(self, connect: Callable[[], Any], mark: str = "?", types: tuple[str, str] = ("varchar(255)", "text")):
        self.connect, self.mark, (self.short, self.long) = connect, mark, types

    @contextmanager
    def transaction(self) -> Iterator[Callable[..., list[tuple]]]:
        db = self.connect()
        try:
            def run(sql: str, *rows: tuple) -> list[tuple]:
                cur = db.cursor()
                sql = sql.replace("?", self.mark)
                if len(rows) > 1:
                    cur.executemany(sql, list(rows))
                else:
                    cur.execute(sql, *rows)
                return cur.fetchall() if cur.description else []

            yield run
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            db.close()


class JdbcDatabase(Database):
    """The same over a JDBC driver of Spark's JVM, called from the driver."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None):
        self.spark, self.url, self.properties = spark, url, dict(properties or {})
        self.mark, self.short, self.long = "?", "varchar(255)", "clob" if url.startswith("jdbc:derby") else "text"

    @contextmanager
    def transaction(self) -> Iterator[Callable[..., list[tuple]]]:
        jvm = self.spark._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            if k == "driver":
                jvm.org.apache.spark.util.Utils.classForName(v, True, True)
            else:
                given.setProperty(k, v)
        db = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            db.setAutoCommit(False)

            def run(sql: str, *rows: tuple) -> list[tuple]:
                statement = db.prepareStatement(sql)
                for row in rows:
                    for i, v in enumerate(row, 1):
                        statement.setString(i, v)
                    if len(rows) > 1:
                        statement.addBatch()
                if len(rows) > 1:
                    statement.executeBatch()
                    return []
                if not statement.execute():
                    return []
                got, out = statement.getResultSet(), []
                n = got.getMetaData().getColumnCount()
                while got.next():
                    out.append(tuple(got.getString(i) for i in range(1, n + 1)))
                return out

            yield run
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            db.close()


def database(spark: SparkSession, address: Any, properties: dict[str, str] | None = None) -> Database:
    """A Database as it is; a jdbc: or sqlite: address; another address or an engine by way of SQLAlchemy, which is named where it is missing."""
    if isinstance(address, Database):
        return address
    if isinstance(address, str) and address.startswith("jdbc:"):
        return JdbcDatabase(spark, address, properties)
    if isinstance(address, str) and address.startswith("sqlite:///"):
        import sqlite3

        path = address.removeprefix("sqlite:///")
        return Database(lambda: sqlite3.connect(path))
    if hasattr(address, "raw_connection"):
        return Database(address.raw_connection, {"qmark": "?", "format": "%s", "pyformat": "%s"}.get(address.dialect.paramstyle, "?"))
    try:
        import sqlalchemy
    except ImportError as e:
        raise ImportError(f"{address!r} needs the package sqlalchemy; jdbc: and sqlite: addresses don't") from e
    return database(spark, sqlalchemy.create_engine(address))


def _exists(run: Callable, table: str) -> bool:
    try:
        run(f"select 1 from {table} where 1 = 0")
        return True
    except Exception:
        return False


class SQLState:
    """One row of a table (cache_key, kind, payload), replaced in one transaction. load() makes no table; save() does where there is none."""

    def __init__(self, spark: SparkSession, address: Any, *, table: str = "tree_state", cache_key: str = "default", properties: dict[str, str] | None = None):
        self.spark, self.db, self.table, self.key = spark, database(spark, address, properties), quoted(table), cache_key

    def load(self) -> Any:
        with self.db.transaction() as run:
            if not _exists(run, self.table):
                return None
            rows = run(f"select payload from {self.table} where cache_key = ?", (self.key,))
        return unpack_state(self.spark, json.loads(rows[0][0])) if rows else None

    def save(self, state: Any) -> None:
        d = pack_state(state)
        make_table(self.db, self.table, {"cache_key": self.db.short, "kind": self.db.short, "payload": self.db.long})
        with self.db.transaction() as run:
            run(f"delete from {self.table} where cache_key = ?", (self.key,))
            run(f"insert into {self.table} (cache_key, kind, payload) values (?, ?, ?)", (self.key, d["kind"], json.dumps(d, ensure_ascii=False)))


def make_table(db: Database, table: str, columns: dict[str, str]) -> None:
    with db.transaction() as run:
        there = _exists(run, table)
    if not there:
        first, *_ = columns
        with db.transaction() as run:
            run(f"create table {table} (" + ", ".join(f"{quoted(c)} {t}" + " not null primary key" * (c == first) for c, t in columns.items()) + ")")


class SQLContents:
    """K5: the contents of a nested tree, in pre-order, as the rows (id, text, metadata) of a table, which is made where there is none and emptied first."""

    def __init__(self, spark: SparkSession, address: Any, table: str, *, id_column: str = "id", text_column: str = "text", metadata_column: str = "metadata", properties: dict[str, str] | None = None):
        self.db, self.table, self.columns = database(spark, address, properties), quoted(table), [quoted(c) for c in (id_column, text_column, metadata_column)]

    def save(self, tree: Branch) -> None:
        if not isinstance(tree, Branch):
            raise TypeError(f"a nested tree is wanted, not {type(tree).__name__}")
        make_table(self.db, self.table, dict(zip(self.columns, (self.db.short, self.db.long, self.db.long), strict=True)))
        rows = [(str(c.id), c.text or "", json.dumps(c.metadata, ensure_ascii=False, default=str)) for c in tree.contents()]
        with self.db.transaction() as run:
            run(f"delete from {self.table}")
            if rows:
                run(f"insert into {self.table} ({', '.join(self.columns)}) values (?, ?, ?)", *rows)


def contents_to_jdbc(content: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """K5 in bulk: content(content_id, text, metadata) into a table, which keeps its definition if it is there."""
    content.select(F.col("content_id").alias("id"), "text", "metadata").write.mode("overwrite").option("truncate", "true").option("createTableColumnTypes", "id VARCHAR(255)").jdbc(url, quoted(table), properties=properties or {})


def read_content(spark: SparkSession, address: str, table: str, *, id_column: str = "id", text_column: str = "text", metadata_columns: list[str] | None = None, where: str | None = None, properties: dict[str, str] | None = None, parts: int = 8) -> DataFrame:
    """A table's rows as content(content_id, text, metadata). Columns and, over JDBC, the predicate go down to the database."""
    if address.startswith("jdbc:"):
        rows = spark.read.jdbc(address, quoted(table), properties=properties or {})
        return content_from(rows, id_column, text_column, metadata_columns or [], where)
    wanted = [id_column, text_column, *(metadata_columns or [])]
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format("branchlight_sqlite").schema(", ".join(f"{quoted(c)} string" for c in dict.fromkeys(wanted)))
    rows = reader.option("path", address.removeprefix("sqlite:///")).option("table", quoted(table)).option("where", where or "").option("parts", str(parts)).load()
    return content_from(rows, id_column, text_column, metadata_columns or [])


class SQLiteSource(DataSource):
    """A table of an SQLite file that all executors see, in ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "branchlight_sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _SQLiteReader(schema.fieldNames(), dict(self.options))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _SQLiteReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict):
        self.columns, self.options = columns, options

    def _db(self):
        import sqlite3

        path = self.options["path"]
        if not Path(path).exists():
            raise FileNotFoundError(path)
        return sqlite3.connect(path)

    def partitions(self) -> list[InputPartition]:
        with self._db() as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {self.options['table']}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // int(self.options["parts"])))
        return [_Range(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last = partition.value
        where = f" and ({self.options['where']})" if self.options.get("where") else ""
        with self._db() as db:
            for row in db.execute(f"select {', '.join(self.columns)} from {self.options['table']} where rowid between ? and ?{where} order by rowid", (first, last)):
                yield tuple(None if v is None else str(v) for v in row)
