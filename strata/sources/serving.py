"""Serving tables in a database over JDBC: typed, replaced in one transaction, upserted in one statement.

Rows go to a staging table of their own, by all executors; one transaction then takes them over. Whether a table is there,
and with which columns, is asked of the database's catalogue: an error there is an error here, never "no such table".
Each of Spark's tasks writes its rows in one transaction, which a lost executor's task rolls back.

Where there is no database that all executors reach, `versions:<shared folder>` serves from versioned tables there: the same
replacing and upserting, each one new version, published whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.versions import Versions
from strata.sources.files import flatten
from strata.sources.incremental import jdbc

#: Column types by kind of database; what isn't listed is text.
TYPES = {
    "postgresql": {"boolean": "boolean", "byte": "smallint", "short": "smallint", "integer": "integer", "long": "bigint", "float": "double precision", "double": "double precision", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "date": "date", "binary": "bytea", "text": "text"},
    "derby": {"boolean": "boolean", "byte": "smallint", "short": "smallint", "integer": "integer", "long": "bigint", "float": "double", "double": "double", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date", "binary": "blob", "text": "clob"},
    "mysql": {"boolean": "boolean", "byte": "smallint", "short": "smallint", "integer": "integer", "long": "bigint", "float": "double", "double": "double", "timestamp": "timestamp(6)", "timestamp_ntz": "datetime(6)", "date": "date", "binary": "longblob", "text": "longtext"},
}
#: What a key has in the place of text, where text can't be compared or indexed.
KEY_TEXT = {"derby": "varchar(1024)", "mysql": "varchar(512)"}
#: Begins the url of a shared folder in the place of a database.
SHARED = "versions:"


def kind_of(url: str) -> str:
    return next((k for k in TYPES if url.startswith(f"jdbc:{k}")), "postgresql")


def column_type(data: T.DataType, url: str, key: bool = False) -> str:
    """The database's type of a Spark type."""
    kind = kind_of(url)
    if isinstance(data, T.DecimalType):
        return f"numeric({data.precision},{data.scale})"
    found = TYPES[kind].get(data.typeName(), TYPES[kind]["text"])
    return KEY_TEXT.get(kind, found) if key and found == TYPES[kind]["text"] else found


class Database:
    """A connection of the driver to the serving database."""

    def __init__(self, spark: SparkSession, url: str, driver: str | None = None):
        self.spark, self.url, self.driver, self.kind = spark, url, driver, kind_of(url)
        if driver:
            spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)

    def quoted(self, name: str) -> str:
        q = "`" if self.kind == "mysql" else '"'
        return q + name.replace(q, q + q) + q

    def _connect(self):
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url)

    def run(self, *statements: str) -> None:
        """All statements in one transaction."""
        con = self._connect()
        try:
            con.setAutoCommit(False)
            for one in statements:
                statement = con.createStatement()
                statement.executeUpdate(one)
                statement.close()
            con.commit()
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()

    def columns(self, table: str) -> list[str] | None:
        """A table's columns in order, from the catalogue; None if it isn't there."""
        con = self._connect()
        try:
            about = con.getMetaData()
            fold = str.upper if about.storesUpperCaseIdentifiers() else str.lower if about.storesLowerCaseIdentifiers() else str
            schema, _, name = fold(table).rpartition(".")
            found = about.getColumns(con.getCatalog(), schema or con.getSchema(), name, None)
            out = []
            while found.next():
                out.append((found.getInt("ORDINAL_POSITION"), found.getString("COLUMN_NAME")))
            return [c for _, c in sorted(out)] or None
        finally:
            con.close()

    def stage(self, df: DataFrame, table: str, keys: list[str]) -> str:
        """The rows in a new table beside `table`, unique by the keys, and its name."""
        name, flat = f"{table}_{uuid.uuid4().hex[:8]}", flatten(df)
        own = {k.lower() for k in keys}
        columns = ", ".join(f"{self.quoted(f.name)} {column_type(f.dataType, self.url, f.name.lower() in own)}" for f in flat.schema)
        self.run(f"CREATE TABLE {name} ({columns})")
        try:
            if keys:
                self.run(self.index(name, keys))
            writer = flat.write.format("jdbc").option("url", self.url).option("dbtable", name).mode("append")
            (writer.option("driver", self.driver) if self.driver else writer).save()
        except Exception:
            self.run(f"DROP TABLE {name}")
            raise
        return name

    def index(self, table: str, keys: list[str]) -> str:
        return f"CREATE UNIQUE INDEX {table.rpartition('.')[2]}_key ON {table} ({', '.join(map(self.quoted, keys))})"

    def rename(self, old: str, new: str) -> str:
        return f"RENAME TABLE {old} TO {new}" if self.kind in ("derby", "mysql") else f"ALTER TABLE {old} RENAME TO {new.rpartition('.')[2]}"

    def merge(self, table: str, staged: str, columns: list[str], keys: list[str]) -> str:
        """One statement that updates the rows of the staged keys and inserts the others. Null keys are always inserted."""
        names, rest = list(map(self.quoted, columns)), [self.quoted(c) for c in columns if c not in keys]
        into = f"INSERT INTO {table} ({', '.join(names)}) SELECT {', '.join(names)} FROM {staged}"
        if self.kind == "postgresql":
            sets = ", ".join(f"{c} = excluded.{c}" for c in rest)
            return f"{into} ON CONFLICT ({', '.join(map(self.quoted, keys))}) DO {'UPDATE SET ' + sets if sets else 'NOTHING'}"
        if self.kind == "mysql":
            return f"{into} ON DUPLICATE KEY UPDATE {', '.join(f'{c} = VALUES({c})' for c in rest or names[:1])}"
        same = " AND ".join(f"t.{k} = s.{k}" for k in map(self.quoted, keys))
        sets = ", ".join(f"{c} = s.{c}" for c in rest)
        update = f"WHEN MATCHED THEN UPDATE SET {sets} " if sets else ""
        return f"MERGE INTO {table} t USING {staged} s ON {same} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(names)}) VALUES ({', '.join('s.' + c for c in names)})"


def replace(df: DataFrame, url: str, table: str, driver: str | None = None, keys: list[str] | None = None) -> None:
    """Replaces (or makes) a serving table in one transaction. Nested columns go as JSON text. keys: unique, for later upserts."""
    db = Database(df.sparkSession, url, driver)
    name = db.stage(df, table, keys or [])
    held = db.columns(table) is not None
    db.run(*([f"DROP TABLE {table}"] if held else []), db.rename(name, table))


def upsert(df: DataFrame, url: str, table: str, keys: list[str], driver: str | None = None) -> None:
    """Upserts into a serving table with the same columns; keys must be unique in df. No such table, or other columns: an error."""
    db = Database(df.sparkSession, url, driver)
    held = db.columns(table)
    if held is None:
        raise LookupError(f"no serving table {table}")
    if sorted(held) != sorted(df.columns):
        raise ValueError(f"serving table {table} has columns {held}, the rows {df.columns}")
    name = db.stage(df, table, keys)
    try:
        db.run(db.merge(table, name, df.columns, keys))
    finally:
        db.run(f"DROP TABLE {name}")


def serve(full: DataFrame, changed: DataFrame | None, url: str, table: str, keys: list[str], driver: str | None = None) -> str:
    """Upserts the changed rows if the table has the model's columns, else replaces it by the whole model; which of both.

    changed: None for a model that was built anew.
    """
    if url.startswith(SHARED):
        return _serve_shared(full, changed, Versions(full.sparkSession, f"{url[len(SHARED) :]}/{table}"), keys)
    held = Database(full.sparkSession, url, driver).columns(table)
    if changed is not None and held == full.columns:
        upsert(changed.select(full.columns), url, table, keys, driver)
        return "upsert"
    replace(full, url, table, driver, keys)
    return "replace"


def _serve_shared(full: DataFrame, changed: DataFrame | None, held: Versions, keys: list[str]) -> str:
    upserts = changed is not None and held.latest() is not None and held.read().columns == full.columns
    rows = flatten(changed.select(full.columns) if upserts else full)
    if keys and not rows.na.drop(subset=keys).groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"duplicate key among {keys}")
    held.upsert(rows, keys) if upserts else held.write(rows, keys=keys)
    return "upsert" if upserts else "replace"


def served(spark: SparkSession, url: str, table: str, driver: str | None = None) -> DataFrame:
    """A serving table's rows."""
    return Versions(spark, f"{url[len(SHARED) :]}/{table}").read() if url.startswith(SHARED) else jdbc(spark, url, table, driver=driver)
