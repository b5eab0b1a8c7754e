"""Tables by the names that models give them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metricloom.errors import SourceError

from .warehouses import BigQuery, Postgres, Snowflake, connected


class SourceRegistry:
    """Readers by table name. ``schema.table`` falls back to ``table``, then to the session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._readers: dict[str, Callable[[], DataFrame]] = {}
        self._new_views: set[str] = set()

    def register(self, table: str, reader: DataFrame | Callable[[], DataFrame]) -> SourceRegistry:
        self._readers[table] = (lambda: reader) if isinstance(reader, DataFrame) else reader
        self._new_views.add(table)
        return self

    def parquet(self, table: str, path: str) -> SourceRegistry:
        return self.register(table, lambda: self.spark.read.parquet(path))

    def parquet_dir(self, root: str, *tables: str) -> SourceRegistry:
        """``root/<table>.parquet`` for each table."""
        for t in tables:
            self.parquet(t, f"{root}/{t}.parquet")
        return self

    def jdbc(self, table: str, url: str, dbtable: str | None = None, **options: str) -> SourceRegistry:
        """A table of a database that has a JDBC driver on the class path; filters and columns are pushed down by Spark."""
        return self.connector(table, "jdbc", url=url, dbtable=dbtable or table, **options)

    def postgres(self, table: str, server: Postgres, dbtable: str | None = None) -> SourceRegistry:
        return self.connector(table, server.kind, **server.options(dbtable or table))

    def snowflake(self, table: str, account: Snowflake, dbtable: str | None = None) -> SourceRegistry:
        return self.connector(table, account.kind, **account.options(dbtable or table))

    def bigquery(self, table: str, project: BigQuery, dbtable: str | None = None) -> SourceRegistry:
        return self.connector(table, project.kind, **project.options(dbtable or table))

    def connector(self, table: str, kind: str, /, **options: str) -> SourceRegistry:
        """A table behind any data source that the session has; what fails there is a ConnectorError."""
        return self.register(table, lambda: connected(table, lambda: self.spark.read.format(kind).options(**options).load()))

    def names(self) -> list[str]:
        return list(self._readers)

    def table(self, name: str) -> DataFrame:
        for known in (name, name.rpartition(".")[2]):
            if known in self._readers:
                return self._readers[known]()
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise SourceError(f"no source for table '{name}'")

    def create_views(self) -> None:
        """A temporary view for each table whose name can be one, once for each registration."""
        for name in sorted(self._new_views):
            if "." not in name:
                self.table(name).createOrReplaceTempView(name)
            self._new_views.discard(name)
