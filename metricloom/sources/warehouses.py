"""Settings of the warehouses that tables can be in, and their failures as errors of our own.

Spark's connectors do the reading: they push filters and columns down and read in parallel. Their packages come with the
cluster; without one its tables raise ConnectionFailed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

from metricloom.errors import ConnectionFailed, ConnectorError, QueryFailed, QueryTimedOut, UnsupportedType


@dataclass(frozen=True)
class Postgres:
    """``partition``: column, lower and upper bound and number of parallel reads; without it one task reads a table."""

    kind: ClassVar[str] = "jdbc"
    host: str
    database: str
    user: str
    password: str = field(repr=False)
    port: int = 5432
    timeout_s: int = 30
    fetch_rows: int = 10_000
    partition: tuple[str, int, int, int] | None = None

    def options(self, table: str) -> dict[str, str]:
        out = {
            "url": f"jdbc:postgresql://{self.host}:{self.port}/{self.database}", "dbtable": table, "user": self.user, "password": self.password, "driver": "org.postgresql.Driver",
            "connectTimeout": str(self.timeout_s), "queryTimeout": str(self.timeout_s), "fetchsize": str(self.fetch_rows),
        }
        if self.partition:
            out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, self.partition)))
        return out


@dataclass(frozen=True)
class Snowflake:
    kind: ClassVar[str] = "net.snowflake.spark.snowflake"
    account: str
    user: str
    database: str
    warehouse: str
    schema: str = "PUBLIC"
    password: str | None = field(default=None, repr=False)
    private_key: str | None = field(default=None, repr=False)
    role: str | None = None
    timeout_s: int = 60

    def options(self, table: str) -> dict[str, str]:
        out = {
            "sfURL": f"{self.account}.snowflakecomputing.com", "sfUser": self.user, "sfPassword": self.password, "pem_private_key": self.private_key, "sfRole": self.role,
            "sfDatabase": self.database, "sfSchema": self.schema, "sfWarehouse": self.warehouse, "dbtable": table, "statement_timeout_in_seconds": str(self.timeout_s),
        }
        return {k: v for k, v in out.items() if v is not None}


@dataclass(frozen=True)
class BigQuery:
    kind: ClassVar[str] = "bigquery"
    project: str
    dataset: str
    credentials_file: str | None = None
    timeout_s: int = 30

    def options(self, table: str) -> dict[str, str]:
        out = {"parentProject": self.project, "table": table if "." in table else f"{self.project}.{self.dataset}.{table}", "credentialsFile": self.credentials_file}
        out["httpConnectTimeout"] = out["httpReadTimeout"] = str(1000 * self.timeout_s)
        return {k: v for k, v in out.items() if v is not None}


def connected(table: str, read: Callable[[], DataFrame]) -> DataFrame:
    """A table that answers for its schema, or a ConnectorError. Rows are read later, by Spark's tasks."""
    try:
        return read()
    except Exception as e:
        raise failure(table, e) from e


#: Words in a failure's text, in the order of trial, and what they stand for.
_TOLD = (
    (("UNRECOGNIZED_SQL_TYPE", "UNSUPPORTED_DATATYPE", "unsupported type"), UnsupportedType),
    (("SQLTimeoutException", "timed out", "timeout"), QueryTimedOut),
    (("FAILED_JDBC", "connection", "No suitable driver", "ClassNotFoundException", "DATA_SOURCE_NOT_FOUND", "Failed to find", "UnknownHost", "refused", "not found.*database"), ConnectionFailed),
)


def failure(table: str, error: Exception) -> ConnectorError:
    """A failure of Spark's or a driver's by its kind; the driver's text is kept as the cause, not in the message, as it may hold credentials."""
    text = f"{type(error).__name__} {error}".lower()
    condition = (error.getCondition() if isinstance(error, PySparkException) else None) or type(error).__name__
    for words, kind in _TOLD:
        if any(w.lower() in text for w in words):
            return kind(table, condition)
    return (QueryFailed if isinstance(error, AnalysisException) or "SQL" in str(error) else ConnectionFailed)(table, condition)
