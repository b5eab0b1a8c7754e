"""Where tables come from, and row sinks."""

from .registry import SourceRegistry
from .sinks import envelope, to_text_rows
from .warehouses import BigQuery, Postgres, Snowflake

__all__ = ["BigQuery", "Postgres", "Snowflake", "SourceRegistry", "envelope", "to_text_rows"]
