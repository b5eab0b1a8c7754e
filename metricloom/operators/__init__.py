"""Single operators for plans written by hand."""

from .query import Query, count_star, raw, time_spine

__all__ = ["Query", "count_star", "raw", "time_spine"]
