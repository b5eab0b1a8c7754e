"""Requests: one metric with dimensions, filters, grain and limit; also from JSON and from the REST body."""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import Enum

from metricloom.errors import BadRequestJson, RequestMappingError

MAX_LIMIT = 10_000


class FilterOperator(Enum):
    EQ = "eq"
    NOT_EQ = "not_eq"
    GT = "gt"
    LT = "lt"
    GTE = "gte"
    LTE = "lte"
    IN = "in"


@dataclass(frozen=True)
class Filter:
    dimension: str
    operator: FilterOperator
    value: str

    @classmethod
    def of(cls, value: object) -> Filter:
        if isinstance(value, Filter):
            return value
        try:
            if not isinstance(value["value"], str) or not isinstance(value["dimension"], str):
                raise BadRequestJson("a filter's dimension and value are strings")
            return cls(value["dimension"], FilterOperator(value["operator"]), value["value"])
        except (KeyError, TypeError, ValueError) as e:
            raise BadRequestJson(f"not a filter: {value!r}") from e


@dataclass(frozen=True)
class Request:
    metric_name: str
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    time_granularity: str | None = None
    limit: int | None = None

    @classmethod
    def of(cls, value: Request | dict) -> Request:
        """From a mapping with the fields' names; unknown keys are ignored."""
        if isinstance(value, Request):
            return value
        if not isinstance(value, dict) or not isinstance(value.get("metric_name"), str):
            raise BadRequestJson("metric_name is missing")
        dimensions, filters, grain, limit = value.get("dimensions", ()), value.get("filters", ()), value.get("time_granularity"), value.get("limit")
        if not isinstance(dimensions, list | tuple) or not all(isinstance(d, str) for d in dimensions) or not isinstance(filters, list | tuple):
            raise BadRequestJson("dimensions and filters are lists")
        if grain is not None and not isinstance(grain, str):
            raise BadRequestJson("time_granularity is a string")
        if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or not 0 <= limit < 1 << 32):
            raise BadRequestJson("limit is a whole number from 0 on")
        return cls(value["metric_name"], tuple(dimensions), tuple(map(Filter.of, filters)), grain, limit)

    @classmethod
    def from_json(cls, text: str) -> Request:
        try:
            return cls.of(json.loads(text))
        except json.JSONDecodeError as e:
            raise BadRequestJson(f"not JSON: {e}") from e

    @classmethod
    def from_rest(cls, body: dict) -> Request:
        """From the REST body: ``metrics`` (exactly one), ``dimensions``, ``filters``, ``time_range``, ``limit``; nothing else."""
        if not isinstance(body, dict) or not isinstance(body.get("metrics"), list):
            raise RequestMappingError("metrics must be a list")
        time_range = body.get("time_range") or {}
        for given, known in ((body, {"metrics", "dimensions", "filters", "time_range", "limit"}), (time_range, {"granularity", "start", "end"})):
            if not isinstance(given, dict) or set(given) - known:
                raise RequestMappingError(f"unknown field in {given!r}")
        metrics, limit = body["metrics"], body.get("limit")
        if len(metrics) != 1:
            raise RequestMappingError(f"exactly one metric is needed, not {len(metrics)}")
        if not isinstance(metrics[0], str) or not metrics[0].strip():
            raise RequestMappingError("the metric name is blank")
        if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT):
            raise RequestMappingError(f"limit must be from 1 to {MAX_LIMIT}")
        if time_range.get("start") is not None or time_range.get("end") is not None:
            raise RequestMappingError("time_range.start and time_range.end are not supported, only granularity")
        return cls.of({"metric_name": metrics[0], "dimensions": body.get("dimensions", []), "filters": body.get("filters", []), "time_granularity": time_range.get("granularity"), "limit": limit})
