"""Models: entities, dimensions, measures, metrics, joins, row policies; read from YAML and checked on load."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

import yaml

from metricloom.errors import ValidationError, YamlError

_NAME = re.compile(r"[a-z_][a-z0-9_]*\Z")
_QUALIFIED = re.compile(r"\s*[A-Za-z_][A-Za-z0-9_]*\s*\.\s*[A-Za-z_][A-Za-z0-9_]*\s*\Z")


class DimensionType(Enum):
    STRING = "string"
    NUMBER = "number"
    BOOLEAN = "boolean"
    TIME = "time"


class Aggregation(Enum):
    SUM = "sum"
    COUNT = "count"
    AVERAGE = "average"
    MIN = "min"
    MAX = "max"
    COUNT_DISTINCT = "count_distinct"


class EntityType(Enum):
    FACT = "fact"
    DIMENSION = "dimension"


class JoinType(Enum):
    INNER = "inner"
    LEFT = "left"
    FULL = "full"


@dataclass(frozen=True)
class Dimension:
    name: str
    type: DimensionType
    sql: str
    description: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    agg: Aggregation
    sql: str
    description: str | None = None


@dataclass(frozen=True)
class RlsPolicy:
    claim_key: str
    dimension: str


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    primary_key: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]
    entity_type: EntityType = EntityType.FACT
    rls_policies: tuple[RlsPolicy, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    measure: str
    dimensions: tuple[str, ...]
    description: str | None = None


@dataclass(frozen=True)
class Join:
    left_entity: str
    left_column: str
    right_entity: str
    right_column: str
    join_type: JoinType = JoinType.LEFT


@dataclass(frozen=True)
class Model:
    name: str
    entities: tuple[Entity, ...]
    metrics: tuple[Metric, ...]
    joins: tuple[Join, ...] = field(default=())


class _Reader:
    """One mapping of the YAML. Unknown keys are ignored; shapes are errors of form, rules are errors of content."""

    def __init__(self, value: object, what: str):
        if not isinstance(value, dict):
            raise YamlError(f"{what}: expected a mapping")
        self.value, self.what = value, what

    def text(self, key: str, required: bool = True) -> str | None:
        value = self.value.get(key)
        if value is None and not required:
            return None
        if not isinstance(value, str):
            raise YamlError(f"{self.what}: '{key}' is missing" if value is None else f"{self.what}: '{key}' must be a string")
        return value

    def name(self, key: str) -> str:
        value = self.text(key)
        if not _NAME.match(value):
            raise ValidationError(f"{self.what}: '{key}' must match [a-z_][a-z0-9_]*, not '{value}'")
        return value

    def sql(self) -> str:
        value = self.text("sql")
        if _QUALIFIED.match(value):
            raise ValidationError(f"{self.what}: qualified_sql_forbidden: '{value}' names another table")
        return value

    def choice(self, key: str, kind: type[Enum], default: Enum | None = None) -> Enum:
        value = self.value.get(key)
        if value is None and default is not None:
            return default
        try:
            return kind(value)
        except ValueError:
            raise YamlError(f"{self.what}: '{key}' must be one of {', '.join(k.value for k in kind)}") from None

    def items(self, key: str, make: Callable, required: bool = True) -> tuple:
        value = self.value.get(key)
        if value is None and not required:
            return ()
        if not isinstance(value, list):
            raise YamlError(f"{self.what}: '{key}' must be a list")
        return tuple(make(x) for x in value)


def _dimension(value: object) -> Dimension:
    r = _Reader(value, "dimension")
    return Dimension(r.name("name"), r.choice("type", DimensionType), r.sql(), r.text("description", False))


def _measure(value: object) -> Measure:
    r = _Reader(value, "measure")
    return Measure(r.name("name"), r.choice("agg", Aggregation), r.sql(), r.text("description", False))


def _policy(value: object) -> RlsPolicy:
    r = _Reader(value, "row policy")
    return RlsPolicy(r.name("claim_key"), r.name("dimension"))


def _entity(value: object) -> Entity:
    r = _Reader(value, "entity")
    return Entity(
        r.name("name"), r.text("table"), r.name("primary_key"), r.items("dimensions", _dimension), r.items("measures", _measure),
        r.choice("entity_type", EntityType, EntityType.FACT), r.items("rls_policies", _policy, False), r.text("description", False),
    )


def _plain(value: object) -> str:
    if not isinstance(value, str):
        raise YamlError("metric: 'dimensions' must be strings")
    return value


def _metric(value: object) -> Metric:
    r = _Reader(value, "metric")
    return Metric(r.name("name"), r.text("measure"), r.items("dimensions", _plain), r.text("description", False))


def _join(value: object) -> Join:
    r = _Reader(value, "join")
    return Join(*(r.name(k) for k in ("left_entity", "left_column", "right_entity", "right_column")), r.choice("join_type", JoinType, JoinType.LEFT))


def parse_model(text: str) -> Model:
    """One model from YAML."""
    try:
        value = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise YamlError(str(e)) from e
    r = _Reader(value, "model")
    return Model(r.name("name"), r.items("entities", _entity), r.items("metrics", _metric), r.items("joins", _join, False))
