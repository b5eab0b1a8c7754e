"""Errors by class. ``status`` is what an HTTP surface answers: 400 for the caller's mistakes, 500 for the configuration's.
``sqlstate`` is what a SQL surface answers: 42000 for what can't be compiled, 22000 for bad JSON, XX000 for the rest."""

from __future__ import annotations


class MetricloomError(Exception):
    status = 500
    sqlstate = "42000"


class StateError(MetricloomError):
    """A model can't be loaded."""

    sqlstate = "XX000"


class YamlError(StateError):
    """Not YAML, or a required key is missing or has the wrong shape."""


class ValidationError(StateError):
    """A well-formed model breaks a rule."""


class IoError(StateError):
    """A model file can't be read."""


class CallerError(MetricloomError):
    status = 400


class RequestParseError(CallerError):
    pass


class EmptyMetricName(RequestParseError):
    def __init__(self):
        super().__init__("the metric name is blank")


class MetricNotFound(RequestParseError):
    def __init__(self, metric: str):
        super().__init__(f"no model has metric '{metric}'")


class DimensionNotFound(RequestParseError):
    def __init__(self, dimension: str):
        super().__init__(f"dimension '{dimension}' not found")


class RequestMappingError(CallerError):
    """A REST body that can't be made into a request."""


class BadRequestJson(CallerError):
    """A SEMANTIC text whose JSON can't be read."""

    sqlstate = "22000"


class MetricResolutionError(CallerError):
    pass


class MeasureNotFound(MetricResolutionError):
    def __init__(self, measure: str):
        super().__init__(f"measure '{measure}' not found")


class AmbiguousMeasure(MetricResolutionError):
    def __init__(self, measure: str, entities: list[str]):
        super().__init__(f"measure '{measure}' is in several entities: {', '.join(entities)}")


class AmbiguousDimension(MetricResolutionError):
    def __init__(self, dimension: str, entities: list[str]):
        super().__init__(f"dimension '{dimension}' is found more than once: {', '.join(entities)}")


class AmbiguousMetric(CallerError):
    def __init__(self, metric: str, models: list[str]):
        super().__init__(f"metric '{metric}' is in several models: {', '.join(models)}")


class UnsupportedRequestFeature(CallerError):
    pass


class JoinResolutionError(CallerError):
    pass


class TableNotFound(JoinResolutionError):
    def __init__(self, entity: str):
        super().__init__(f"entity '{entity}' is not in the join graph")


class UnreachablePath(JoinResolutionError):
    def __init__(self, start: str, goal: str):
        super().__init__(f"no join path from '{start}' to '{goal}'")


class BrokenPath(JoinResolutionError):
    """A join path names an entity that no model has any more."""

    status = 500

    def __init__(self, start: str, goal: str):
        super().__init__(f"the join path from '{start}' to '{goal}' is broken")


class MissingNode(MetricloomError):
    def __init__(self, entity: str):
        super().__init__(f"a join names entity '{entity}', which no model has")


class ChasmTrapError(MetricloomError):
    pass


class LinkDimensionNotFound(ChasmTrapError):
    def __init__(self):
        super().__init__("no dimension on the path joins the facts directly")


class UnsupportedCountDistinctReaggregation(ChasmTrapError):
    def __init__(self, measure: str):
        super().__init__(f"measure '{measure}' counts distinct values, which partial results can't be added up to")


class FinerThanConformedGrain(ChasmTrapError):
    def __init__(self, dimension: str, entity: str, grain: str):
        self.dimension, self.entity, self.grain = dimension, entity, grain
        super().__init__(f"dimension '{dimension}' of '{entity}' is finer than the grain '{grain}' that its facts are joined at")


class RlsError(MetricloomError):
    pass


class UnknownRlsDimension(RlsError):
    def __init__(self, entity: str, dimension: str):
        super().__init__(f"a row policy of '{entity}' names dimension '{dimension}', which it doesn't have")


class UnprotectedTable(RlsError):
    """Plain SQL under row policies names a table that they can't be applied to."""

    status = 400

    def __init__(self, table: str):
        super().__init__(f"with a user context SQL can read sources by their plain names only, not '{table}'")


class DialectError(MetricloomError):
    """What a dialect can't say, or a value that it can't take."""


class SourceError(MetricloomError):
    """A table has no source."""

    sqlstate = "XX000"


class ConnectorError(SourceError):
    """A warehouse can't be read. ``table`` is the source's name."""

    def __init__(self, table: str, reason: str):
        self.table = table
        super().__init__(f"table '{table}': {reason}")


class ConnectionFailed(ConnectorError):
    pass


class QueryFailed(ConnectorError):
    pass


class QueryTimedOut(ConnectorError):
    pass


class UnsupportedType(ConnectorError):
    pass
