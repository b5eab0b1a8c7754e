"""Loaded models: immutable snapshots, swapped on every load."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from metricloom.errors import IoError

from .graph import JoinGraph
from .model import Entity, Model, parse_model


@dataclass(frozen=True)
class Stats:
    models: int
    entities: int
    metrics: int


@dataclass(frozen=True)
class Snapshot:
    models: dict[str, Model] = field(default_factory=dict)

    @cached_property
    def graph(self) -> JoinGraph:
        """Built at the first query of this snapshot."""
        return JoinGraph(self.models.values())

    def entity(self, name: str, first: Model | None = None) -> Entity | None:
        """The entity of that name in ``first``, else in load order."""
        for model in (*([first] if first else ()), *self.models.values()):
            for e in model.entities:
                if e.name == name:
                    return e
        return None

    @property
    def stats(self) -> Stats:
        every = self.models.values()
        return Stats(len(self.models), sum(len(m.entities) for m in every), sum(len(m.metrics) for m in every))


class StateManager:
    def __init__(self):
        self._lock, self._now = threading.Lock(), Snapshot()

    def snapshot(self) -> Snapshot:
        return self._now

    def _put(self, models: list[Model]) -> None:
        with self._lock:
            self._now = Snapshot(self._now.models | {m.name: m for m in models})

    def load_yaml(self, text: str) -> Model:
        """Adds a model, or replaces the one of its name."""
        model = parse_model(text)
        self._put([model])
        return model

    def load_dir(self, path: str | Path) -> list[Model]:
        """All .yml and .yaml files of a folder (not of its subfolders), or one file: all of them or none."""
        models = [parse_model(text) for _, text in read_models(path)]
        self._put(models)
        return models

    def get_model(self, name: str) -> Model | None:
        return self._now.models.get(name)

    def all_models(self) -> list[Model]:
        return list(self._now.models.values())

    def default_model(self) -> Model | None:
        """The first loaded."""
        return next(iter(self._now.models.values()), None)

    def stats(self) -> Stats:
        return self._now.stats


def read_models(path: str | Path) -> list[tuple[str, str]]:
    path = Path(path)
    try:
        files = [path] if path.is_file() else sorted(p for p in path.iterdir() if p.is_file() and p.suffix in (".yml", ".yaml"))
        return [(p.name, p.read_text(encoding="utf-8")) for p in files]
    except OSError as e:
        raise IoError(str(e)) from e
