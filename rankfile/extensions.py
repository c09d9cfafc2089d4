"""What users may add by name: exporters, engines of recognition, steps of a migration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession


class Named:
    """Factories by name; each is called once, when it is first asked for."""

    def __init__(self, kind: str):
        self.kind = kind
        self._factories: dict[str, Callable] = {}
        self._made: dict[str, object] = {}

    def register(self, name: str, factory: Callable, replace: bool = False) -> None:
        if name in self._factories and not replace:
            raise ValueError(f"{self.kind} {name!r} is registered")
        self._factories[name] = factory
        self._made.pop(name, None)

    def get(self, name: str):
        if name not in self._factories:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.names()) or 'none'}")
        if name not in self._made:
            self._made[name] = self._factories[name]()
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._factories)


class Exporter:
    """A sink and its scan. Rows are (doc_id, ordinal, node_id, tag, text); `keeps` names the columns that come back."""

    keeps: tuple[str, ...] = ()

    def write(self, rows: DataFrame, path: str) -> None:
        raise TypeError(f"{type(self).__name__} can't write")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        raise TypeError(f"{type(self).__name__} can't read")


@dataclass(frozen=True)
class Migration:
    """One step of a payload's schema: from a version to the next, as a change of columns."""

    source: int
    apply: Callable[[DataFrame], DataFrame]
    note: str = ""


@dataclass
class Migrations:
    """Steps that follow each other; `current` is the version the last one gives."""

    steps: dict[int, Migration] = field(default_factory=dict)

    def add(self, step: Migration) -> None:
        if step.source in self.steps:
            raise ValueError(f"version {step.source} has a step")
        self.steps[step.source] = step

    @property
    def current(self) -> int:
        return max(self.steps, default=0) + 1

    def plan(self, version: int) -> list[int]:
        """The versions that are left one after another; an error where the chain breaks or the version is newer."""
        if version > self.current:
            raise ValueError(f"version {version} is newer than {self.current}")
        missing = [v for v in range(version, self.current) if v not in self.steps]
        if missing:
            raise ValueError(f"no step from version {missing[0]}")
        return list(range(version, self.current))

    def migrate(self, rows: DataFrame, version: str) -> DataFrame:
        """Rows of any versions at the current one: each step is applied to the rows that have reached it."""
        for v in sorted(self.steps):
            moved = self.steps[v].apply(rows.where(rows[version] == v))
            rows = rows.where(rows[version] != v).unionByName(moved, allowMissingColumns=True)
        return rows


ENGINES = Named("engine")
EXPORTERS = Named("exporter")
Scorer = Callable[[Column, Column], Column]
