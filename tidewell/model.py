"""What describes a job: mappings, relationships, segments, intents, holds and results."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame

#: Columns that travel with change rows, and those that historized targets carry.
OPERATION, ORDERING, CHANGED_AT = "__operation", "__ordering", "__changed_at"
VERSION_KEY, VALID_FROM, VALID_TO, IS_CURRENT, SNAPSHOT_AT = (
    "version_key", "valid_from", "valid_to", "is_current", "snapshot_at",
)
INSERT, UPDATE, DELETE = "I", "U", "D"


@dataclass(frozen=True)
class Relationship:
    """A foreign table that columns may come from: keys are (base column, foreign column)."""

    name: str
    table: DataFrame
    keys: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class ColumnMapping:
    """transform: SQL with {{column}} for the source column, or with no token at all."""

    source: str
    target: str | None = None
    transform: str | None = None
    relationship: str | None = None

    @property
    def name(self) -> str:
        return self.target or self.source


@dataclass(frozen=True)
class Mapping:
    """How a source becomes a target. No columns: all, under their own names."""

    columns: tuple[ColumnMapping, ...] = ()
    keys: tuple[str, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    filter: str | None = None

    @property
    def targets(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def values(self) -> list[str]:
        return [c for c in self.targets if c not in self.keys]


@dataclass(frozen=True)
class Full:
    def describe(self) -> str:
        return "full"


@dataclass(frozen=True)
class ListOf:
    """Rows whose column is one of these values, which must not be none."""

    column: str
    values: tuple[Any, ...]

    def describe(self) -> str:
        return f"{self.column} in ({', '.join(map(str, self.values))})"


@dataclass(frozen=True)
class Range:
    """low <= column < high."""

    column: str
    low: Any
    high: Any
    label: str | None = None

    def describe(self) -> str:
        return self.label or f"{self.column} [{self.low}, {self.high})"


@dataclass(frozen=True)
class Auto:
    """So many ranges of about equal width; expanded before a read, never read itself."""

    column: str
    buckets: int

    def describe(self) -> str:
        return f"{self.column} auto({self.buckets})"


Segment = Full | ListOf | Range | Auto


class Intent(Enum):
    """What a pass is to do about rows from before it."""

    INITIAL_LOAD = "initial_load"
    CHANGES = "changes"
    FROM_EARLIEST = "changes_from_earliest"
    FROM_LATEST = "changes_from_latest"


class Hold(Enum):
    """Why a mapping isn't run."""

    NONE = "none"
    EXPIRED = "position_expired"
    PAUSED = "paused"
    LOADING = "loading"


@dataclass(frozen=True)
class Read:
    """What a reader gives: rows, the position after them, and what it noticed."""

    rows: DataFrame
    position: Any = None
    notes: dict[str, Any] = field(default_factory=dict)


class PositionExpired(RuntimeError):
    """The source no longer holds what came after the stored position."""


class GuardRefused(RuntimeError):
    """A reconciliation would delete more than its guard allows."""


class DuplicateKeys(ValueError):
    """Rows of one key where there may be one only."""
