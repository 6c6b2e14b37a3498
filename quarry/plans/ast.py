"""Statements and predicates as the parser returns them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quarry.types import LogicalType


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: LogicalType
    key: bool = False
    index: str | None = None
    spatial_index: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    key: str
    index: str


@dataclass(frozen=True)
class LoadTable:
    table: str
    path: str
    index: str
    key: str


@dataclass(frozen=True)
class CreateIndex:
    kind: str  # inverted, spatial or multimedia
    name: str
    table: str
    column: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Any, ...], ...]

    @property
    def values(self) -> tuple[Any, ...]:
        """The first row."""
        return self.rows[0]


@dataclass(frozen=True)
class Delete:
    table: str
    column: str
    value: Any


@dataclass(frozen=True)
class Count:
    table: str


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Between:
    column: str
    low: Any
    high: Any


@dataclass(frozen=True)
class Contains:
    column: str
    query: str
    limit: int | None = None


@dataclass(frozen=True)
class Phrase:
    column: str
    query: str


@dataclass(frozen=True)
class IsIn:
    column: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Like:
    column: str
    pattern: str


@dataclass(frozen=True)
class IsNull:
    column: str


@dataclass(frozen=True)
class RankedBy:
    column: str
    query: str
    limit: int = 5


@dataclass(frozen=True)
class SimilarTo:
    column: str
    path: str
    limit: int = 5


@dataclass(frozen=True)
class Within:
    column: str
    point: tuple[float, float]
    radius: float


@dataclass(frozen=True)
class Intersects:
    column: str
    box: tuple[float, float, float, float]


@dataclass(frozen=True)
class Nearest:
    column: str
    point: tuple[float, float]
    limit: int = 1


@dataclass(frozen=True)
class InRange(Intersects):
    """Everything whose bounding box meets the box between two corners."""


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None = None  # None: all
    top: int | None = None
    where: Any = None
    limit: int | None = None
    count: bool = False
    order: tuple[tuple[str, bool], ...] = ()  # columns, and whether they descend
    offset: int = 0
