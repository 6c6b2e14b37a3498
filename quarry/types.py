"""Logical column types, their Spark types, and the checks that they imply."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPATIAL = ("POINT", "POLYGON", "LINESTRING", "GEOMETRY")
MEDIA = ("IMAGE", "AUDIO")
_SPARK = {"INT": "int", "FLOAT": "double", "BOOLEAN": "boolean", "DATE": "date"} | dict.fromkeys((*SPATIAL, *MEDIA), "string")

# The names by which each index kind may be called.
_ALIASES = {
    "sequential": ("sequential", "seq", "sequential_index", "sequential_indexed", "sequential_indexed_table", "seq_index", "seq_idx"),
    "bplus_tree": ("bplus_tree", "btree", "b_tree", "b_tree_index", "bplus_tree_index", "bplus", "b_plus"),
    "extendible_hash": ("extendible_hash", "ext_hash", "hash", "hash_index", "hash_table"),
    "isam_sparse": ("isam_sparse", "isam", "isam_index", "isam_sparse_index", "isam_table"),
    "rtree": ("rtree", "rtree_index", "rtree_table", "rtree_spatial", "rtree_spatial_index", "spatial"),
    "rtree_sparse": ("rtree_sparse",),
    "multimedia": ("multimedia", "multi", "mm", "multimedia_index"),
}
INDEX_KINDS = {alias: kind for kind, names in _ALIASES.items() for alias in names}


class QuarryError(Exception):
    """A statement that can't be parsed, resolved or run."""


class UnsupportedFormat(QuarryError):
    """A file kind that no reader handles."""


@dataclass(frozen=True)
class LogicalType:
    name: str
    length: int | None = None

    @property
    def spark(self) -> str:
        return "string" if self.name == "VARCHAR" else _SPARK[self.name]

    def __str__(self) -> str:
        return f"{self.name}({self.length})" if self.length else self.name

    def convert(self, column: Column) -> Column:
        """column as this type; null where it can't be one."""
        if self.name == "DATE":  # ISO text, or a number of days since 1970
            days = F.date_add(F.lit("1970-01-01").cast("date"), column.cast("string").try_cast("int"))
            return F.coalesce(column.cast("string").try_cast("date"), days)
        return column.try_cast(self.spark)

    def fits(self, column: Column) -> Column:
        """Whether a value is within the declared length, which counts UTF-8 bytes."""
        return F.coalesce(F.octet_length(column.cast("string")) <= self.limit, F.lit(True)) if self.limit else F.lit(True)

    @property
    def limit(self) -> int | None:
        """The most bytes of a text, a geometry or a path; None for other types."""
        return self.length or (500 if self.name in SPATIAL else 255 if self.name in MEDIA else None)


def parse_type(text: str) -> LogicalType:
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:\(\s*(\d+)\s*\))?\s*", text)
    name = m[1].upper() if m else ""
    if name == "VARCHAR":
        if not m[2]:
            raise QuarryError("VARCHAR needs a length")
        return LogicalType(name, int(m[2]))
    if name not in _SPARK or m[2]:
        raise QuarryError(f"unsupported data type: {text.strip()}")
    return LogicalType(name)


def index_kind(name: str) -> str:
    kind = INDEX_KINDS.get(name.lower())
    if not kind:
        raise QuarryError(f"unknown index kind: {name}")
    return kind
