"""Selection, projection, top-n, counts and snapshot mutations over one table."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.types import QuarryError

_OPS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise QuarryError(f"no such column: {name}")
    return df[name]


_WHOLE = {"smallint": 15, "int": 31, "bigint": 63}


def literal(df: DataFrame, name: str, value) -> Column:
    """value for comparing with the column, in a wider type if the column's can't hold it; an error if it isn't of its kind."""
    kind = df.schema[name].dataType.simpleString()
    if value is None:
        return F.lit(None).cast(kind)
    wrong = QuarryError(f"{value!r} is not a {kind} for {name}")
    if isinstance(value, str) and kind in (*_WHOLE, "double", "float", "boolean"):
        try:
            value = {"true": True, "false": False}[value.lower()] if kind == "boolean" else float(value) if kind in ("double", "float") or not re.fullmatch(r"[-+]?\d+", value) else int(value)
        except (ValueError, KeyError):
            raise wrong from None
    if kind in _WHOLE and isinstance(value, int) and not isinstance(value, bool):
        if -(2 ** _WHOLE[kind]) <= value < 2 ** _WHOLE[kind]:
            return F.lit(value).cast(kind)
        return F.lit(str(value)).cast("decimal(38,0)") if abs(value) < 10**38 else F.lit(float(value))
    if kind in _WHOLE and isinstance(value, float):
        return F.lit(value)  # 2.5 compares as a number, not as 2
    if kind in ("date", "timestamp"):
        try:
            datetime.fromisoformat(str(value).strip())
        except ValueError:
            raise wrong from None
    return F.lit(value).try_cast(kind)


def compare(df: DataFrame, name: str, op: str, value) -> Column:
    """Three-valued: null matches nothing."""
    return _OPS[op](column(df, name), literal(df, name, value))


def is_in(df: DataFrame, name: str, values: list) -> Column:
    return column(df, name).isin(*[literal(df, name, v) for v in values])


def like(df: DataFrame, name: str, pattern: str) -> Column:
    """% stands for any characters, _ for one."""
    return column(df, name).cast("string").like(pattern)


def ordered(df: DataFrame, keys: list[tuple[str, bool]], key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """By keys (name, descending), ties by the table's key; nulls first when ascending and last when descending."""
    by = [column(df, n).desc() if down else column(df, n).asc() for n, down in keys]
    out = df.orderBy(*by, *([df[key]] if key in df.columns else []))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, key: str, number: int, size: int = 5) -> DataFrame:
    """Page number (from 1) of the rows by key."""
    return ordered(df, [(key, False)], key, size, (number - 1) * size)


def between(df: DataFrame, name: str, low, high) -> Column:
    return column(df, name).between(literal(df, name, low), literal(df, name, high))


def project(df: DataFrame, names: list[str] | None) -> DataFrame:
    return df if names is None else df.select(*[column(df, n) for n in names])


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least key."""
    return df.orderBy(column(df, key)).limit(n)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def insert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df and rows; an error if a key is null, repeats, or is in df."""
    key_col = column(df, key)
    given = rows.select(*[F.col(f.name).cast(f.dataType) for f in df.schema])
    bad = given.groupBy(key).count().filter(F.col("count") > 1).select(key)
    clash = df.join(given.select(key), key, "left_semi").select(key_col)
    first = bad.unionByName(clash).unionByName(given.filter(F.col(key).isNull()).select(key)).limit(1).collect()
    if first:
        raise QuarryError(f"key is null or exists: {first[0][0]}")
    return df.unionByName(given)


def delete(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(~column(df, key).eqNullSafe(literal(df, key, value)))


def update(df: DataFrame, key: str, value, changes: dict) -> DataFrame:
    """Delete and insert of one row in one step."""
    hit = column(df, key) == literal(df, key, value)
    return df.select(*[F.when(hit, literal(df, n, changes[n])).otherwise(df[n]).alias(n) if n in changes else df[n] for n in df.columns])


def describe(df: DataFrame) -> DataFrame:
    """column, type, rows, nulls, least and greatest value (as text) of every column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        plain = f.dataType.typeName() not in ("array", "map", "struct", "binary")
        aggs += [F.count(c).alias(f"n{i}"), (F.min(c) if plain else F.lit(None)).cast("string").alias(f"lo{i}"), (F.max(c) if plain else F.lit(None)).cast("string").alias(f"hi{i}")]
    each = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                 F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("greatest"))
        for i, f in enumerate(df.schema)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*each)))
