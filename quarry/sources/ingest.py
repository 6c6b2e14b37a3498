"""Loading CSV and JSON files with inferred types, and exporting results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.types import SPATIAL, LogicalType, UnsupportedFormat

_INT = r"^\s*[-+]?\d+\s*$"
_SHAPES = {"POINT": "POINT", "POLYGON": "POLYGON", "LINESTRING": "LINESTRING"}


def strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    if kind == "json":
        return _json(spark, path)
    raise UnsupportedFormat(f"unsupported file format: {path}")


def _json(spark: SparkSession, path: str) -> DataFrame:
    """Records one a line, or files that are one array (or one record over several lines), told apart by how lines begin."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    records = F.trim("value").startswith("{") & F.trim("value").endswith("}")
    whole = lines.filter(~records).limit(1).count() > 0
    read = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST")
    return read.option("multiLine", whole).json(path)


def _value_kind(c: Column) -> Column:
    """INT, FLOAT, BOOLEAN, a geometry's kind or VARCHAR, for one value."""
    text = F.upper(F.ltrim(c))
    out = F.when(c.rlike(_INT), "INT").when(c.try_cast("double").isNotNull(), "FLOAT").when(F.lower(c).isin("true", "false"), "BOOLEAN")
    for name in _SHAPES:
        out = out.when(text.startswith(name), name)
    return out.otherwise("VARCHAR")


def infer(raw: DataFrame) -> dict[str, LogicalType]:
    """A type for each column from all rows: any geometry, then text, then FLOAT, INT, BOOLEAN; empty cells are text."""
    aggs = []
    for i, c in enumerate(raw.columns):
        col = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        aggs += [F.collect_set(_value_kind(col)).alias(f"k{i}"), F.max(F.octet_length(col)).alias(f"n{i}")]
    row = raw.agg(*aggs).first()
    out = {}
    for i, c in enumerate(raw.columns):
        kinds = set(row[f"k{i}"])
        name = next((k for k in (*SPATIAL, "VARCHAR", "FLOAT", "INT", "BOOLEAN") if k in kinds), "VARCHAR")
        out[c] = LogicalType(name, max(30, (row[f"n{i}"] or 0) + 10)) if name == "VARCHAR" else LogicalType(name)
    return out


def typed(raw: DataFrame, types: dict[str, LogicalType]) -> DataFrame:
    """The rows as the types, with _reason: null, or why the row can't be one of the table."""
    faults = [F.when(F.col(f"`{c}`").isNotNull() & (t.convert(F.col(f"`{c}`")).isNull() | ~t.fits(F.col(f"`{c}`"))), F.lit(f"{c} is not a {t}")) for c, t in types.items()]
    return raw.select(*[t.convert(F.col(f"`{c}`")).alias(c) for c, t in types.items()], F.coalesce(*faults).alias("_reason"))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, LogicalType]]:
    """Rows of a CSV or JSON file with _reason (see typed()), and the types that all of them gave."""
    raw = strings(spark, path)
    types = infer(raw)
    return typed(raw, types), types


def rejects(rows: DataFrame, key: str) -> DataFrame:
    """_reason and how many rows it keeps out: a value's type, a null key, a key that comes again."""
    reason = F.coalesce("_reason", F.when(F.col(key).isNull(), F.lit("the key is null")))
    bad = rows.select(reason.alias("_reason")).filter("_reason IS NOT NULL").groupBy("_reason").agg(F.count(F.lit(1)).alias("rows"))
    again = rows.filter(F.col("_reason").isNull() & F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.lit("the key comes again").alias("_reason"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return bad.unionByName(again.filter("rows > 0"))


def export(df: DataFrame, path: str) -> None:
    """Write a result as CSV with a header, or as JSON lines, by the path's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema])
        flat.write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise UnsupportedFormat(f"unsupported file format: {path}")
