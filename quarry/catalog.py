"""Tables as immutable Parquet snapshots, named by small JSON files."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quarry.types import QuarryError, parse_type


@dataclass
class TableInfo:
    name: str
    columns: dict[str, str]  # logical types
    key: str
    index: str = "sequential"
    parts: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)

    def schema(self) -> StructType:
        return StructType([StructField(n, _parse_datatype_string(parse_type(t).spark)) for n, t in self.columns.items()])


class Catalog:
    """root: a folder on any file system that Spark reads.  A write makes new files, then replaces the table's JSON."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _meta(self, name: str) -> str:
        return f"{self.root}/_tables/{name.lower()}.json"

    def names(self) -> list[str]:
        folder = self._path(f"{self.root}/_tables")
        if not self._fs.exists(folder):
            return []
        return sorted(f.getPath().getName()[:-5] for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self._meta(name)))

    def info(self, name: str) -> TableInfo:
        if not self.exists(name):
            raise QuarryError(f"no such table: {name}")
        stream = self._fs.open(self._path(self._meta(name)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return TableInfo(**json.loads(text))

    def save(self, info: TableInfo) -> None:
        target = self._path(self._meta(info.name))
        temporary = self._path(f"{self._meta(info.name)}.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(asdict(info)).encode()))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(files.makeQualified(temporary), files.makeQualified(target), options)

    def read(self, info: TableInfo) -> DataFrame:
        if not info.parts:
            return self.spark.createDataFrame([], info.schema())
        return self.spark.read.schema(info.schema()).parquet(*info.parts)

    def write_part(self, info: TableInfo, rows: DataFrame) -> str:
        path = f"{self.root}/{info.name.lower()}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def append(self, info: TableInfo, rows: DataFrame) -> None:
        info.parts.append(self.write_part(info, rows))
        self.save(info)

    def width(self, info: TableInfo) -> dict[str, int | None]:
        """The bytes that a value of each column takes at most; None where there is no bound."""
        fixed = {"INT": 4, "FLOAT": 8, "BOOLEAN": 1, "DATE": 4}
        return {c: fixed.get(parse_type(t).name) or parse_type(t).limit for c, t in info.columns.items()}

    def replace(self, info: TableInfo, rows: DataFrame) -> None:
        """A new snapshot, sorted by key so that files and row groups can be skipped; the old files go after the switch."""
        old, info.parts = info.parts, [self.write_part(info, rows.repartitionByRange(info.key).sortWithinPartitions(info.key))]
        self.save(info)
        for path in old:
            self._fs.delete(self._path(path), True)

    def drop(self, name: str) -> None:
        info = self.info(name)
        self._fs.delete(self._path(self._meta(name)), False)
        self._fs.delete(self._path(f"{self.root}/{info.name.lower()}"), True)
