"""Standing searches: the engine's predicates over a growing folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema, where, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends to sink (Parquet) every new row of folder that where(df) keeps; one run over what is there."""
    stream: DataFrame = spark.readStream.schema(schema).parquet(folder)
    return where(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
