"""Descriptor results as a stream: new JSON documents of a folder, flattened, appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from descra.sources.results import flatten, stem


def read(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """A wide row for each new document; at most ``files`` a batch."""
    own = T.StructType([f for f in schema.fields if f.name != "name"])
    rows = spark.readStream.schema(own).option("multiLine", True).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.json").json(path)
    return flatten(rows.withColumn("name", stem(F.col("_metadata.file_path"))))


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now and stops; a later call goes on where this one ended."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
