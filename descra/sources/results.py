"""Descriptor results: JSON documents and features.csv, each as one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descra.operators.columns import quoted

#: Old spellings on the left.
LEGACY = ("nonpolar_", "hyd_")


def flatten(df: DataFrame) -> DataFrame:
    """Structs become columns parent_child at any depth; lists inside them are dropped."""
    out = []

    def walk(column, name: str, kind: T.DataType, depth: int) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                child = f.name.replace(LEGACY[0], LEGACY[1], 1) if f.name.startswith(LEGACY[0]) else f.name
                walk(column.getField(f.name), f"{name}_{child}" if name else child, f.dataType, depth + 1)
        elif not isinstance(kind, (T.ArrayType, T.MapType)) or depth == 0:
            out.append(column.alias(name))

    for f in df.schema.fields:
        walk(F.col(quoted(f.name)), f.name, f.dataType, 0)
    return df.select(*out)


def stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A wide row for each JSON object below path, named by its file; broken files and other values are left out.

    With a schema the files are read once; else Spark infers one in a pass of its own.
    """
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("allowNonNumericNumbers", True).option("pathGlobFilter", "*.json")
    rows = (reader.schema(schema) if schema else reader).json(path)
    named = rows.drop("name").withColumn("name", stem(F.col("_metadata.file_path"))) if "name" in rows.columns else rows.withColumn("name", stem(F.col("_metadata.file_path")))
    return flatten(named)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """features.csv: the key is the base of pdb_file up to its first dot, else name."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if "pdb_file" in rows.columns:
        rows = rows.withColumn("name", F.split(F.element_at(F.split("pdb_file", "/"), -1), r"\.")[0])
    elif "name" not in rows.columns:
        raise ValueError("features need a pdb_file or name column")
    return rows.drop("pdb_file", "error")
