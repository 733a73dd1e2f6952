"""Assay tables, run listings and discovery of inputs by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_assay(spark: SparkSession, path: str) -> DataFrame:
    """.csv, .txt or no extension: CSV with a header; .parquet or .pq: Parquet."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".csv", ".txt", ""):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if ext in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"{path}: neither CSV nor Parquet")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and stem of the files below a folder, listed by Spark, which may keep them in any store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("stem"))


def datasets(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> list[str]:
    return sorted(r.path for r in list_files(spark, path, "*.csv").where(~F.col("stem").isin(*excluded) if excluded else F.lit(True)).collect())


def source_kind(names: list[str]) -> str:
    """csv for features.csv (or one CSV file), json for JSON files, of the names that a folder (or its results) holds."""
    if any(n.endswith("features.csv") for n in names) or (len(names) == 1 and names[0].endswith(".csv")):
        return "csv"
    if any(n.endswith(".json") for n in names):
        return "json"
    raise ValueError("neither features.csv nor JSON results")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """dataset, structure, reason."""
    return spark.read.option("sep", "\t").option("header", True).schema("dataset string, structure string, reason string").csv(path)


def failures_by_dataset(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").agg(F.sort_array(F.collect_set("structure")).alias("structures"))


def last_session(log: DataFrame, order: str = "n", line: str = "line", mark: str = "START") -> DataFrame:
    """Log lines after the last one with the mark: one row's place, then a filter."""
    start = log.agg(F.max(F.when(F.col(line).contains(mark), F.col(order))).alias("_from"))
    return log.crossJoin(F.broadcast(start)).where(F.col(order) > F.coalesce("_from", F.lit(-1))).drop("_from")
