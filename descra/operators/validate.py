"""Checks of assay and descriptor tables.  A check returns its violations as rows (rule, key, detail); ``require`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTED = 5


class ValidationError(ValueError):
    pass


def require(violations: DataFrame, listed: int = 20) -> None:
    found = violations.orderBy("rule", "key").limit(listed + 1).collect()
    if found:
        lines = [f"{r.rule}: {r.key} {r.detail}".rstrip() for r in found[:listed]]
        raise ValidationError("\n".join(lines + ["..."] * (len(found) > listed)))


def _rows(df: DataFrame, rule: str, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def missing(c: str, kind: str):
    return F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull()


def null_counts(df: DataFrame, columns: list[str] | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """A violation for each column with nulls or NaN, from one pass."""
    kinds = dict(df.dtypes)
    names = [c for c in columns or df.columns if c not in allowed]
    row = df.agg(*[F.count_if(missing(c, kinds[c])).alias(f"n{i}") for i, c in enumerate(names)])
    each = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)])).alias("_")).select("_.*").where("n > 0")
    return _rows(each, "missing values", F.col("c"), F.col("n"))


def duplicates(df: DataFrame, column: str, rule: str = "duplicate name") -> DataFrame:
    groups = df.groupBy(F.trim(F.col(column).cast("string")).alias("k")).agg(F.count("*").alias("n")).where("n > 1 and k is not null")
    return _rows(groups, rule, F.col("k"), F.col("n"))


def duplicate_sequences(df: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """Pairs of sequences that stand under more than one name, with a few of the names."""
    groups = df.groupBy(F.concat(F.upper(F.trim(first)), F.upper(F.trim(second))).alias("k")).agg(F.countDistinct(name).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).where("n > 1 and k is not null")
    return _rows(groups, "duplicate sequences", F.sha2("k", 256).substr(1, 12), F.concat_ws(" ", F.col("n").cast("string"), F.lit("names from"), "lo", F.lit("to"), "hi"))


def assay(df: DataFrame, name: str = "name", sequences: tuple[str, str] = ("heavy", "light"), split: str | None = None) -> DataFrame:
    """All violations of an assay table: no rows, required columns, nulls, bars in names, empty and repeated names, repeated sequences."""
    spark = df.sparkSession
    lacking = [c for c in (name, *sequences) if c not in df.columns]
    if not any(c.startswith("target_") for c in df.columns):
        lacking.append("target_*")
    if lacking:
        return spark.createDataFrame([("missing column", c, "") for c in lacking], "rule string, key string, detail string")
    text = F.trim(F.col(name).cast("string"))
    allowed = tuple(c for c in df.columns if c.startswith(("target_", "feature_")))
    parts = [
        _rows(df.agg(F.count("*").alias("n")).where("n = 0"), "no rows", F.lit("table"), F.lit("")),
        null_counts(df, [name, *sequences, *([split] if split else [])], allowed),
        _rows(df.where(text.contains("|")), "bar in name", text, F.lit("")),
        _rows(df.where(text == ""), "empty name", text, F.lit("")),
        duplicates(df, name),
        duplicate_sequences(df, name, *sequences),
    ]
    return union(parts)


def absent(names: DataFrame, other: DataFrame, key: str, rule: str = "no descriptors") -> DataFrame:
    """Names that the other table lacks."""
    gone = names.select(F.trim(F.col(key).cast("string")).alias("k")).distinct().join(other.select(F.trim(F.col(key).cast("string")).alias("k")).distinct(), "k", "left_anti")
    return _rows(gone, rule, F.col("k"), F.lit(""))


def both_ways(names: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return absent(names, other, key, "no structure").unionByName(absent(other, names, key, "orphan structure"))


def complete_groups(expected: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """group, expected, found, complete: a group counts as whole only when nothing of it is missing."""
    here = found.select(group, key).distinct().withColumn("_here", F.lit(True))
    return expected.select(group, key).distinct().join(here, [group, key], "left").groupBy(group).agg(F.count("*").alias("expected"), F.count("_here").alias("found")).withColumn("complete", F.col("expected") == F.col("found"))


def drop_missing_targets(df: DataFrame, target: str, most: float = 0.5) -> DataFrame:
    """Rows with a target; raises when the share without one reaches ``most``."""
    gone = missing(target, dict(df.dtypes)[target])
    n, bad = df.agg(F.count("*"), F.count_if(gone)).first()
    if n and bad / n >= most:
        raise ValidationError(f"{target}: {bad} of {n} rows have no value")
    return df.where(~gone)


def unbalanced_folds(folds: DataFrame, keys: list[str], most: float = 2.0) -> DataFrame:
    sizes = folds.groupBy(*keys, "fold").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where(F.col("hi") > F.col("lo") * most)
    return _rows(sizes, "unbalanced folds", F.concat_ws("|", *keys), F.concat_ws("/", F.col("hi").cast("string"), F.col("lo").cast("string")))
