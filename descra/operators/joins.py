"""Joins of assay, descriptor and per-residue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descra.operators import validate


def trimmed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.trim(F.col(key).cast("string")))


def merge_descriptors(assay: DataFrame, descriptors: DataFrame, key: str = "name", check: bool = True) -> DataFrame:
    """Assay rows with their descriptors, keys compared as trimmed text; names without descriptors are an error."""
    if check:
        validate.require(validate.absent(assay, descriptors, key))
    return trimmed(assay, key).join(trimmed(descriptors, key), key)


def merge_sources(sources: list[tuple[str, DataFrame]], key: str = "name") -> DataFrame:
    """Inner join of descriptor tables; columns gain _source, and a source that comes again _2, _3."""
    out, seen = None, {}
    for name, df in sources:
        seen[name] = seen.get(name, 0) + 1
        suffix = f"_{name}" + (f"_{seen[name]}" if seen[name] > 1 else "")
        df = trimmed(df, key)
        df = df.toDF(*[c if c == key else c + suffix for c in df.columns])
        out = df if out is None else out.join(df, key)
    return out


def in_order_of(order: DataFrame, results: DataFrame, key: str = "name") -> DataFrame:
    """Every row of the order table, with its result if there is one; one result a key."""
    return trimmed(order, key).join(trimmed(results, key).dropDuplicates([key]), key, "left")


def repaired(left: DataFrame, right: DataFrame, exact: list[str], code: str, value: str) -> DataFrame:
    """left with ``value`` of right by the exact keys and code; else, where left has no code, by the keys alone:
    the only match, or of several the one without a code.  Codes are '' for none, never null."""
    exact_hit = right.groupBy(*exact, code).agg(F.first(value).alias("_exact"))
    loose = right.groupBy(*exact).agg(F.countDistinct(code).alias("_n"), F.max(F.when(F.col(code) == "", F.col(value))).alias("_plain"), F.max(value).alias("_only"))
    out = left.join(exact_hit, [*exact, code], "left").join(loose, exact, "left")
    fallback = F.when(F.col(code) == "", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_plain")))
    return out.withColumn(value, F.coalesce("_exact", fallback)).drop("_exact", "_n", "_plain", "_only")


def or_without_code(left: DataFrame, right: DataFrame, keys: list[str], code: str) -> DataFrame:
    """left with the columns of right's row of equal keys, one a key; where there is none, of the row whose code is ''.

    Keys that compare equal include the code, which is '' for none and never null.
    """
    values = [c for c in right.columns if c not in keys]
    found = F.struct(*[F.col(c) for c in values])
    exact = right.select(*keys, found.alias("_exact"))
    plain = right.where(F.col(code) == "").select(*[k for k in keys if k != code], found.alias("_plain"))
    out = left.join(exact, keys, "left").join(plain, [k for k in keys if k != code], "left").withColumn("_hit", F.coalesce("_exact", "_plain"))
    return out.select(*left.columns, *[F.col("_hit")[c].alias(c) for c in values])


def translated(values: DataFrame, mapping: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Values under the keys that the mapping leads to (key columns old_* to the plain ones), the first in order for each."""
    moved = values.join(mapping, [values[k] == mapping[f"old_{k}"] for k in keys], "left")
    cols = [F.coalesce(mapping[f"new_{k}"], values[k]).alias(k) for k in keys]
    rest = [c for c in values.columns if c not in keys]
    out = moved.select(*cols, *[values[c] for c in rest])
    return first_by(out, keys, [order])


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in this order."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_")).select(*keys, "_.*").select(*df.columns)


def by_offset(rows: DataFrame, group: list[str], seq: str, pairs: str) -> DataFrame:
    """Exploded (offset, energy) pairs joined to the row that stands at seq + offset: partner columns get to_."""
    far = rows.select(*group, *[F.col(c).alias(f"to_{c}") for c in rows.columns if c not in (*group, pairs)])
    each = rows.withColumn("_p", F.explode(pairs)).select(*[c for c in rows.columns if c != pairs], F.col("_p.offset").alias("offset"), F.col("_p.energy").alias("energy"))
    return each.withColumn(f"to_{seq}", F.col(seq) + F.col("offset")).join(far, [*group, f"to_{seq}"])


def previous(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """value of the row before in a chain; chains are short."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def tasks(techniques: DataFrame, folds: DataFrame, targets: DataFrame) -> DataFrame:
    """Every technique on every fold and target: three tables of a few rows."""
    return techniques.crossJoin(folds).crossJoin(targets).withColumn("task_id", F.concat_ws("|", *techniques.columns, *folds.columns, *targets.columns))


def pending(all_tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a result yet: what a resumed run has to do."""
    return all_tasks.join(done.select("task_id"), "task_id", "left_anti")


def longest_prefix(names: DataFrame, stems: DataFrame, name: str = "name", stem: str = "stem") -> DataFrame:
    """Each name with the longest stem that it equals or continues with an underscore.

    Equality joins on the name's own prefixes, not a comparison of all with all.
    """
    parts = F.split(name, "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    hits = names.select(name, F.explode(prefixes).alias(stem)).join(stems.select(stem).distinct(), stem)
    return hits.groupBy(name).agg(F.max_by(stem, F.length(stem)).alias(stem))
