"""Cross-validation folds as one table, train and test as predicates over it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descra.operators.selection import label_order

#: Random folds are drawn once for each of these; the first stands for folds that are not random.
RANDOM_SEEDS = (42, 43, 44)


def shuffled(n: int, k: int, seed: int) -> list[tuple[int, int, int]]:
    """(row, fold, place): a seeded permutation of n rows cut into k segments, the first n % k one longer."""
    if not 2 <= k <= n:
        raise ValueError(f"cannot cut {n} rows into {k} folds")
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return [(int(r), f, place) for f, part in enumerate(np.array_split(order, k)) for place, r in enumerate(part)]


def shuffled_folds(spark: SparkSession, names: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """name, fold, row_ord (place in the permutation) of an assay table, which is small."""
    cut = shuffled(len(names), k, seed)
    return spark.createDataFrame([(names[r], f, i) for i, (r, f, _) in enumerate(cut)], "name string, fold int, row_ord int")


def column_folds(df: DataFrame, split: str) -> DataFrame:
    """df with a fold for each label, in numeric order where labels are numbers; at least two labels, none missing."""
    labels = df.select(F.col(split)).distinct()
    n, missing = labels.agg(F.count(split), F.count_if(F.col(split).isNull())).first()
    if missing or n < 2:
        raise ValueError(f"{split} needs two labels or more and no missing ones")
    numbered = labels.withColumn("fold", F.row_number().over(Window.orderBy(*label_order(F.col(split)))) - 1)  # a row a label
    return df.join(F.broadcast(numbered), split)


def outer(fold: int | Column, test: bool) -> Column:
    return F.col("fold") == fold if test else F.col("fold") != fold


def inner(outer_fold: int | Column, inner_fold: int | Column, test: bool) -> Column:
    """Rows of inner_fold, or of all folds but both: a name of the outer test never takes part."""
    return F.col("fold") == inner_fold if test else (F.col("fold") != outer_fold) & (F.col("fold") != inner_fold)


def nested(folds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outer, inner, n_train, n_test of every nested split with two rows or more on each side."""
    sizes = folds.groupBy(*keys, "fold").agg(F.count("*").alias("n"))
    total = sizes.groupBy(*keys).agg(F.sum("n").alias("all"))
    a = sizes.select(*keys, F.col("fold").alias("outer"), F.col("n").alias("n_outer"))
    b = sizes.select(*keys, F.col("fold").alias("inner"), F.col("n").alias("n_test"))
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).where("outer <> inner")  # folds with folds: a handful
    pairs = pairs.join(total, keys) if keys else pairs.crossJoin(total)
    return pairs.withColumn("n_train", F.col("all") - F.col("n_outer") - F.col("n_test")).where("n_train >= 2 and n_test >= 2").select(*keys, "outer", "inner", "n_train", "n_test")


def one_hot(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns replaced by a 0/1 column for each level the train rows have, and one for missing values; a level that is
    new in the test rows is 0 everywhere.  Levels are collected: a column of categories has few."""
    for c in columns:
        levels = sorted(r[0] for r in df.where(train & F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().collect())
        made = [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)).alias(f"{c}__{v}") for v in levels] + [F.col(c).isNull().cast("double").alias(f"{c}__NaN")]
        df = df.select(*df.columns, *made).drop(c)
    return df


def rebuild(folds: DataFrame, key: str = "name", order: str = "row_ord") -> DataFrame:
    """The whole table from overlapping fold tables: the first row of each name."""
    names = [c for c in folds.columns if c != key]
    return folds.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("_")).select(key, "_.*").select(*folds.columns)


def merge_clusters(sizes: dict[str, int], k: int) -> dict[str, int] | None:
    """Clusters merged, the two smallest again and again, until k are left: cluster to fold; None with fewer than k."""
    groups = [[n, [c]] for c, n in sorted(sizes.items())]
    if len(groups) < k:
        return None
    while len(groups) > k:
        groups.sort(key=lambda g: (g[0], g[1]))
        (a, x), (b, y) = groups[:2]
        groups = [[a + b, sorted(x + y)], *groups[2:]]
    groups.sort(key=lambda g: (-g[0], g[1]))
    return {c: i for i, (_, some) in enumerate(groups) for c in some}


def identity(a: str, b: str) -> float:
    """Share of equal places in the best global alignment of two sequences."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    x, y = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (a, b))
    row = np.zeros(m + 1, np.int64)
    for i in range(n):
        diagonal = row[:-1] + (y == x[i])
        row = np.maximum(np.concatenate([[0], np.maximum.accumulate(np.maximum(diagonal, row[1:]))]), 0)
    return float(row[-1]) / max(n, m)


def identity_clusters(sequences: dict[str, str], least: float) -> dict[str, str]:
    """Greedy clustering, longest first: a sequence joins the first representative that is at least this identical."""
    reps: list[str] = []
    out = {}
    for name in sorted(sequences, key=lambda k: (-len(sequences[k]), k)):
        out[name] = next((r for r in reps if identity(sequences[r], sequences[name]) >= least), name)
        if out[name] == name:
            reps.append(name)
    return out


def sequence_folds(sequences: dict[str, str], identities=(0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8), folds=(5, 4), most: float = 2.0, least_rows: int = 8) -> tuple[dict[str, int], float, int] | None:
    """Folds of whole clusters, balanced within ``most``; None (then folds are random) where no setting gives any."""
    if len(sequences) < least_rows:
        return None
    for k in folds:
        for least in identities:
            cluster = identity_clusters(sequences, least)
            sizes: dict[str, int] = {}
            for c in cluster.values():
                sizes[c] = sizes.get(c, 0) + 1
            merged = merge_clusters(sizes, k)
            if merged is None:
                continue
            n = [sum(sizes[c] for c, f in merged.items() if f == i) for i in range(k)]
            if max(n) / min(n) <= most:
                return {name: merged[c] for name, c in cluster.items()}, least, k
    return None


def resolve_split(random: bool, columns: list[str], automl: bool = True) -> tuple[str, tuple[int, ...]]:
    """How folds come about, and the seeds: random, from the fold column, by sequence, or none without models."""
    if not automl:
        return "none", ()
    if random:
        return "random", RANDOM_SEEDS
    return ("column", (42,)) if "fold" in columns else ("sequence", (42,))
