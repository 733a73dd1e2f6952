"""Choosing among scored candidates, always by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descra.operators import stats


def best(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The row of each group with the greatest values in this order; null scores never win."""
    rows = df.where(F.col(order[0]).isNotNull() & ~F.isnan(F.col(order[0]).cast("double")))
    names = [c for c in (keep or df.columns) if c not in keys]
    top = F.max_by(F.struct(*names), F.struct(*order)).alias("_")
    return (rows.groupBy(*keys) if keys else rows).agg(top).select(*keys, "_.*")


def ranks_descending(df: DataFrame, keys: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """0-based ranks within small groups (folds, features): greatest first, ties in order of ``tie``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))) - 1)


def fold_winners(results: DataFrame) -> DataFrame:
    """The technique of each target and outer fold with the best inner score; the later name wins a tie."""
    return best(results, ["target_col", "outer_fold"], ["inner_pooled_spearman", "technique"])


def deployed_technique(results: DataFrame) -> DataFrame:
    """For each target the technique with the best mean inner score; the later name wins a tie."""
    means = results.groupBy("target_col", "technique").agg(F.avg("inner_pooled_spearman").alias("mean_inner"))
    return best(means, ["target_col"], ["mean_inner", "technique"])


def wins(results: DataFrame) -> DataFrame:
    counts = fold_winners(results).groupBy("target_col", "technique").agg(F.count("*").alias("wins"))
    every = results.select("target_col", "technique").distinct()
    return every.join(counts, ["target_col", "technique"], "left").na.fill(0, ["wins"])


def technique_scores(results: DataFrame) -> DataFrame:
    """A row for each target and technique: pooled folds, means, modes and stability of the chosen features."""
    keys = ["target_col", "technique"]
    rows = results.select(*keys, F.explode("oof_rows").alias("o")).select(*keys, F.col("o.y").alias("y"), F.col("o.yhat").alias("yhat"))
    pooled = stats.metrics(rows, keys, "y", "yhat").select(*keys, F.col("spearman").alias("pooled_spearman"), F.col("pearson").alias("pooled_pearson"), F.col("r2").alias("pooled_r2"), F.col("mse").alias("pooled_mse"), F.col("n").alias("n_rows"))
    summary = results.groupBy(*keys).agg(
        F.count("*").alias("n_folds"),
        F.avg("spearman").alias("mean_spearman"),
        F.avg("inner_pooled_spearman").alias("mean_inner"),
        F.avg("n_selected_features").alias("mean_features"),
        stats.mode("eval_model").alias("eval_model"),
    )
    same = stats.mean_jaccard(results, keys, "outer_fold", "selected_features")
    return summary.join(pooled, keys, "left").join(same, keys, "left").join(wins(results), keys, "left")


def diagnostic_best(scores: DataFrame) -> DataFrame:
    """The best technique by pooled out-of-fold score: a diagnosis, which never deploys."""
    return best(scores, ["target_col"], ["pooled_spearman", "technique"])


def refit_settings(results: DataFrame, columns: list[str]) -> DataFrame:
    """Each setting's most frequent value over the outer folds, one by one; the least in a tie."""
    return results.groupBy("target_col", "technique").agg(*[stats.mode(c).alias(c) for c in columns])


def selected_by_fold(results: DataFrame) -> DataFrame:
    """key 'target|technique' and a map fold_1, fold_2, ... to the features chosen there."""
    entry = F.struct(F.concat(F.lit("fold_"), (F.col("outer_fold") + 1).cast("string")).alias("k"), F.col("selected_features").alias("v"))
    return results.groupBy(F.concat_ws("|", "target_col", "technique").alias("key")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("folds"))


def usage(results: DataFrame) -> DataFrame:
    """How often each feature was chosen: folds and share of folds."""
    keys = ["target_col", "technique"]
    total = results.groupBy(*keys).agg(F.countDistinct("outer_fold").alias("n_folds"))
    used = results.select(*keys, "outer_fold", F.explode(F.array_distinct("selected_features")).alias("feature")).groupBy(*keys, "feature").agg(F.countDistinct("outer_fold").alias("folds"))
    return used.join(total, keys).withColumn("share", F.col("folds") / F.col("n_folds"))


def label_order(label: Column) -> list[Column]:
    """Sort columns for split labels: whole numbers, then other numbers, then text."""
    text = F.trim(label.cast("string"))
    number = text.try_cast("double")
    return [F.when(number.isNotNull() & (number == F.floor(number)), 0).when(number.isNotNull(), 1).otherwise(2), number, text]
