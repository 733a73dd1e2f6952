"""What a run leaves behind."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.operators import selection
from descra.operators.columns import quoted


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles rounded, NaN and infinities null."""
    return df.select(*[F.round(F.when(F.isnan(quoted(c)) | (F.abs(quoted(c)) == float("inf")), None).otherwise(F.col(quoted(c))), digits).alias(c) if k == "double" else F.col(quoted(c)) for c, k in df.dtypes])


def write_descriptors(df: DataFrame, path: str) -> None:
    rounded(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_folds(folds: DataFrame, path: str) -> None:
    folds.write.mode("overwrite").partitionBy("dataset", "target", "seed").parquet(path)


def one_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A small table as one file in its order."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_run(results: DataFrame, path: str) -> None:
    """The artifacts of a cross-validation: predictions, metrics, comparisons, features, inner scores."""
    key = ["target_col", "technique", "outer_fold"]
    results.select(*key, F.explode("oof_rows").alias("o")).select(*key, "o.*").write.mode("overwrite").parquet(f"{path}/predictions/oof")
    one_csv(results.select(*key, "eval_model", "inner_pooled_spearman", "spearman", "n_test", "n_selected_features").orderBy(*key), f"{path}/metrics/outer_fold_metrics")
    scores = selection.technique_scores(results)
    one_csv(scores.orderBy("target_col", "technique"), f"{path}/technique_comparison")
    one_csv(selection.diagnostic_best(scores).orderBy("target_col"), f"{path}/best_technique")
    one_csv(selection.fold_winners(results).select(*key, "inner_pooled_spearman").orderBy(*key), f"{path}/fold_winners")
    selection.usage(results).write.mode("overwrite").parquet(f"{path}/features/feature_usage")
    selection.selected_by_fold(results).write.mode("overwrite").json(f"{path}/features/selected_features")
    candidates = candidate_scores(results)
    candidates.drop("alpha", "l1_ratio").write.mode("overwrite").parquet(f"{path}/inner_selection/inner_scores")
    candidates.where("model = 'elasticnet'").select(*key, "alpha", "l1_ratio", "score", "chosen").write.mode("overwrite").parquet(f"{path}/inner_selection/elasticnet_grid")


def candidate_scores(results: DataFrame) -> DataFrame:
    """target_col, technique, outer_fold, candidate, model, alpha, l1_ratio, score and whether it was chosen: every candidate's inner score."""
    key = ["target_col", "technique", "outer_fold"]
    each = results.select(*key, "eval_model", F.col("alpha").alias("_a"), F.col("l1_ratio").alias("_l"), F.explode("inner_scores").alias("s"))
    of = lambda name: F.get_json_object("s.candidate", f"$[1].{name}").cast("double")
    made = each.select(*key, F.col("s.candidate").alias("candidate"), F.get_json_object("s.candidate", "$[0]").alias("model"), of("alpha").alias("alpha"), of("l1_ratio").alias("l1_ratio"), F.col("s.score").alias("score"), "eval_model", "_a", "_l")
    chosen = (F.col("model") == F.col("eval_model")) & F.col("alpha").eqNullSafe(F.col("_a")) & F.col("l1_ratio").eqNullSafe(F.col("_l"))
    return made.withColumn("chosen", chosen).drop("eval_model", "_a", "_l")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then renamed to it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"cannot rename to {path}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def put_json(spark: SparkSession, path: str, value) -> str:
    """Writes value and returns its SHA-256."""
    text = json.dumps(value, sort_keys=True, indent=1, allow_nan=False)
    put_text(spark, path, text + "\n")
    return hashlib.sha256((text + "\n").encode()).hexdigest()


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, sha256 of every file: what tells whether a run changed its inputs."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.withColumnRenamed("sha256", "was"), after.withColumnRenamed("sha256", "now")
    return a.join(b, "path", "full").where(~F.col("was").eqNullSafe(F.col("now")))
