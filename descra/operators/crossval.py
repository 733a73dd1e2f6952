"""Nested cross-validation: a row a task, a grouped map over tasks, results as one table.

A task is (target, technique, outer fold).  Its group is the assay table of that
target, copied by a join on the target: mostly some hundreds of rows, and no
more than a worker can hold.  Tasks are spread by their id, so that a slow
technique does not fill one partition.  A task that fails gives a row with the
reason.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descra.operators import kernels
from descra.operators.columns import quoted

RESULT = (
    "task_id string, target_col string, technique string, seed int, outer_fold int, eval_model string, alpha double, l1_ratio double, inner_pooled_spearman double, "
    "spearman double, pearson double, r2 double, mse double, n_test int, n_selected_features int, selected_features array<string>, "
    "oof_rows array<struct<name: string, y: double, yhat: double>>, importance array<struct<feature: string, weight: double, permutation: double>>, "
    "inner_scores array<struct<candidate: string, score: double>>, error string"
)


@dataclass(frozen=True)
class Technique:
    name: str
    prune: bool = True
    selector: str | None = None  # model that forward selection scores with
    models: tuple[str, ...] = ("svm",)
    alphas: tuple[float, ...] = ()
    l1_ratios: tuple[float, ...] = ()
    settings: dict = field(default_factory=dict)  # model -> settings


EVALUATED = ("svm", "knn", "linear", "randomforest")
SETTINGS = {"knn": {"weights": "distance"}, "randomforest": {"trees": 100}}
TECHNIQUES = (
    Technique("elasticnet", prune=False, models=("elasticnet",), alphas=(0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), l1_ratios=(0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0)),
    Technique("intercorr_svm", models=("svm",)),
    Technique("sfs_svm", selector="svm", models=EVALUATED, settings=SETTINGS),
    Technique("sfs_knn", selector="knn", models=EVALUATED, settings=SETTINGS),
)


def select(technique: Technique, x: np.ndarray, y: np.ndarray, names: Sequence[str], folds: list[kernels.Fold], share: float = 0.15, gain: float = 0.02) -> list[int]:
    """Columns chosen on these rows only: variance, then correlated pairs, then forward selection."""
    if technique.models == ("elasticnet",):
        return list(range(x.shape[1]))
    keep = list(kernels.low_variance(x))
    if technique.prune:
        kept = kernels.prune(x[:, keep], y, [names[k] for k in keep])
        keep = [keep[k] for k in kept]
    if technique.selector:
        chosen = kernels.forward(technique.selector, x[:, keep], y, folds, max(1, int(share * len(x))), gain)
        keep = [keep[k] for k in chosen]
    return keep


def candidates(technique: Technique) -> list[tuple[str, dict]]:
    if technique.alphas:
        return [("elasticnet", {"alpha": a, "l1_ratio": b}) for a in technique.alphas for b in technique.l1_ratios]
    return [(m, technique.settings.get(m, {})) for m in technique.models]


def trained(kind: str, settings: dict, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[dict, np.ndarray]:
    """A model on scaled columns (the elastic net scales by itself) and its predictions."""
    if kind != "elasticnet":
        a, b = kernels.min_max(a, b)
    model = kernels.fit(kind, a, y, **settings)
    return model, kernels.predict(model, b)


def design(table: pd.DataFrame, features: list[str], text: Sequence[str], train: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The columns of all rows, text features as a 0/1 column for each level that the train rows have, and one for missing."""
    numbers = [f for f in features if f not in text]
    parts, names = [table[numbers].to_numpy(float)], list(numbers)
    if np.isnan(parts[0]).any():
        raise ValueError("missing values")
    for c in (f for f in features if f in text):
        value = table[c].to_numpy(object)
        gone = pd.isna(value)
        own = gone[train]
        levels = sorted({str(v) for v in value[train][~own]})
        of_row = np.where(gone, "", value.astype(str))
        parts += [((of_row == v) & ~gone).astype(float)[:, None] for v in levels] + [gone.astype(float)[:, None]]
        names += [f"{c}__{v}" for v in levels] + [f"{c}__NaN"]
    return np.concatenate(parts, axis=1), names


def flat_grid(options: list[tuple[str, dict]], x: np.ndarray, y: np.ndarray) -> int:
    """The grid point with the least mean squared error over folds of neighbouring rows, columns scaled over all rows."""
    n = len(y)
    cv = min(5, max(2, n // 2)) if n >= 4 else 2
    spread = x.std(0)
    x = (x - x.mean(0)) / np.where(spread > 0, spread, 1.0)
    errors = np.zeros(len(options))
    for test in np.array_split(np.arange(n), cv):
        train = np.setdiff1d(np.arange(n), test)
        for i, (kind, settings) in enumerate(options):
            p = trained(kind, settings, x[train], y[train], x[test])[1]
            errors[i] += ((p - y[test]) ** 2).mean() / cv
    return int(errors.argmin())


def run_task(table: pd.DataFrame, technique: Technique, outer: int, features: list[str], text: Sequence[str] = (), flat: bool = False) -> dict:
    """One outer fold: the candidate with the best pooled inner score, then a fit on all outer training rows.

    ``flat``: no inner folds and no inner score; the model is the one that selects (or the first), the elastic net's
    grid point that of ``flat_grid`` over the outer training rows.  Levels of text features are those of the rows
    that a model is trained on.
    """
    table = table.sort_values("row_ord", kind="stable")
    y, fold = table["y"].to_numpy(float), table["fold"].to_numpy()
    if np.isnan(y).any():
        raise ValueError("missing values")
    train, test = np.flatnonzero(fold != outer), np.flatnonzero(fold == outer)
    inner = [(np.flatnonzero((fold != outer) & (fold != i)), np.flatnonzero(fold == i)) for i in sorted(set(fold.tolist()) - {outer})]
    inner = [(a, b) for a, b in inner if len(a) >= 2 and len(b) >= 2]
    options = candidates(technique)
    pooled: list[tuple[list, list]] = [([], []) for _ in options]
    for i, (a, b) in enumerate(() if flat else inner):
        assert not set(table["name"].iloc[np.concatenate([a, b])]) & set(table["name"].iloc[test]), "a test name is in an inner fold"
        # Selection inside sees other inner folds only.
        others = [(np.intersect1d(a, c), np.intersect1d(a, d)) for k, (c, d) in enumerate(inner) if k != i]
        place = {int(r): n for n, r in enumerate(a)}
        local = [(np.array([place[int(r)] for r in c]), np.array([place[int(r)] for r in d])) for c, d in others if len(c) >= 2 and len(d) >= 2]
        x, names = design(table, features, text, a)
        keep = select(technique, x[a], y[a], names, local)
        for n, (kind, settings) in enumerate(options):
            try:
                _, p = trained(kind, settings, x[a][:, keep], y[a], x[b][:, keep])
            except ValueError:
                p = np.full(len(b), np.nan)
            pooled[n][0].append(y[b])
            pooled[n][1].append(p)
    inner_scores = [kernels.scores(*map(np.concatenate, p))["spearman"] if p[0] else None for p in pooled]
    key = lambda n: (-np.inf if inner_scores[n] is None else inner_scores[n], options[n][1].get("alpha", 0.0), options[n][1].get("l1_ratio", 0.0), options[n][0])
    x, names = design(table, features, text, train)
    if not flat:
        best = max(range(len(options)), key=key)
    elif technique.alphas:
        best = flat_grid(options, x[train], y[train])
    else:
        best = next((i for i, (m, _) in enumerate(options) if m == technique.selector), 0)
    kind, settings = options[best]
    place = {int(r): n for n, r in enumerate(train)}
    local = [(np.array([place[int(r)] for r in a]), np.array([place[int(r)] for r in b])) for a, b in inner]
    keep = select(technique, x[train], y[train], names, local)
    model, p = trained(kind, settings, x[train][:, keep], y[train], x[test][:, keep])
    shown = x[test][:, keep] if kind == "elasticnet" else kernels.min_max(x[train][:, keep], x[test][:, keep])[1]
    effect = kernels.permutation_importance(model, shown, y[test]) if len(test) > 1 else np.zeros(len(keep))
    weight = np.asarray(model.get("coef", model.get("importance", np.zeros(len(keep)))), float)
    used = [k for n, k in enumerate(keep) if kind != "elasticnet" or weight[n] != 0]
    return {
        "eval_model": kind,
        "alpha": settings.get("alpha"),
        "l1_ratio": settings.get("l1_ratio"),
        "inner_pooled_spearman": inner_scores[best],
        **{k: v for k, v in kernels.scores(y[test], p).items() if k != "n"},
        "n_test": len(test),
        "n_selected_features": len(used),
        "selected_features": [names[k] for k in used],
        "oof_rows": [{"name": str(n), "y": float(a), "yhat": float(b)} for n, a, b in zip(table["name"].iloc[test], y[test], p)],
        "importance": [{"feature": names[k], "weight": float(w), "permutation": float(e)} for k, w, e in zip(keep, weight, effect)],
        "inner_scores": [{"candidate": json.dumps([m, s], sort_keys=True), "score": s_} for (m, s), s_ in zip(options, inner_scores)],
    }


def cross_validate(table: DataFrame, targets: list[str], features: list[str], techniques: Sequence[Technique] = TECHNIQUES, done: DataFrame | None = None, seed: int = 42, flat: bool = False) -> DataFrame:
    """Results (RESULT) of every technique, target and outer fold of table (name, fold, row_ord, targets, features).

    done holds finished results (task_id): those tasks are left out.  seed is that of the folds.  Features that are
    text become 0/1 columns of the levels of the rows that a model is trained on.
    """
    spark = table.sparkSession
    text = tuple(f for f, kind in table.dtypes if f in features and kind == "string")
    known = {t.name: t for t in techniques}
    # A grouped map cannot name columns with dots, which some descriptors have.
    plain = {f"x{i}": f for i, f in enumerate(features)}
    values = F.array(*[F.struct(F.lit(t).alias("target_col"), F.col(quoted(t)).cast("double").alias("y")) for t in targets])
    long = table.select("name", "fold", "row_ord", *[F.col(quoted(f)).alias(x) for x, f in plain.items()], F.explode(values).alias("_")).select("name", "fold", "row_ord", *plain, "_.*").where("y is not null and not isnan(y)")
    names = spark.createDataFrame([(t,) for t in known], "technique string")
    tasks = long.select("target_col", F.col("fold").alias("outer_fold")).distinct().crossJoin(names).withColumn("task_id", F.concat_ws("|", "target_col", "technique", F.lit(str(seed)), F.col("outer_fold").cast("string")))
    if done is not None:
        tasks = tasks.join(done.where("error is null").select("task_id"), "task_id", "left_anti")
    columns = [c.split()[0] for c in RESULT.replace("array<struct<name: string, y: double, yhat: double>>", "x").replace("array<struct<feature: string, weight: double, permutation: double>>", "x").replace("array<struct<candidate: string, score: double>>", "x").split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        out = dict.fromkeys(columns) | {"task_id": head.task_id, "target_col": head.target_col, "technique": head.technique, "seed": seed, "outer_fold": int(head.outer_fold)}
        try:
            out |= run_task(frame.rename(columns=plain), known[head.technique], int(head.outer_fold), features, text, flat)
        except Exception as e:  # a failed task is a result, which the caller sees and can run again
            out["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([out], columns=columns).astype({"seed": "int32", "outer_fold": "int32"})

    return long.join(tasks, "target_col").groupBy("task_id").applyInPandas(run, RESULT)


def refit(table: pd.DataFrame, target: str, technique: Technique, kind: str, settings: dict, features: list[str]) -> dict:
    """The final model on all rows with a value: plain parameters, scaling included."""
    table = table[table[target].notna()].sort_values("row_ord", kind="stable")
    text = [f for f in features if table[f].dtype == object or isinstance(table[f].dtype, pd.StringDtype)]
    x, names = design(table, features, text, np.arange(len(table)))
    y, fold = table[target].to_numpy(float), table["fold"].to_numpy()
    made = {f"{c}__{v}": [c, v] for c in text for v in table[c].dropna().astype(str).unique()} | {f"{c}__NaN": [c, None] for c in text}
    folds = [(np.flatnonzero(fold != i), np.flatnonzero(fold == i)) for i in sorted(set(fold.tolist()))]
    keep = select(technique, x, y, names, folds)
    low, width = x[:, keep].min(0), np.ptp(x[:, keep], axis=0)
    a = x[:, keep] if kind == "elasticnet" else kernels.min_max(x[:, keep])[0]
    return {"target": target, "technique": asdict(technique), "kind": kind, "settings": settings, "features": [names[k] for k in keep], "levels": {names[k]: made[names[k]] for k in keep if names[k] in made}, "scaled": kind != "elasticnet", "low": low.tolist(), "width": width.tolist(), "model": _plain(kernels.fit(kind, a, y, **settings)), "n_rows": len(y)}


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x


def _arrays(x):
    if isinstance(x, dict):
        return {k: _arrays(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_arrays(v) for v in x] if x and isinstance(x[0], dict) else np.array(x)
    return x


def predict(model: dict, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """rows with predictions.  A missing, non-numeric or null feature is an error.

    A linear model is one expression; any other is small and goes with the tasks.
    """
    from descra.operators import validate

    kinds = dict(rows.dtypes)
    levels = model.get("levels", {})
    numbers = [c for c in model["features"] if c not in levels]
    gone = [c for c in [*numbers, *dict.fromkeys(c for c, _ in levels.values())] if c not in kinds]
    odd = [c for c in numbers if c in kinds and kinds[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kinds[c].startswith("decimal")]
    if gone or odd:
        raise ValueError("; ".join([f"missing column {c}" for c in gone] + [f"{c} is not a number" for c in odd]))
    if numbers:
        validate.require(validate.null_counts(rows, numbers))

    def value(c: str):
        if c not in levels:
            return F.col(quoted(c)).cast("double")
        source, level = levels[c]
        own = F.col(quoted(source))
        return own.isNull().cast("double") if level is None else F.coalesce((own.cast("string") == level).cast("double"), F.lit(0.0))

    scaled = [(value(c) - lo) / w if w > 0 else F.lit(0.0) for c, lo, w in zip(model["features"], model["low"], model["width"])] if model["scaled"] else [value(c) for c in model["features"]]
    if "coef" in model["model"]:
        total = F.lit(float(model["model"]["intercept"]))
        for c, b in zip(scaled, model["model"]["coef"]):
            total = total + c * float(b)
        return rows.withColumn(name, total)
    own = rows.withColumn("_x", F.array(*scaled))
    parameters = model["model"]

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(kernels.predict(_arrays(parameters), np.stack(x.to_numpy())) if len(x) else [])

    return own.withColumn(name, apply("_x")).drop("_x")
