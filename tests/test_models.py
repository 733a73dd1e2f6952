import json

import numpy as np
import pandas as pd
import pytest

from descra import __main__ as cli
from descra.operators import crossval, kernels
from descra.plans import manifest
from descra.plans import run as plan


def data(n=40, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    return x, 5 * x[:, 0] - 2 * x[:, 1] + 0.3 * r.normal(size=n) + 1


def test_linear_and_elasticnet_are_optimal():
    x, y = data()
    m = kernels.fit("linear", x, y)
    residual = y - kernels.predict(m, x)
    assert np.abs(x.T @ residual).max() < 1e-8 and abs(residual.sum()) < 1e-8
    for alpha, l1 in ((0.3, 0.5), (0.1, 1.0), (1.0, 0.1)):
        m = kernels.fit("elasticnet", x, y, alpha=alpha, l1_ratio=l1)
        z, b = (x - x.mean(0)) / x.std(0), m["scaled_coef"]
        gradient = z.T @ (y - y.mean() - z @ b) / len(y) - alpha * (1 - l1) * b
        assert np.all(np.where(b != 0, np.abs(gradient - alpha * l1 * np.sign(b)) < 2e-4, np.abs(gradient) <= alpha * l1 + 2e-4))


def test_svm_meets_its_conditions():
    x, y = data(30)
    m = kernels.fit("svm", x, y)
    best = lambda w, b: 0.5 * w @ w + np.maximum(np.abs(y - x @ w - b) - 0.1, 0).sum()
    at, r = best(m["coef"], m["intercept"]), np.random.default_rng(1)
    assert all(best(m["coef"] + r.normal(size=5) * s, m["intercept"] + r.normal() * s) >= at - 1e-3 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_knn_and_forest():
    x = np.array([[0.0], [1.0], [2.0], [10.0]])
    y = np.array([0.0, 1.0, 2.0, 10.0])
    m = kernels.fit("knn", x, y, k=2, weights="distance")
    assert kernels.predict(m, np.array([[1.0], [0.5]])).tolist() == [1.0, 0.5]
    assert kernels.predict(kernels.fit("knn", x, y, k=4), x[:1])[0] == 3.25
    with pytest.raises(ValueError):
        kernels.fit("knn", x, y, k=5)
    x, y = data(80)
    m = kernels.fit("randomforest", x, y, trees=30)
    assert kernels.scores(y, kernels.predict(m, x))["r2"] > 0.9 and m["importance"].argmax() == 0
    with pytest.raises(ValueError):
        kernels.fit("gpr", x, y)


def brute_tree(x, y, least):
    """Prediction of the tree of the largest falls of the squared error, node by node."""
    n, best = len(y), (1e-9, None, None)
    for f in range(x.shape[1]):
        for v, w in zip(u := np.unique(x[:, f]), u[1:]):
            a = x[:, f] <= (v + w) / 2
            if min(a.sum(), n - a.sum()) >= least:
                fall = n * y.var() - a.sum() * y[a].var() - (~a).sum() * y[~a].var()
                if fall > best[0]:
                    best = (fall, f, (v + w) / 2)
    if best[1] is None:
        return lambda q: np.full(len(q), y.mean())
    a = x[:, best[1]] <= best[2]
    left, right = brute_tree(x[a], y[a], least), brute_tree(x[~a], y[~a], least)
    return lambda q: np.where(q[:, best[1]] <= best[2], left(q), right(q))


def test_trees_and_neighbours_are_those_of_brute_force():
    r = np.random.default_rng(4)
    x, q = r.random((300, 3)), r.random((200, 3))
    x[:, 0] = np.floor(6 * x[:, 0])
    y = 1000 * r.random(300)
    for least in (4, 30):
        tree = kernels.fit_tree(x, y, r, least=least)
        assert kernels.predict({"trees": [tree]}, q) == pytest.approx(brute_tree(x, y, least)(q))
    assert kernels.predict({"trees": [kernels.fit_tree(x, y, r)]}, x) == pytest.approx(y)
    # Equal and equally near rows: the first ones count, also where blocks are small.
    for known, rows in ((x, q), (np.round(x[r.integers(30, size=300)], 1), np.round(q, 1)), (np.round(x[:, :1]), np.round(q[:, :1])), (np.ones((7, 2)), np.zeros((3, 2)))):
        d = np.sqrt(((rows[:, None] - known[None]) ** 2).sum(2))
        want = np.argsort(d, axis=1, kind="stable")[:, :5]
        for block in (kernels.BLOCK, 40):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(kernels, "BLOCK", block)
                index, far = kernels.nearest(known, rows, 5)
            assert index.tolist() == want.tolist() and far.tolist() == np.take_along_axis(d, want, 1).tolist()


def test_no_model_forms_all_pairs_of_rows():
    import tracemalloc

    r = np.random.default_rng(6)
    x, y = r.random((6000, 3)), 10000 * r.random(6000) - 1000
    for kind, settings in (("svm", {}), ("knn", {"weights": "distance"}), ("randomforest", {"trees": 2})):
        tracemalloc.start()
        m = kernels.fit(kind, x, y, **settings)
        kernels.predict(m, x[::-1] / 2)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 80e6, (kind, most)  # a matrix of all pairs takes 288 MB
        if kind == "svm":  # the dual of this model is as good as the model
            beta = np.clip((y - kernels.predict(m, x)) * 1e6, -1, 1)
            w, b = m["coef"], m["intercept"]
            loss = 0.5 * w @ w + np.maximum(np.abs(y - x @ w - b) - 0.1, 0).sum()
            assert np.abs(x.T @ beta - w).max() < 5 and abs(beta.sum()) < 5
            assert all(0.5 * v @ v + np.maximum(np.abs(y - x @ v - b - s) - 0.1, 0).sum() >= loss - 1 for s in (0.0, 1.0, -1.0) for v in (w * 0.99, w * 1.01, w + [1, 0, 0], w - [0, 1, 0], w + [0, 0, 1]))


def test_selectors_find_the_signal():
    x, y = data(60)
    folds = [(np.arange(60)[np.arange(60) % 4 != k], np.arange(60)[np.arange(60) % 4 == k]) for k in range(4)]
    assert kernels.forward("linear", x, y, folds, 5) == [0, 1]
    assert kernels.forward("linear", x, y, folds, 5, floating=True) == [0, 1]
    assert kernels.eliminate(x, y, 2) == [0, 1] and kernels.stability(x, y, 50).argsort()[-2:].tolist() in ([0, 1], [1, 0])
    assert kernels.prune(np.stack([x[:, 0], x[:, 0] * 2, x[:, 3]], 1), y, ["a", "b", "c"]) == [0, 2]
    assert kernels.low_variance(np.ones((5, 3))).tolist() == [0]


def table(n=30):
    x, y = data(n, 3)
    return pd.DataFrame(x, columns=[f"f{k}" for k in range(5)]).assign(name=[f"n{k}" for k in range(n)], target_y=y, fold=np.arange(n) % 3, row_ord=np.arange(n))


SMALL = (crossval.Technique("elasticnet", prune=False, models=("elasticnet",), alphas=(0.01, 0.1), l1_ratios=(0.5,)), crossval.Technique("sfs_svm", selector="linear", models=("linear", "knn")))


def test_cross_validation(spark):
    df = spark.createDataFrame(table())
    found = crossval.cross_validate(df, ["target_y"], [f"f{k}" for k in range(5)], SMALL).persist()
    rows = found.collect()
    assert len(rows) == 6 and all(r.error is None for r in rows)
    assert all(r.spearman > 0.8 and {o.name for o in r.oof_rows} == {f"n{k}" for k in range(30) if k % 3 == r.outer_fold} for r in rows)
    # Test rows never matter to what is chosen.
    other = table()
    other.loc[other.fold == 0, "target_y"] = 99.0 + np.arange(10)
    again = {r.task_id: r for r in crossval.cross_validate(spark.createDataFrame(other), ["target_y"], [f"f{k}" for k in range(5)], SMALL).collect()}
    for r in rows:
        if r.outer_fold == 0:
            assert again[r.task_id].selected_features == r.selected_features and again[r.task_id].inner_pooled_spearman == r.inner_pooled_spearman
    assert crossval.cross_validate(df, ["target_y"], ["f0"], SMALL, done=found).count() == 0
    broken = crossval.cross_validate(spark.createDataFrame(table().assign(f0=float("nan"))), ["target_y"], ["f0"], SMALL[:1]).first()
    assert "missing values" in broken.error


@pytest.mark.parametrize("kind", ["linear", "knn", "randomforest"])
def test_final_model_predicts_as_data(spark, kind):
    m = crossval.refit(table(), "target_y", SMALL[1], kind, {"trees": 5} if kind == "randomforest" else {}, [f"f{k}" for k in range(5)])
    m = json.loads(json.dumps(m))
    got = crossval.predict(m, spark.createDataFrame(table())).toPandas()
    assert kernels.scores(got.target_y, got.prediction)["spearman"] > 0.7
    with pytest.raises(ValueError):
        crossval.predict(m, spark.createDataFrame(table()).drop(m["features"][0]))


def test_manifest_reports_everything():
    with pytest.raises(manifest.ManifestError) as e:
        manifest.parse({"inputs": {"assay": "x"}, "automl": {"folds": "many", "enabled": "maybe"}, "more": {}})
    assert len(e.value.problems) == 4
    with pytest.raises(manifest.ManifestError):
        manifest.parse({"inputs": {"assays": "a", "descriptors": "d"}, "run": {"output": "o"}, "automl": {"techniques": ["gpr"]}})
    m = manifest.parse({"inputs": {"assays": "a", "descriptors": "d"}, "run": {"output": "o"}, "automl": {"final_model": "no"}})
    assert m.stages() == ("read", "complete", "cross_validate") and len(m.digest()) == 64


def test_whole_run_from_descriptors(spark, tmp_path, capsys):
    t = table(24)
    (tmp_path / "json").mkdir()
    for r in t.itertuples():
        (tmp_path / "json" / f"{r.name}.json").write_text(json.dumps({"name": "other", "surface": {f"f{k}": getattr(r, f"f{k}") for k in range(5)}, "general": {"nested": {"7.5": 1.0, "list": [1]}}}))
    pd.DataFrame({"name": t.name, "heavy": ["A" * (k + 1) for k in range(24)], "light": "C", "target_y": t.target_y, "fold": t.fold}).to_csv(tmp_path / "assay.csv", index=False)
    settings = {"inputs": {"assays": f"file://{tmp_path}/assay.csv", "descriptors": f"file://{tmp_path}/json"}, "run": {"output": f"file://{tmp_path}/out"}, "automl": {"techniques": ["elasticnet"]}}
    (tmp_path / "s.json").write_text(json.dumps(settings))
    assert cli.main(["validate", str(tmp_path / "s.json")]) == 0
    log = plan.run(spark, manifest.parse(settings))
    assert not log.failed(), log.events
    model = plan.load_model(spark, f"file://{tmp_path}/out/models/target_y.json")
    assert model["kind"] == "elasticnet" and spark.read.parquet(f"file://{tmp_path}/out/results").count() == 3
    grid = spark.read.parquet(f"file://{tmp_path}/out/inner_selection/elasticnet_grid").collect()
    assert len(grid) == 3 * 63 and sum(r.chosen for r in grid) == 3 and (tmp_path / "out/failures.tsv").read_text().count("\n") == 1
    assert json.loads((tmp_path / "out/run_state.json").read_text())["ended"] is True
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["validate", str(tmp_path / "bad.json")]) == 2


def test_random_folds_run_for_every_seed(spark, tmp_path):
    t = table(24)
    assay = spark.createDataFrame(pd.DataFrame({"name": t.name, "heavy": ["A" * (k + 1) for k in range(24)], "light": "C", "target_y": t.target_y}))
    wide = spark.createDataFrame(t[["name", *(f"f{k}" for k in range(5))]])
    settings = {"inputs": {"assays": "a", "descriptors": "d"}, "run": {"output": f"file://{tmp_path}/out"}, "automl": {"techniques": ["elasticnet"], "split_randomly": True, "folds": 3, "final_model": False}}
    log = plan.Log()
    plan.train(spark, manifest.parse(settings), assay, wide, log)
    rows = [r for seed in (42, 43, 44) for r in spark.read.parquet(f"file://{tmp_path}/out/rs{seed}/results").collect()]
    assert not log.failed() and sorted((r.seed, r.outer_fold) for r in rows) == [(s, f) for s in (42, 43, 44) for f in range(3)]
    assert len({r.task_id for r in rows}) == 9 and all(r.error is None and f"|{r.seed}|" in r.task_id for r in rows)
    assert len({frozenset(o.name for o in r.oof_rows) for r in rows}) > 3
    # Few sequences give no folds: random ones then, for all seeds.
    settings["automl"]["split_randomly"] = False
    assert list(plan.prepare(assay.where("length(heavy) < 8"), wide, manifest.parse(settings))[0]) == [42, 43, 44]


def test_registered_cross_validation_runs_every_technique(spark, monkeypatch):
    from descra import catalog

    sf, asked, real = "/root/testdata/sf0.001", [], crossval.cross_validate
    monkeypatch.setattr(crossval, "cross_validate", lambda *a, **k: asked.append((a[3:], k)) or real(*a, **k))
    found = catalog.cross_validated_models(spark, sf)
    assert asked == [((), {})] and {"inner_pooled_spearman", "spearman", "pearson", "r2", "mse"} <= set(found.columns)


def test_levels_of_text_come_from_the_training_rows_alone(spark):
    t = table().assign(kind=["a" if k % 3 else "only in fold 0" for k in range(30)])
    t.loc[4, "kind"] = None
    x, names = crossval.design(t, ["f0", "kind"], ["kind"], np.flatnonzero(t.fold != 0))
    assert names == ["f0", "kind__a", "kind__NaN"] and x[t.fold == 0, 1:].sum() == 0 and x[4].tolist()[1:] == [0.0, 1.0]
    rows = crossval.cross_validate(spark.createDataFrame(t), ["target_y"], ["f0", "f1", "kind"], SMALL[:1]).collect()
    assert all(r.error is None for r in rows) and not any("only" in i.feature for r in rows if r.outer_fold == 0 for i in r.importance)
    assert any("only" in i.feature for r in rows if r.outer_fold == 1 for i in r.importance)
    # The final model takes the text itself.
    t["target_y"] += 9.0 * (t.kind == "a")
    m = json.loads(json.dumps(crossval.refit(t, "target_y", SMALL[1], "linear", {}, ["f0", "f1", "kind"])))
    assert any(c.startswith("kind__") for c in m["features"])
    got = crossval.predict(m, spark.createDataFrame(t.drop(columns="target_y"))).toPandas()
    low, width, coef = (np.array(m[k] if k != "coef" else m["model"]["coef"]) for k in ("low", "width", "coef"))
    own = np.stack([t[c].to_numpy(float) if c in t else (t.kind.isna() if c == "kind__NaN" else t.kind == c[6:]).to_numpy(float) for c in m["features"]], 1)
    assert got.prediction.to_numpy() == pytest.approx(((own - low) / width) @ coef + m["model"]["intercept"])


def test_flat_cross_validation_has_no_inner_scores(spark, tmp_path):
    df, features = spark.createDataFrame(table()), [f"f{k}" for k in range(5)]
    rows = crossval.cross_validate(df, ["target_y"], features, SMALL, flat=True).collect()
    assert len(rows) == 6 and all(r.error is None and r.inner_pooled_spearman is None and r.spearman > 0.8 for r in rows)
    assert {r.eval_model for r in rows if r.technique == "sfs_svm"} == {"linear"}
    t = table()
    grid = crossval.candidates(SMALL[0])
    for r in (r for r in rows if r.technique == "elasticnet"):
        x, y = t.loc[t.fold != r.outer_fold, features].to_numpy(), t.loc[t.fold != r.outer_fold, "target_y"].to_numpy()
        z, error = (x - x.mean(0)) / x.std(0), []
        for kind, settings in grid:
            parts = [kernels.predict(kernels.fit(kind, np.delete(z, p, 0), np.delete(y, p), **settings), z[p]) - y[p] for p in np.array_split(np.arange(len(y)), 5)]
            error.append(np.mean([(p**2).mean() for p in parts]))
        assert r.alpha == grid[int(np.argmin(error))][1]["alpha"]
    # One technique is deployed; of several none can be chosen.
    for some, fails in ((["elasticnet"], False), (["elasticnet", "intercorr_svm"], True)):
        settings = {"inputs": {"assays": "a", "descriptors": "d"}, "run": {"output": f"file://{tmp_path}/{fails}"}, "automl": {"techniques": some, "cv": "flat"}}
        log = plan.Log()
        plan.train(spark, manifest.parse(settings), spark.createDataFrame(t[["name", "target_y", "fold"]].assign(heavy=["A" * (k + 1) for k in range(30)], light="C")), spark.createDataFrame(t[["name", *features]]), log)
        assert log.failed() == fails, log.events


def test_a_task_that_ends_on_resume_has_not_failed(spark, tmp_path, monkeypatch):
    t = table()
    assay, wide = spark.createDataFrame(t[["name", "target_y", "fold"]].assign(heavy=["A" * (k + 1) for k in range(30)], light="C")), spark.createDataFrame(t[["name", "f0", "f1"]])
    settings = {"inputs": {"assays": "a", "descriptors": "d"}, "run": {"output": f"file://{tmp_path}/out"}, "automl": {"techniques": ["elasticnet"], "final_model": False}}
    real = crossval.run_task
    monkeypatch.setattr(crossval, "run_task", lambda table, technique, outer, *a: 1 / 0 if outer == 1 else real(table, technique, outer, *a))
    log = plan.Log()
    plan.train(spark, manifest.parse(settings), assay, wide, log)
    assert [e["task"].split("|")[-1] for e in log.events if e["event"] == "failed"] == ["1"]
    monkeypatch.setattr(crossval, "run_task", real)
    settings["run"]["resume"] = True
    log = plan.Log()
    plan.train(spark, manifest.parse(settings), assay, wide, log)
    assert not log.failed() and log.events[-1]["tasks"] == 3
