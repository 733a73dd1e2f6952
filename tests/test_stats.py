import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from descra.operators import clusters, folds, joins, kernels, selection, stats, validate


def test_metrics_handle_missing_and_constant(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.5), ("a", 2.0, None), ("a", float("nan"), 1.0), ("a", 5.0, 9.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), (None, 1.0, 3.0), (None, 4.0, 4.0)]
    got = {r.k: r for r in stats.metrics(spark.createDataFrame(rows, "k string, y double, p double"), ["k"], "y", "p").collect()}
    want = kernels.scores([1, 2, 5], [2, 2.5, 9])
    assert got["a"].n == 3 and all(math.isclose(got["a"][k], want[k]) for k in ("spearman", "pearson", "r2", "mse"))
    assert got["b"].spearman is None and got["c"].r2 is None and got[None].spearman == pytest.approx(1)
    assert stats.metrics(spark.createDataFrame([], "y double, p double"), [], "y", "p").first().spearman is None


def test_average_ranks(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 40, 500) / 7.0
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = {a.i: a.r for a in stats.average_rank(df, [], "x", "r").collect()}
    assert [got[i] for i in range(500)] == kernels.ranks(x).tolist()


def test_p_values():
    # Two-sided Student's t at known points.
    for t, df, p in ((2.228138852, 10, 0.05), (3.169272667, 10, 0.01), (12.7062047, 1, 0.05)):
        r = t / math.sqrt(df + t * t)
        assert stats.p_value(r, df + 2) == pytest.approx(p, rel=1e-6)
    assert stats.p_value(1.0, 5) == 0 and stats.p_value(None, 5) is None and stats.p_value(0.0, 10) == pytest.approx(1)


def test_screen_and_prunes(spark):
    r = np.random.default_rng(2)
    y = r.normal(size=60)
    rows = [(float(v), float(v + r.normal() * 0.1), float(r.normal())) for v in y]
    df = spark.createDataFrame(rows, "t double, good double, noise double")
    assert [x.feature for x in stats.target_screen(df, ["good", "noise"], "t").collect()] == ["good"]
    pairs = [("a", "b", 0.95), ("a", "c", -0.99), ("b", "c", 0.1)]
    assert stats.prune_pairs(pairs, {"a": 0.5, "b": 0.2, "c": -0.9}) == ["b", "c"]
    assert stats.prune_pairs([("a", "b", 0.95)], {"a": 0.5, "b": 0.5}) == ["a"]
    assert stats.prune_clusters(["a", "b", "c"], pairs, {"a": 0.5, "b": 0.2, "c": -0.9}) in (["b", "c"], ["c"])


def test_spearman_matrix_drops_missing_by_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 4.0, 6.0), (4.0, 3.0, 9.0)]
    got = {(r.a, r.b): (r.r, r.n) for r in stats.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], spearman=True).collect()}
    assert got["a", "c"][1] == 3 and got["a", "c"][0] == pytest.approx(1) and got["a", "b"][0] == pytest.approx(0.6)


GOLDEN = {(10, 42): [[5, 6], [0, 7], [3, 2], [4, 9], [1, 8]], (10, 43): [[2, 8], [9, 5], [7, 1], [4, 6], [0, 3]], (21, 44): [[18, 20, 9, 10, 4], [8, 0, 15, 11], [16, 13, 3, 19], [2, 17, 12, 5], [1, 14, 6, 7]]}


@pytest.mark.parametrize("n,seed", GOLDEN)
def test_shuffled_folds(n, seed):
    cut = folds.shuffled(n, 5, seed)
    assert [[r for r, f, _ in cut if f == k] for k in range(5)] == GOLDEN[n, seed]


def test_fold_helpers(spark):
    assert folds.merge_clusters({"a": 5, "b": 1, "c": 2, "d": 4}, 3) == {"a": 0, "d": 1, "b": 2, "c": 2}
    assert folds.merge_clusters({"a": 1}, 2) is None
    assert folds.identity("ACDE", "ACDE") == 1 and folds.identity("AAAA", "CCCC") == 0 and folds.identity("ACDE", "ADE") == 0.75
    found = folds.sequence_folds({f"{g}{i}": g * 20 + "WY"[i % 2] for g in "ACDEF" for i in range(3)})
    assert found and len({found[0][f"A{i}"] for i in range(3)}) == 1 and found[2] == 5
    assert folds.sequence_folds({"a": "A"}) is None and folds.resolve_split(True, []) == ("random", (42, 43, 44)) and folds.resolve_split(False, ["fold"])[0] == "column"
    df = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", "x"), ("d", "9")], "name string, fold_label string")
    assert {r.name: r.fold for r in folds.column_folds(df, "fold_label").collect()} == {"b": 0, "d": 0, "a": 1, "c": 2}
    with pytest.raises(ValueError):
        folds.column_folds(df.where("name = 'a'"), "fold_label")
    hot = folds.one_hot(spark.createDataFrame([("u", 0), ("v", 0), ("w", 1), (None, 1)], "c string, f int"), ["c"], F.col("f") == 0)
    assert [tuple(r) for r in hot.orderBy("f", "c__u", "c__v", "c__NaN").collect()] == [(0, 0.0, 1.0, 0.0), (0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 1.0)]


RESULTS = "target_col string, technique string, outer_fold int, inner_pooled_spearman double, spearman double, eval_model string, alpha double, n_selected_features int, selected_features array<string>, oof_rows array<struct<name: string, y: double, yhat: double>>"


def results(spark, scores):
    return spark.createDataFrame([("t", k, i, s, 0.5, "svm", 0.01 if i < 2 else 0.3, 1, ["f", "g"][: i + 1], [(f"n{i}{j}", float(j), float(j * j)) for j in range(3)]) for k, some in scores.items() for i, s in enumerate(some)], RESULTS)


def test_selection_rules(spark):
    r = results(spark, {"elasticnet": [0.80, 0.90], "sfs_svm": [0.95, 0.10]})
    assert [x.technique for x in selection.fold_winners(r).orderBy("outer_fold").collect()] == ["sfs_svm", "elasticnet"]
    assert selection.deployed_technique(r).first().technique == "elasticnet"
    tie = results(spark, {"elasticnet": [0.5], "sfs_svm": [0.5]})
    assert selection.fold_winners(tie).first().technique == "sfs_svm"
    majority = results(spark, {"elasticnet": [0.51, 0.51, 0.10], "sfs_svm": [0.50, 0.50, 0.90]})
    assert selection.deployed_technique(majority).first().technique == "sfs_svm"
    assert {x.technique: x.wins for x in selection.wins(majority).collect()} == {"elasticnet": 2, "sfs_svm": 1}
    assert selection.refit_settings(majority, ["alpha"]).first().alpha == 0.01
    scored = {x.technique: x for x in selection.technique_scores(majority).collect()}
    assert scored["sfs_svm"].n_folds == 3 and scored["sfs_svm"].jaccard == pytest.approx((0.5 + 0.5 + 1) / 3) and scored["sfs_svm"].n_rows == 9
    assert selection.selected_by_fold(tie).first().folds["fold_1"] == ["f"]
    assert selection.diagnostic_best(selection.technique_scores(majority)).count() == 1


def test_validation(spark):
    df = spark.createDataFrame([("a", "X", "Y", 1.0), ("a ", "X", "Y", None), ("b|c", "X", "y", 2.0), ("", None, "Z", 3.0)], "name string, heavy string, light string, target_t double")
    rules = {r.rule for r in validate.assay(df).collect()}
    assert rules == {"missing values", "bar in name", "empty name", "duplicate name", "duplicate sequences"}
    with pytest.raises(validate.ValidationError):
        validate.require(validate.assay(df))
    assert validate.assay(df.drop("target_t")).first().key == "target_*"
    assert validate.drop_missing_targets(df, "target_t").count() == 3
    with pytest.raises(validate.ValidationError):
        validate.drop_missing_targets(df, "target_t", 0.25)
    assert {r.rule for r in validate.assay(df.limit(0)).collect()} == {"no rows"}


def test_joins(spark):
    a, b = (spark.createDataFrame(x, "name string, v int") for x in ([("1", 1), (" 2", 2)], [("1 ", 5), ("2", 6), ("3", 7)]))
    assert {tuple(r) for r in joins.merge_sources([("s", a), ("s", b)]).collect()} == {("1", 1, 5), ("2", 2, 6)}
    assert joins.merge_sources([("s", a), ("s", b)]).columns == ["name", "v_s", "v_s_2"]
    with pytest.raises(validate.ValidationError):
        joins.merge_descriptors(b, a)
    left = spark.createDataFrame([("ALA", 1, ""), ("ALA", 2, ""), ("ALA", 3, "A"), ("ALA", 4, ""), ("ALA", 4, "Q")], "r string, n int, c string")
    right = spark.createDataFrame([("ALA", 1, "A", 1.0), ("ALA", 2, "", 2.0), ("ALA", 2, "B", 3.0), ("ALA", 4, "A", 4.0), ("ALA", 4, "B", 5.0)], "r string, n int, c string, v double")
    assert {(x.n, x.c): x.v for x in joins.repaired(left, right, ["r", "n"], "c", "v").collect()} == {(1, ""): 1.0, (2, ""): 2.0, (3, "A"): None, (4, ""): None, (4, "Q"): None}


def test_dbscan_hull_and_charge():
    xyz = np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [10, 0, 0], [11, 0, 0], [50, 0, 0.0]])
    assert clusters.dbscan(xyz, 1.5, 2).tolist() == [0, 0, 0, 1, 1, -1]
    cube = np.array([[x, y, z] for x in (0, 2) for y in (0, 2) for z in (0, 2)] + [[1, 1, 1], [0.5, 0.5, 1]], float)
    assert clusters.hull_volume(cube) == pytest.approx(8) and clusters.hull_volume(cube[:3]) == 0 and clusters.hull_volume(cube[[0, 1, 2, 3]]) == pytest.approx(0)
    ball = np.random.default_rng(0).normal(size=(400, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    assert 3.9 < clusters.hull_volume(ball) < 4.19
    assert clusters.isoelectric_point(np.array([4.0, 10.0]), np.array([True, False])) == pytest.approx(7.0)
    assert clusters.isoelectric_point(np.array([4.0]), np.array([True])) is None


def test_surface_enrichment_draws_in_order():
    r = np.random.default_rng(3)
    xyz = r.normal(size=(30, 3)) * 8
    some = clusters.surface_enrichment(xyz, {"neg": np.array([0]), "pos": np.arange(5), "hyd": np.arange(10, 20)}, draws=20)
    again = clusters.surface_enrichment(xyz, {"pos": np.arange(5), "hyd": np.arange(10, 20)}, draws=20)
    assert some["neg", 0] == 0 and all(some[k] == v for k, v in again.items())


def test_hydrogen_bonds_are_greedy():
    item = lambda x, n, cap, base=None: {"xyz": (x, 0.0, 0.0), "base": base, "capacity": cap, "residue": n, "chain": "H", "seq_idx": n, "backbone": False}
    donors = [item(0.0, 0, 1, (-1.0, 0.0, 0.0)), item(0.5, 1, 2, (1.5, 0.0, 0.0))]
    acceptors = [item(3.0, 5, 1), item(2.0, 6, 1), item(-2.0, 7, 1)]
    assert clusters.hydrogen_bonds(donors, acceptors) == [(0, 0), (1, 2)]


def test_a_donor_without_its_base_atom_bonds_with_nothing():
    item = lambda x, n, base=None: {"xyz": (x, 0.0, 0.0), "base": base, "capacity": 1, "residue": n, "chain": "H", "seq_idx": 4 * n, "backbone": True}
    assert clusters.hydrogen_bonds([item(0.0, 0)], [item(2.0, 1)]) == []
    assert clusters.hydrogen_bonds([item(0.0, 0), item(0.0, 2, (-1.0, 0.0, 0.0))], [item(2.0, 1)]) == [(1, 0)]


def test_values_without_an_insertion_code(spark):
    left = spark.createDataFrame([("s", "H", 100, "", "GLY"), ("s", "H", 100, "A", "GLY"), ("s", "H", 100, "B", "ALA"), ("s", "H", 7, "A", "TYR")], "s string, chain string, resnum int, icode string, resname string")
    right = spark.createDataFrame([("s", "H", 100, "", "GLY", 1.0), ("s", "H", 100, "B", "ALA", 2.0), ("s", "H", 7, "B", "TYR", 3.0)], "s string, chain string, resnum int, icode string, resname string, v double")
    got = joins.or_without_code(left, right, ["s", "chain", "resnum", "icode", "resname"], "icode")
    assert {(r.resnum, r.icode): r.v for r in got.collect()} == {(100, ""): 1.0, (100, "A"): 1.0, (100, "B"): 2.0, (7, "A"): None}


def test_the_screen_leaves_out_a_q_of_exactly_the_bound(spark):
    df = spark.createDataFrame([(float(k), float(k % 7), k + (k % 3) * 2.0) for k in range(30)], "a double, b double, t double")
    q = {r.feature: r.q for r in stats.target_screen(df, ["a", "b"], "t", most_q=2.0).collect()}
    assert {r.feature for r in stats.target_screen(df, ["a", "b"], "t", most_q=q["b"]).collect()} == {f for f in q if q[f] < q["b"]}


def test_mean_jaccard_of_classes_is_that_of_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = [(f"g{k % 3}", k, [f"f{x}" for x in r.choice(4, r.integers(0, 4), replace=False)]) for k in range(60)] + [("lone", 1, ["a"]), ("none", 1, [])]
    got = {x.g: x.jaccard for x in stats.mean_jaccard(spark.createDataFrame(rows, "g string, m int, f array<string>"), ["g"], "m", "f").collect()}
    for g in ("g0", "g1", "g2"):
        sets = [set(f) for k, _, f in rows if k == g and f]
        assert got[g] == pytest.approx(np.mean([len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]))
    assert got["lone"] is None and got["none"] is None


def test_votes_and_columns_that_weigh_most(spark):
    runs = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["b", "a", "a"],)], "f array<string>")
    assert [tuple(r) for r in stats.votes(runs, "f", 2).collect()] == [("b", 3), ("a", 2)]
    x = np.random.default_rng(2).normal(size=(50, 5))
    y = 3 * x[:, 1] - 2 * x[:, 4] + 0.1 * x[:, 0]
    assert kernels.strongest("linear", x, y, 2) == [1, 4] and kernels.strongest("knn", x, y, 2) == [1, 4] and kernels.strongest("knn", x, y, 9) == [0, 1, 2, 3, 4]
    assert sorted(kernels.most_stable(x, y, 2)) == [1, 4]


def test_buckets_of_a_heavy_tail_hold_equal_shares(spark):
    r = random.Random(4)
    rows = [("a", math.exp(r.gauss(0, 3))) for _ in range(20000)] + [("b", float(i % 7)) for i in range(50)] + [(None, 1.0), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = stats._running(df, ["k"], "v").collect()
    values = sorted(v for k, v in rows if k == "a")
    assert [x.below for x in sorted((x for x in got if x.k == "a"), key=lambda x: x.v)] == list(range(20000)) and len(values) == 20000
    assert {(x.v, x.n, x.below) for x in got if x.k == "b"} == {(float(v), 7 + (v == 0), v and 7 * v + 1) for v in range(7)}
    assert [(x.v, x.n, x.below) for x in got if x.k is None] == [(1.0, 1, 0)]
    shares = Counter(x._bucket for x in got if x.k == "a")
    assert len(shares) == stats.BUCKETS and max(shares.values()) < 3 * 20000 / stats.BUCKETS


@pytest.mark.parametrize("keys", [["k"], []])
def test_adjusted_p_values_against_the_definition(spark, keys):
    r = random.Random(5)
    rows = [(r.choice("aab"), None if r.random() < 0.1 else round(r.random() ** 4, 3), i) for i in range(1500)]
    got = {x.i: x.q for x in stats.benjamini_hochberg(spark.createDataFrame(rows, "k string, p double, i int"), keys, "p").collect()}
    for k in "ab" if keys else [None]:
        some = sorted((p, i) for g, p, i in rows if p is not None and k in (None, g))
        least = 1.0
        for rank in range(len(some), 0, -1):
            p, i = some[rank - 1]
            least = min(least, p * len(some) / rank)
            assert got[i] == pytest.approx(least)
    assert all(got[i] is None for _, p, i in rows if p is None) and len(got) == len(rows)
