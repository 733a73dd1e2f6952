import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from descra.llm import toxicity as tx


def corpus(n=1200, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    bad = ["vilewretch", "schurkenbein", "schurkenfuß", "gemeinlump"]
    for d in range(n):
        w = ["".join(r.choice("abcdeéort") for _ in range(r.randint(2, 9))) for _ in range(r.choice([5, 40, 200]))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((d, " ".join(w)))
        if r.random() < 0.8:
            labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_rows_are_scored_well(spark):
    rows, labels = corpus()
    extra = [(None, None), (5000, ""), (5001, None), (5001, "x"), (5002, "YOU " * 50000)]
    df = spark.createDataFrame([(*x, "z") for x in rows + extra], "doc_id long, text string, score string").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1), (1, None), (7, 3)], "doc_id long, toxic int")
    scorer = tx.learn(df, known)
    got = tx.with_scores(df, scorer).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.toxicity <= 1 for r in got)
    score, y = {r.doc_id: r.toxicity for r in got}, dict(labels)
    test = [d for d in y if zlib.crc32(str(d).encode()) % 5 == 0]
    right = np.mean([(score[d] >= 0.5) == y[d] for d in test])
    assert len(test) > 100 and right > 0.97
    kept = tx.remove_toxic(df, df, known)
    assert kept.columns == df.columns and abs(kept.count() - sum(s < 0.5 for s in (r.toxicity for r in got))) == 0
    # Held-out labels do not matter.
    flipped = spark.createDataFrame([(d, 1 - t if d in set(test) else t) for d, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.toxicity for r in tx.with_scores(df, tx.learn(df, flipped)).collect()}
    assert all(again[d] == score[d] for d in test)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_without_two_kinds_of_labels(spark, labels):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    got = tx.with_scores(df, tx.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert {round(r.toxicity) for r in got} == {int(labels == [(1, 1)] and zlib.crc32(b"1") % 5 != 0)}
    assert tx.with_scores(df.limit(0), tx.learn(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))).count() == 0


def test_features_are_those_of_each_text_alone():
    texts = ["You IDIOT!!! 1d1ot f*ck", None, "", "plain words", "éÉ 42 x9 aaaa?"]
    strong = np.sort(tx.word_hashes(["idiot"]))
    together = tx.features(pa.array(texts, pa.large_string()), strong, strong[:0])
    for k, t in enumerate(texts):
        assert np.allclose(tx.features(pa.array([t], pa.large_string()), strong, strong[:0])[0], together[k])
    f = dict(zip(tx.FEATURES, together[0]))
    assert f["strong_density"] == 1 / 5 and f["alike_density"] == 1 / 5 and f["second_person_near"] == 1 / 5 and f["masked"] > 0


def test_isotonic_is_monotone_and_exact():
    x, y = tx.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0]))
    assert list(np.interp([0.1, 0.25, 0.5], x, y)) == [0, 0.5, 1] and (np.diff(y) >= 0).all()
