from collections import Counter

import numpy as np
import pytest

from descra.llm import embeddings as em


def brute(rows, threshold):
    root = {v: v for v, _, _ in rows if v is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def vector(e):
        x = np.array([np.nan if c is None else c for c in e or [0]], float)
        return x if np.isfinite(x).all() and (x != 0).any() else None

    n = Counter()
    for i, (v, l, e) in enumerate(rows):
        for w, m, f in rows[:i]:
            x, y = vector(e), vector(f)
            if None in (v, w, l, m) or l != m or x is None or y is None or len(x) != len(y):
                continue
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[v] += 1
                n[w] += 1
                a, b = find(v), find(w)
                root[max(a, b)] = min(a, b)
    return Counter((v, 0 if v is None else n[v], None if v is None else find(v), None if v is None else find(v) == v) for v, _, _ in rows)


@pytest.mark.parametrize("seed,tile", [(1, 512), (2, 7), (3, 3)])
def test_against_brute_force(spark, seed, tile):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        base = r.normal(size=24) * [1, 10, 0.1][k % 3]
        for _ in range(r.choice([1, 2, 5])):
            rows.append((len(rows) * 3 % 1009, int(r.integers(3)), (base + r.normal(size=24) * 0.15 * np.abs(base).mean()).tolist()))
    rows += [(2000, None, rows[0][2]), (None, 1, rows[0][2]), (2001, 1, None), (2002, 1, [0.0] * 24), (2003, 1, [float("nan")] + [1.0] * 23), (2004, 1, [None] + [1.0] * 23), (2005, 1, []), (2006, 1, [1.0, 2.0]), (2007, 1, [2.0, 4.0]), (2008, 1, [float("inf")] * 24), (2009, 0, [1e-300] * 24), (2010, 0, [1e300] * 24), (0, 5, [1.0] * 24), (0, 5, [1.0] * 24)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, label int, embedding array<double>, kept int").repartition(3)
    big = [x if x[0] not in (2009, 2010) else (x[0], x[1], [1.0] * 24) for x in rows]
    assert Counter(map(tuple, em.near_duplicates(df, tile=tile).collect())) == brute(big, 0.98)
    if tile == 3:
        assert em.near_duplicates(df.limit(0)).count() == 0


def test_bound_never_loses_a_pair():
    r = np.random.default_rng(5)
    x = em.unit(r.normal(size=(80, 40)))
    x[40:] = em.unit(x[:40] + r.normal(size=(40, 40)) * 0.03)
    for t in (0.3, 0.9, 0.98):
        i, j = em.survivors(x, x, t)
        assert set(zip(i.tolist(), j.tolist())) >= set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= t))))
