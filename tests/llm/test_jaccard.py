import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from descra.llm import jaccard, kit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(t, n):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, n, percent):
    s = [(d, sets(t, n)) for d, t in rows]
    root = {d: d for d, _ in s if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(s):
        for e, b in s[:i]:
            if a and b and d is not None and e is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return Counter((d, len(a), None if d is None else find(d)) for d, a in s)


def corpus(seed, n_base=25):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)] + ["The", "of"]
    passage = [r.choice(vocabulary) for _ in range(12)]
    rows, d = [(None, "null id text here"), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "ONE"), (8, "two words"), (9, "two\twords")], 10
    for _ in range(n_base):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 11, 12, 13, 20, 40, 100, 300]))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, len(w) // 40])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randint(0, 3))]
            rows.append((d, " ".join(w)))
            d += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,percent,block,queries", [(1, 3, 90, 128, 512), (2, 3, 90, 2, 2), (3, 5, 80, 3, 4), (4, 2, 60, 2, 3)])
def test_components_against_brute_force(spark, seed, n, percent, block, queries):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component_id int").repartition(3)
    got = jaccard.near_duplicates(df, n=n, percent=percent, block=block, queries=queries)
    assert Counter(map(tuple, got.collect())) == brute(rows, n, percent)


def test_chain_over_many_blocks(spark):
    # Each links only with the next few: one component that no single group shows.
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, jaccard.near_duplicates(df, block=4, queries=3).collect())) == brute(rows, 3, 90)


def test_repeated_ids_ties_and_empty(spark):
    rows = [(1, "a b c d"), (1, "x y z q"), (2, "x y z q"), (3, "a b c d"), (4, "k"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in jaccard.deduplicate(df).collect()) == [1, 1, 4, 4]


@pytest.mark.parametrize("few,neighbours", [(1 << 18, 1000), (0, 1000), (0, 7)])
def test_components(spark, few, neighbours):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 530)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + edges[:9] + [(None, 3)], "a long, b long")
    got = kit.components(df, few=few, neighbours=neighbours).collect()
    assert len(got) == len(set(got)) and dict(map(tuple, got)) == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert kit.components(df.limit(0), few=few).count() == 0


def test_neighbours_of_a_hub_are_dealt_out(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 1001)] + [(5000, 5001)], "u long, v long")
    got = kit.with_least(edges, 100, F.min("v"))
    assert {(x.u, x.v, x.m) for x in got.collect()} == {(0, i, 1) for i in range(1, 1001)} | {(5000, 5001, 5001)}
    salted = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "salt" in x]
    assert salted


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_buckets_over_batches(size):
    r = random.Random(size)
    rows = sorted({(r.randrange(12), r.randrange(9)) for _ in range(60)} | {(20, x) for x in range(40)} | {(21, 5)})
    rows += [rows[-1]]  # a copy from another task
    batches = [pa.record_batch([pa.array([a for a, _ in rows[i : i + size]], pa.int64()), pa.array([b for _, b in rows[i : i + size]], pa.int64())], names=["signature", "set_id"]) for i in range(0, len(rows), size)]
    got = {}
    for b in jaccard.buckets(iter(batches)):
        for name, s, least in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(name, (set(), set()))
            got[name][0].add(s)
            got[name][1].add(least)
    want = {}
    for a, b in rows:
        want.setdefault(a, set()).add(b)
    assert {frozenset(s) for s, _ in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}
    assert all(least == {min(s)} for s, least in got.values())


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    r, bands = np.random.default_rng(percent), jaccard.Bands(percent)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 400))).astype(np.uint64))
        gone = r.integers(0, max(1, len(a) * (100 - percent) // 100) + 1)
        b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 1 << 63, int(r.integers(0, gone + 1))).astype(np.uint64)]))
        share = len(np.intersect1d(a, b))
        if not len(b) or 100 * share < percent * (len(a) + len(b) - share):
            continue
        who, sign = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
        assert (a.tolist() == b.tolist()) or set(sign[who == 0].tolist()) & set(sign[who == 1].tolist())


def test_tables_of_one_short_text(spark):
    for k in range(1, 5):
        text = " ".join("abcd"[:k])
        flat, at = jaccard.shingles(pa.array([text], pa.large_string()), 5)
        assert len(flat) == 1 and at.tolist() == [0, 1]
        # Apart from other texts and among them a text has the same shingle.
        among, at = jaccard.shingles(pa.array([text, "one two three four five six"], pa.large_string()), 5)
        assert among[: at[1]].tolist() == flat.tolist()
    df = spark.createDataFrame([(1, "ab cd"), (2, "ab cd")], "doc_id long, text string").repartition(2, "doc_id")
    assert [r.doc_id for r in jaccard.deduplicate(df).collect()] == [1]
