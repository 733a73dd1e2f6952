import random
import re
from collections import Counter

import pytest

from descra.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window):
    of = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            of.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    lengths = {len(x) for x in of}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in of:
                    hit.update(range(p, p + n))
                    found |= of[x]
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def case(seed, window):
    r = random.Random(seed)
    some = ["the", "of", "Été", "x1", "and", "über", "ñ", "to"]
    text = lambda n: "".join(r.choice(some) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, window - 1, window, window + 5, 3 * window]))) for i in range(12)] + [(3, text(window)), (None, text(window)), (50, None)]
    if seed % 2:
        items = [x for x in items if len(words(x[1])) >= 2]
    docs = [(None, None), (1, ""), (2, "... !!"), (7, "same"), (7, "same")]
    for d in range(60):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            t += (r.choice(items)[1] or "") + text(r.randint(0, 30))
        docs.append((d, t))
    docs.append((99, "long " * 30000 + (items[-2][1] or "")))
    return docs, items


@pytest.mark.parametrize("seed,window,block", [(1, 13, 1 << 20), (2, 4, 1 << 20), (3, 13, 200), (4, 5, 100)])
def test_against_brute_force(spark, seed, window, block):
    docs, items = case(seed, window)
    df = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, n_words int").repartition(2)
    got = dc.report(df, spark.createDataFrame(items, "item_id int, text string"), window=window, block_bytes=block)
    rows = got.collect()
    assert Counter((r.doc_id, r.report.n_words, r.report.n_hit, tuple(r.report["items"]), r.report.contaminated) for r in rows) == brute(docs, items, window)
    by = {}
    for i, t in items:
        by.setdefault("" if i is None else str(i), []).append(words(t))
    for r in rows:
        w = words(r.text)
        for m in r.report["matches"]:
            span = w[m.doc_start : m.doc_start + m.n_words]
            assert any(x[m.item_start : m.item_start + m.n_words] == span for x in by[m.item_id])


def test_removes_rows_and_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, passage, 1), (2, "clean text", 2), (3, None, 3)], "doc_id long, text string, report int")
    bench = spark.createDataFrame([(1, passage)], "item_id int, text string")
    got = dc.decontaminate(df, bench)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
    assert dc.decontaminate(df.limit(0), bench).count() == 0
    assert dc.decontaminate(df, bench.limit(0)).count() == 3


def test_one_block_at_a_time(spark, monkeypatch):
    # Many blocks: each pass holds its own items only, and the plan after a pass holds none of an earlier one.
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(r.choice(vocabulary) for _ in range(30))) for k in range(12)]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(40)) + " " + items[k % 12][1] * (k % 2)) for k in range(24)]
    docs_, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    whole = {(x.doc_id, x.report.n_hit, tuple(x.report["items"])) for x in dc.report(docs_, bench).collect()}
    held, real = [], dc.TestSuffixes
    monkeypatch.setattr(dc, "TestSuffixes", lambda ids, *a: held.append(len(ids)) or real(ids, *a))
    out = dc.report(docs_, bench, block_bytes=600)
    assert len(held) >= 4 and max(held) < 12 and sum(held) == 12
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(x.doc_id, x.report.n_hit, tuple(x.report["items"])) for x in out.collect()} == whole and sum(n > 0 for _, n, _ in whole) == 12
