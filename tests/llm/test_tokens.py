import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from descra.llm import arrow_files, kit, packing, token_counts
from descra.llm.tokens import PieceEncoder, slices

ODD = ["", None, "a<|endoftext|>b it's IT'S", "  x y 12 «a» É́ H̱ ", "don't'll \x1c a", "ŉs ÿÀ×÷ a1b2,c", "İstanbul ſ", "日本語 テキスト", "naïve—dash l'été", "\n\n", "a" * 5000]


def texts(n=60, seed=1):
    r = random.Random(seed)
    parts = ["the", "Ether", "ñandú", "l'été", "it's", "42", "!!!", "x1", "über,", "%%%", "\n", "\t", " "]
    return [" ".join(r.choice(parts) + r.choice(["", "", ",", "ing"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, "extra") for i, t in enumerate([*ODD, *texts(), "word " * 6000])] + [(None, "no id", "x"), (5, "again", "x"), (5, "again", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_pieces_equal_whole_texts():
    e = PieceEncoder(cache_pieces=20)
    for _ in range(2):
        t = pa.array([*ODD, *texts()], pa.large_string())
        for at, run in slices(t, 500):
            ids, bounds = e.encode(run)
            for k, x in enumerate(run.to_pylist()):
                assert list(ids[bounds[k] : bounds[k + 1]]) == e.tokenizer.encode(x or "", add_special_tokens=False).ids


def test_spans_equal_the_librarys_offsets():
    e = PieceEncoder()
    t = pa.array(["the Ether's x1, 42 it's\n über", "plain words here", "日本 x", ""], pa.large_string())
    begin, end, bounds = e.spans(t)
    base = 0
    for k, x in enumerate(t.to_pylist()):
        got = [(x.encode()[b - base : e_ - base]) for b, e_ in zip(begin[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]])]
        want = [x[a:b].encode() for a, b in e.tokenizer.encode(x, add_special_tokens=False).offsets]
        if x.isascii():
            assert got == want
        assert len(got) == len(want)
        base += len(x.encode())


def test_files_round_trip(spark, docs):
    rows, df = docs
    path = kit.scratch(spark, "t")
    manifest = arrow_files.write(df, path, length=64, rows=4)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids) for r in arrow_files.documents(spark, path, manifest).collect())
    tok = PieceEncoder().tokenizer
    start = 0
    for (s, d, n, ids), (wd, wt) in zip(got, sorted(((d, t) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        want = tok.encode(wt or "", add_special_tokens=False).ids + [2]
        assert (s, d, n) == (start, wd, len(want)) and list(np.frombuffer(ids, "<u4")) == want
        start += n
    # Random access: sequence i of a file is a view of the stream, the mask tells padding.
    fs, where = arrow_files.file_system(path)
    m = manifest.orderBy("file").first()
    r = arrow_files.open_file(fs, f"{where}/{m.file}.arrow")
    stream = np.concatenate(list(arrow_files.token_stream(r)))
    assert len(stream) == m.n_tokens
    i = min(5, m.n_tokens // 64 - 1)
    assert list(arrow_files.sequence(r, i, rows=4).to_numpy()) == list(stream[i * 64 : i * 64 + 64])
    assert arrow_files.sequence(r, m.n_sequences - 1, "mask", rows=4).true_count == (m.n_tokens - 1) % 64 + 1


def test_files_of_an_empty_table(spark):
    path = kit.scratch(spark, "t")
    manifest = arrow_files.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert manifest.count() == 0 and arrow_files.documents(spark, path, manifest).count() == 0


def bins(patterns):
    return sum(c for _, c in patterns)


@pytest.mark.parametrize("seed", range(30))
def test_plan_packs_all_and_best(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 16, 100])
    count = Counter(r.randint(1, capacity) for _ in range(r.randint(0, 12)))
    patterns = packing.plan(count, capacity)
    assert sum((Counter({k: v * c for k, v in Counter(p).items()}) for p, c in patterns), Counter()) == count
    assert all(sum(p) <= capacity for p, _ in patterns)

    items = sorted(count.elements(), reverse=True)
    best = [len(items)]

    def search(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {x: j for j, x in enumerate(rooms) if x >= items[i]}.values():
            search(i + 1, [x - items[i] * (j == k) for j, x in enumerate(rooms)])
        search(i + 1, [*rooms, capacity - items[i]])

    search(0, [])
    assert best[0] <= bins(patterns) <= best[0] + 1
    # What the reduction fixes never costs a sequence.
    rest = Counter(count)
    fixed = packing.reduce(rest, capacity)
    kept, items = best[0], sorted(rest.elements(), reverse=True)
    best[0] = len(items)
    search(0, [])
    assert bins(fixed) + best[0] == kept


@pytest.mark.parametrize("sent", [packing.SENT, 0])
def test_packing_is_gapless_and_whole(spark, docs, monkeypatch, sent):
    monkeypatch.setattr(packing, "SENT", sent)
    rows, df = docs
    cut = packing.pieces(df, capacity=128)
    got = packing.place(cut, 128).collect()
    tok = PieceEncoder().tokenizer
    want = Counter()
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((d, i // 128, i, zlib.crc32(np.array(ids[i : i + 128], "<u4").tobytes()), len(ids[i : i + 128])) for i in range(0, len(ids), 128))
    assert Counter((r.doc_id, r.piece, r.start, zlib.crc32(r.ids), r.length) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 128
    assert len(by) <= -(-sum(r.length for r in got) // 128) * 1.1 + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.place(packing.pieces(empty)).count() == 0


def test_section_counts(spark, docs):
    rows, df = docs
    got = {}
    for r in token_counts.count_tokens(df.where("doc_id is not null and doc_id <> 5")).collect():
        got[r.doc_id, r.section] = (r.n_chars, r.n_tokens)
    tok = PieceEncoder().tokenizer
    want = {}
    for d, t, _ in rows:
        if d not in (None, 5):
            for k, line in enumerate((t or "").split("\n")):
                want[d, k] = (len(line), len(tok.encode(line, add_special_tokens=False).ids))
    assert got == want


def test_rules_for_crossing_tokens(spark):
    df = spark.createDataFrame([(1, "abc thethe xyz", [(0, 5), (5, 14)])], "doc_id long, text string, spans array<struct<begin: int, end: int>>")
    tok = PieceEncoder().tokenizer
    offsets = tok.encode("abc thethe xyz", add_special_tokens=False).offsets
    for rule in token_counts.RULES:
        got = {r.section: r.n_tokens for r in token_counts.count_tokens(df, rule=rule, spans="spans").collect()}
        want = defaultdict(float)
        for a, b in offsets:
            if rule == "start":
                want[0 if a < 5 else 1] += 1
            elif rule == "end":
                want[0 if b <= 5 else 1] += 1
            else:
                left = max(0, min(b, 5) - a) / (b - a)
                if rule == "fraction":
                    want[0] += left
                    want[1] += 1 - left
                else:
                    want[0 if left >= 0.5 else 1] += 1
        assert got == pytest.approx({k: want[k] for k in (0, 1)})
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, spans array<struct<begin: int, end: int>>")
    assert [(r.section, r.n_tokens) for r in token_counts.count_tokens(none, spans="spans").collect()] == [(-1, 1)]
