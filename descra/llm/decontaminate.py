"""Operator 7: benchmark decontamination by suffix arrays of the training texts.

Documents are taken in shards of a few megabytes; a shard gets a suffix array
over its words, and every test suffix is looked up in it by binary search, which
gives all places where its first ``window`` words occur verbatim.  Occurrences on
one diagonal join to maximal matches (item, place in the item, place in the
document, words).  A document is contaminated when its hit words are at least
one in ``1 / share`` of its words.

The suffix array is sparse: a suffix that starts with two words that start no
test suffix matches no window and is left out, which changes no result.  Suffixes
are sorted three words at a time, and only ties are refined.  Words are compared
by 64-bit hash, and a hit needs a whole window of them.

Benchmark items reach the tasks in blocks of about ``block_bytes`` of text.
Where there are more, documents pass one block after the other and carry their
hits along in a written table, so the driver and a task hold one block at a time
and neither side must fit one machine.  Documents are never shuffled.

Defined results: null, empty and wordless texts have no words and no hits; an
item with fewer words than a window is one window; items without words match
nothing; a null item_id counts as an empty name; items that share an id count
once; repeated rows are each a document; empty tables give no hits or no rows;
columns of the input that clash with the report's are renamed only inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit, words
from descra.llm.tokens import as_strings, slices

WINDOW, SHARE, BLOCK_BYTES, SHARD_BYTES = 13, 20, 16 << 20, 4 << 20
#: Bits of a word's number, and words in a sort key.
BITS, PACK = np.uint64(21), 3
MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])
SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


class TestSuffixes:
    """A block of items: their words as numbers from 1, and the windows that start at each place."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offsets = words.raw(pa.array(texts, pa.large_string()))
        begin, end, at = words.cut(data, offsets, words.ALNUM)
        hashed = words.hashes(data, begin, end)
        self.vocabulary, numbers = np.unique(hashed, return_inverse=True)
        if len(self.vocabulary) >= 1 << int(BITS):
            raise ValueError("too many distinct words in a block of items: lower block_bytes")
        self.ids = ids
        n = np.diff(at)
        # Items one after the other, each closed by a 0.
        self.numbers = np.insert(numbers.astype(np.uint64) + np.uint64(1), at[1:], 0)
        start = at[:-1] + np.arange(len(n))
        many = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
        self.item = np.repeat(np.arange(len(n)), many)
        self.place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.length = np.minimum(n, window)[self.item]
        self.at = start[self.item] + self.place
        self.keys = packed(self.numbers)
        ahead = np.append(self.numbers[1:], np.uint64(0))
        self.pairs = np.unique((self.numbers << BITS | ahead)[self.at])
        self.single = bool((self.length == 1).any())


def packed(numbers: np.ndarray) -> np.ndarray:
    """For each place the numbers of it and the next two in one key; nothing counts after a 0."""
    a = numbers
    b = np.where(a > 0, np.append(numbers[1:], np.uint64(0)), 0)
    c = np.where(b > 0, np.append(numbers[2:], np.zeros(2, np.uint64))[: len(numbers)], 0)
    return (a << (BITS + BITS)) | (b << BITS) | c


def suffix_array(numbers: np.ndarray, keys: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of their suffixes, as far as the first ``depth`` words or a 0 tell them apart."""
    key = keys[starts]
    order = np.argsort(key, kind="stable")
    array, key = starts[order], key[order]
    same = np.append(key[1:] == key[:-1], False)
    tied = same | np.append(False, same[:-1])
    group = np.cumsum(~np.append(False, same[:-1]))
    going = np.flatnonzero(tied & (key & np.uint64((1 << 21) - 1) > 0))
    step = PACK
    while len(going) and step < depth:
        key = keys[array[going] + step]
        order = np.lexsort((key, group[going]))
        array[going] = array[going][order]
        key, of = key[order], group[going]
        same = np.append((key[1:] == key[:-1]) & (of[1:] == of[:-1]), False)
        tied = same | np.append(False, same[:-1])
        new = np.cumsum(~np.append(False, same[:-1]))
        group = group.copy()
        group[going] = new
        going = going[tied & (key & np.uint64((1 << 21) - 1) > 0)]
        step += PACK
    return array


def bisect(key_at, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each range the first place whose key is not below the wanted one."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        below = open_ & (key_at(np.minimum(middle, np.maximum(high - 1, 0))) < wanted)
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def find(tests: TestSuffixes, array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array in which each window occurs."""
    low, high = np.zeros(len(tests.at), np.int64), np.full(len(tests.at), len(array), np.int64)
    done = 0
    while True:
        some = np.flatnonzero((tests.length > done) & (low < high))
        if not len(some):
            return low, high
        part = np.minimum(tests.length[some] - done, PACK)
        key = tests.keys[tests.at[some] + done]
        # Fewer than three words left: all keys that start with those.
        shift = ((PACK - part).astype(np.uint64)) * BITS
        first = key >> shift << shift
        beyond = first + (np.uint64(1) << shift)
        key_at = lambda i: keys[array[i] + done]
        a = bisect(key_at, low[some], high[some], first)
        high[some] = bisect(key_at, a, high[some], beyond)
        low[some] = a
        done += PACK


def shard(tests: TestSuffixes, texts: pa.Array) -> tuple[np.ndarray, list]:
    """Words of each text, and (text, test window, first word in the text) of every occurrence."""
    data, offsets = words.raw(texts)
    begin, end, at = words.cut(data, offsets, words.ALNUM)
    n_words = np.diff(at)
    none = np.zeros(0, np.int64)
    if not len(begin) or not len(tests.at):
        return n_words, [none, none, none]
    hashed = words.hashes(data, begin, end)
    near = np.minimum(np.searchsorted(tests.vocabulary, hashed), len(tests.vocabulary) - 1)
    numbers = np.where(tests.vocabulary[near] == hashed, near + 1, 0).astype(np.uint64)
    numbers = np.append(np.insert(numbers, at[1:], 0), np.zeros(PACK + int(tests.length.max()), np.uint64))
    if tests.single:
        starts = np.flatnonzero(numbers)
    else:
        pair = numbers[:-1] << BITS | numbers[1:]
        starts = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        pair = pair[starts]
        k = np.minimum(np.searchsorted(tests.pairs, pair), len(tests.pairs) - 1)
        starts = starts[tests.pairs[k] == pair]
    if not len(starts):
        return n_words, [none, none, none]
    keys = packed(numbers)
    array = suffix_array(numbers, keys, starts, int(tests.length.max()))
    low, high = find(tests, array, keys)
    many = np.maximum(high - low, 0)
    test = np.repeat(np.arange(len(many)), many)
    where = array[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    first = at[:-1] + np.arange(len(n_words))
    doc = np.searchsorted(first, where, "right") - 1
    return n_words, [doc, test, where - first[doc]]


def matches(tests: TestSuffixes, doc: np.ndarray, test: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences joined along diagonals: document, item, place in the item, place in the document, words."""
    item, inside, length = tests.item[test], tests.place[test], tests.length[test]
    order = np.lexsort((place, place - inside, item, doc))
    doc, item, inside, place, length = (x[order] for x in (doc, item, inside, place, length))
    if not len(doc):
        return doc, item, inside, place, length
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - inside[1:] != place[:-1] - inside[:-1]) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc)) - 1
    return doc[start], item[start], inside[start], place[start], place[last] + length[last] - place[start]


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs with a last column ``report``: n_words, hits (disjoint word spans), matches, n_hit, items, contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    mine = [f"in_{i}" for i in range(len(docs.columns))]
    now = docs.toDF(*mine).withColumns({"n_words": F.lit(0), "hits": F.array().cast("array<struct<begin: int, end: int>>"), "matches": F.array().cast("array<struct<item_id: string, item_start: int, doc_start: int, n_words: int>>")})
    text = docs.columns.index("text")
    last = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = block.collect()  # about block_bytes
        now = now.transform(kit.arrow(_pass(TestSuffixes([r.item_id for r in rows], [r.text for r in rows], window), text), now.schema))
        if b < blocks - 1:
            # Written, so that this block is gone before the next one comes.
            with kit.recorded() as made:
                now = kit.written(now, "passed")
            if last:
                kit.drop(spark, last)
            last = made[0]
    n_hit = F.aggregate("hits", F.lit(0), lambda s, x: s + x.end - x.begin)
    found = F.struct(
        F.col("n_words").cast("long").alias("n_words"),
        "hits",
        "matches",
        n_hit.cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("items"),
        ((n_hit > 0) & (n_hit.cast("long") * share >= F.col("n_words"))).alias("contaminated"),
    )
    return now.select(*mine, found.alias("report")).toDF(*docs.columns, "report")


def _pass(tests: TestSuffixes, text: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in slices(as_strings(batch.column(text)), SHARD_BYTES):
                part = batch.slice(at, len(run))
                n_words, found = shard(tests, run)
                doc, item, inside, place, length = matches(tests, *found)
                old_hits, old_matches = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                hits, made = [[]] * len(run), [[]] * len(run)
                for d in np.unique(doc):
                    i, j = np.searchsorted(doc, [d, d + 1])
                    new = [{"item_id": tests.ids[a], "item_start": b, "doc_start": c, "n_words": n} for a, b, c, n in zip(item[i:j].tolist(), inside[i:j].tolist(), place[i:j].tolist(), length[i:j].tolist())]
                    made[d] = old_matches[int(d)].as_py() + new
                    spans = sorted([(x["doc_start"], x["doc_start"] + x["n_words"]) for x in new] + [(x["begin"], x["end"]) for x in old_hits[int(d)].as_py()])
                    joined: list[list[int]] = []
                    for a, b in spans:
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(b, joined[-1][1])
                        else:
                            joined.append([a, b])
                    hits[d] = [{"begin": a, "end": b} for a, b in joined]
                untouched = np.ones(len(run), bool)
                untouched[np.unique(doc)] = False
                for d in np.flatnonzero(untouched & (np.array(old_hits.value_lengths()) > 0)) if len(run) else ():
                    hits[d], made[d] = old_hits[int(d)].as_py(), old_matches[int(d)].as_py()
                columns = [*part.columns[:-3], pa.array(n_words.astype(np.int32)), pa.array(hits, pa.list_(SPAN)), pa.array(made, pa.list_(MATCH))]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without its contaminated rows."""
    return report(docs, benchmark, **options).where("not report.contaminated").drop("report") if "report" not in docs.columns else _clash(docs, benchmark, options)


def _clash(docs: DataFrame, benchmark: DataFrame, options: dict) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[n if n == "text" else f"c_{i}" for i, n in enumerate(names)])
    return decontaminate(plain, benchmark, **options).toDF(*names)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = report(docs, kit.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "report.n_words",
        "report.n_hit",
        F.size("report.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("report.items", ","), 256).alias("items_sha256"),
        "report.contaminated",
    )
