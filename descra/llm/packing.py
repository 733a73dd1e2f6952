"""Operator 4: documents packed into sequences of at most ``capacity`` tokens.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so
the plan is made on the histogram of lengths, whatever the number of documents:

1. ``pieces`` encodes every text once and writes a table; each row also holds its
   task and its rank among the task's rows of that length.
2. ``plan`` takes the histogram (at most ``capacity`` rows on the driver).
   Martello and Toth's dominance reduction fixes every pair or single that
   provably dominates all other sets with its longer item: an exact complement;
   the largest partner where no two items fit beside it; an item alone where
   nothing fits.  Best-fit decreasing packs the rest, whole groups of equal
   sequences at a time.
3. ``place`` turns ranks into (sequence_id, offset): prefix sums of the counts per
   (task, length), then a lookup in the plan's runs for that length.  The sums
   are broadcast up to ``SENT`` of them; beyond, the pieces of one task, which
   are no more than one split of the input, are joined with its sums.

Defined results: null and empty texts are the end id alone (length 1); rows with
equal or null doc_id are each a document; an empty table packs into nothing;
further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descra.llm import kit
from descra.llm.tokens import PieceEncoder, as_strings, slices

CAPACITY, END = 2048, 0
#: Entries of (task, length) that a broadcast may hold; beyond them pieces are joined by task.
SENT = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, rank long"

Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), task, rank; a written table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = None, np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            encoder = encoder or PieceEncoder(vocabulary)
            for at, run in slices(as_strings(batch.column(1))):
                ids, bounds = encoder.encode(run)
                many = np.diff(bounds) + 1
                flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
                count = -(-many // capacity)
                doc = np.repeat(np.arange(len(many)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(many[doc] - start, capacity)
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
                key = batch.column(0).slice(at, len(run)).take(pa.array(doc))
                yield pa.record_batch(
                    [key, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids", "task", "rank"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kit.written(docs.transform(kit.arrow(cut, PIECES)), "pieces")


def reduce(count: Counter[int], capacity: int) -> list[Pattern]:
    """Fixes dominating sets and takes them out of count (length -> items)."""
    fixed: list[Pattern] = []
    sizes = sorted(count)

    def take(pattern: tuple[int, ...], copies: int) -> None:
        fixed.append((pattern, copies))
        for x in pattern:
            count[x] -= copies
        for x in set(pattern):
            if not count[x]:
                del count[x]
                sizes.pop(bisect_left(sizes, x))

    changed = True
    while changed:
        changed = False
        for j in list(reversed(sizes)):
            while count.get(j):
                room = capacity - j
                at = bisect_right(sizes, room) - 1
                if at >= 0 and sizes[at] == j and count[j] == 1:
                    at -= 1  # an item does not fit beside itself
                if at < 0:
                    take((j,), count[j] if 2 * j > capacity else 1)
                    changed = True
                    continue
                k = sizes[at]
                if k < room:  # not an exact complement: then no two others may fit beside j
                    others = [x for x in sizes[:3] for _ in range(min(2, count[x] - (x == j)))][:2]
                    if len(others) == 2 and sum(others) <= room:
                        break
                take((j, k), count[j] // 2 if j == k else min(count[j], count[k]))
                changed = True
    return fixed


def best_fit(count: Counter[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equal sequences: each length goes to the tightest room that holds it."""
    groups: dict[int, list[Pattern]] = defaultdict(list)  # room left -> sequences
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], copies: int) -> None:
        if copies:
            if room not in groups or not groups[room]:
                insort(rooms, room)
            groups[room].append((pattern, copies))

    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put(capacity - each * size, (size,) * each, left // each)
                put(capacity - left % each * size, (size,) * (left % each), int(left % each > 0))
                break
            room = rooms.pop(at)
            some, groups[room] = groups[room], []
            each = room // size
            for i, (pattern, copies) in enumerate(some):
                full = min(copies, left // each)
                put(room - each * size, pattern + (size,) * each, full)
                left -= full * each
                if full < copies:
                    put(room - left * size, pattern + (size,) * left, 1)
                    put(room, pattern, copies - full - 1)
                    left = 0
                    for x in some[i + 1 :]:
                        put(room, *x)
                    break
    return [x for g in groups.values() for x in g]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """(lengths in a sequence, how many sequences) for a histogram of lengths."""
    rest = Counter({k: v for k, v in count.items() if v})
    return reduce(rest, capacity) + best_fit(rest, capacity)


def plan_runs(patterns: list[Pattern]) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """For each length: (first rank, first rank beyond, first sequence, items a sequence, first offset) of each run, in order of rank."""
    runs, used, sequence = defaultdict(list), Counter(), 0
    for pattern, copies in patterns:
        offset = 0
        for size, each in Counter(pattern).items():
            runs[size].append((used[size], used[size] + each * copies, sequence, each, offset))
            used[size] += each * copies
            offset += each * size
        sequence += copies
    return sorted(runs.items())


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (length, task, rank, and what else) with sequence_id and offset; cut must be a written table, whose ranks are final."""
    spark = cut.sparkSession
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = kit.written(counts, "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = spark.createDataFrame(plan_runs(plan(histogram, capacity)), "length long, runs array<struct<lo: long, hi: long, first: long, each: long, at: long>>")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", F.col("length").cast("int").alias("length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each task, of at most capacity lengths: twelve bytes each.  More than SENT of them are not broadcast.
    bases = base.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("length", "base"))).alias("b")).select("task", F.col("b.length").alias("lengths"), F.col("b.base").alias("bases"))
    bases = F.broadcast(bases) if counts.count() <= SENT else bases.hint("merge")
    own = F.get("bases", (F.array_position("lengths", F.col("length").cast("int")) - 1).cast("int"))
    placed = cut.join(bases, "task").withColumn("nth", F.col("rank") + own)
    # runs has a row for each length, at most capacity of them.
    placed = placed.join(F.broadcast(runs), "length").withColumn("run", F.expr("element_at(filter(runs, r -> r.lo <= nth AND nth < r.hi), 1)"))
    return placed.withColumns({"sequence_id": F.expr("run.first + (nth - run.lo) div run.each"), "offset": F.expr("run.at + (nth - run.lo) % run.each * length")}).drop("runs", "run", "nth", "lengths", "bases", "task", "rank")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(kit.read(spark, sf_dir, "documents"))
    return place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "rank"))
