"""Operator 6: removal of repeated passages by content-defined line chunks.

A text is cut into lines; a long line is broken after words whose hash is less
than their neighbours', so that a passage inside a paragraph has lines of its
own.  A chunk ends where a rolling hash over two successive line hashes is less
than those before and after it: equal passages get equal chunks wherever they
stand, but for those at their edges, and chunks have two lines at least.  A
chunk belongs to the smallest doc_id that holds it.  In every other document a
chunk with the same hash is compared with the owner's byte by byte.  Since what
surrounds a passage moves its outermost bounds, a run of equal chunks goes on word
by word, white space included, as long as both texts do: before its first chunk
and after its last one, as far as ``EDGE_CHUNKS`` chunks of the owner, which is
further than such a bound can move.  Runs with at least ``least_words`` words by
then, and ``least_lines`` lines of chunks or else ``LONG_WORDS`` words (a line that
nothing breaks), are removed.  Inside one document the first copy of a chunk is the
one that stays, and later copies go on along the text around it.  A word is only
removed for an equal one in a smaller doc_id or further up, so one copy stays.

Hashes go through one pre-aggregated grouping (the owner is a minimum); only
bytes of shared chunks travel, one copy for each chunk and one for each document
that must compare, and those around a chunk only to documents with another
neighbour there than the owner (told by 31 bits of its hash).  A passage that a third of all documents hold is one row a
document.

Defined results: a null text stays null; documents that lose all they have keep
an empty text; a null doc_id owns nothing and loses only what it repeats itself;
rows with the same doc_id count as one document (of several texts around an owner's
chunk the least counts); an empty table gives no rows;
further columns stay, ``n_chars`` is counted anew where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit, words
from descra.llm.tokens import as_strings, slices

LEAST_LINES, LEAST_WORDS, LONG_WORDS, SLICE_BYTES = 2, 16, 50, 1 << 17
#: A bound is certain from the third whole line of a passage, and chunks have two lines: with the cut line, three chunks.
EDGE_CHUNKS = 3
#: Words with the white space that follows, and that leads.
FOLLOWED, LED = re.compile(rb"[^ \t-\r]+[ \t-\r]*"), re.compile(rb"[ \t-\r]*[^ \t-\r]+")


def lows(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where x is less than its neighbours in the same group (one beyond the group counts as more)."""
    low = np.ones(len(x), bool)
    low[1:] &= (of[1:] != of[:-1]) | (x[1:] < x[:-1])
    low[:-1] &= (of[1:] != of[:-1]) | (x[:-1] < x[1:])
    return low


class Chunks:
    """The chunks of many texts: text, hash, bytes [begin, end) with the white space that follows, [begin, stop) without, lines and words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        self.offsets = offsets - first
        begin, end, at = words.cut(self.data, self.offsets, words.UNSPACED)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        n = len(begin)
        if not n:
            self.doc = self.begin = self.end = self.stop = self.lines = self.words = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.int64)
            self.at = np.zeros(len(texts) + 1, np.int64)
            return
        feeds = np.concatenate([[0], np.cumsum(self.data == 10)])
        # A line begins with a text, after a line feed and after a selected word.
        total = words.sums(self.data)
        chosen = lows(words.hashes(self.data, begin, end, total), doc)
        new = np.ones(n, bool)
        new[1:] = (doc[1:] != doc[:-1]) | (feeds[begin[1:]] > feeds[end[:-1]]) | chosen[:-1]
        line = np.flatnonzero(new)
        line_last = np.append(line[1:], n) - 1
        hashed = words.hashes(self.data, begin[line], end[line_last], total)
        line_doc = doc[line]
        opens = np.ones(len(line), bool)
        opens[1:] = line_doc[1:] != line_doc[:-1]
        before = np.concatenate([[np.uint64(0)], hashed[:-1]])
        before[opens] = 0
        with np.errstate(over="ignore"):
            rolling = words.mix(before * np.uint64(0x9E3779B97F4A7C15) + hashed)
        closes = lows(rolling, line_doc)
        starts = opens.copy()
        starts[1:] |= closes[:-1]
        chunk = np.flatnonzero(starts)
        chunk_last = np.append(chunk[1:], len(line)) - 1
        self.doc = line_doc[chunk]
        self.lines = chunk_last - chunk + 1
        self.words = line_last[chunk_last] - line[chunk] + 1
        self.begin, self.stop = begin[line[chunk]], end[line_last[chunk_last]]
        self.hash = words.hashes(self.data, self.begin, self.stop, total).view(np.int64)
        self.at = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        # What follows a chunk up to the next belongs to it; what leads a text, to its first.
        self.end = np.append(self.begin[1:], 0)
        final = np.append(self.doc[1:] != self.doc[:-1], True)
        self.end[final] = self.offsets[1:][self.doc[final]]

    def bytes(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.stop[k]].tobytes()

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """31 bits of the hash of the chunk before and after each (0: none in this text)."""
        bits, inner = self.hash.astype(np.int32) | 1, self.doc[1:] == self.doc[:-1]
        last, next_ = np.zeros((2, len(bits)), np.int32)
        last[1:][inner], next_[:-1][inner] = bits[:-1][inner], bits[1:][inner]
        return last, next_

    def before(self, k: int) -> bytes:
        return self.data[self.begin[max(int(self.at[self.doc[k]]), k - EDGE_CHUNKS)] : self.begin[k]].tobytes()

    def after(self, k: int) -> bytes:
        return self.data[self.stop[k] : self.stop[min(int(self.at[self.doc[k] + 1]) - 1, k + EDGE_CHUNKS)]].tobytes()


def chunk_rows(docs: DataFrame) -> DataFrame:
    """hash, doc_id, last, next: the distinct chunks of each document, with the neighbours of the first copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(as_strings(batch.column(1)), SLICE_BYTES):
                c = Chunks(some)
                order = np.lexsort((c.hash, c.doc))
                h, d = c.hash[order], c.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                last, next_ = c.neighbours()
                ids = batch.column(0).slice(at, len(some)).take(pa.array(d[new]))
                yield pa.record_batch([pa.array(h[new]), ids, pa.array(last[order][new]), pa.array(next_[order][new])], names=["hash", "doc_id", "last", "next"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").transform(kit.arrow(run, "hash long, doc_id long, last int, next int"))


def agree(a: list[bytes], b: list[bytes]) -> list[bytes]:
    """What a and b begin with alike."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def kept(c: Chunks, i: int, shared: dict[int, tuple[bytes, bytes, bytes]], least_lines: int, least_words: int) -> list[tuple[int, int]]:
    """The spans of text i that stay, in bytes; ``shared`` gives the owner's bytes of a chunk, before and after it."""
    a, b = int(c.at[i]), int(c.at[i + 1])
    own: dict[int, int] = {}
    first, repeated = [], []
    for k in range(a, b):
        h = int(c.hash[k])
        again = own.setdefault(h, k)
        if again != k and c.bytes(again) != c.bytes(k):
            again = k
        first.append(again)
        repeated.append(again != k or h in shared and shared[h][0] == c.bytes(k))
    out, at, k = [], int(c.offsets[i]), a
    while k < b:
        if not repeated[k - a]:
            k += 1
            continue
        j = k
        while j < b and repeated[j - a]:
            j += 1
        until = j
        while until < b and not repeated[until - a]:
            until += 1
        start, stop = int(c.begin[k]), int(c.stop[j - 1])
        limit = int(c.begin[until]) if until < b else int(c.offsets[i + 1])
        before = c.before(first[k - a]) if first[k - a] != k else shared[int(c.hash[k])][1]
        after = c.after(first[j - 1 - a]) if first[j - 1 - a] != j - 1 else shared[int(c.hash[j - 1])][2]
        # One byte more than the owner's, so that a part of a word is not taken for a word.
        mine = c.data[max(at, start - len(before) - 1) : start].tobytes()
        back = agree(FOLLOWED.findall(mine)[::-1], FOLLOWED.findall(before)[::-1])
        mine = c.data[stop : min(limit, stop + len(after) + 1)].tobytes()
        on = agree(LED.findall(mine), LED.findall(after))
        n_words = c.words[k:j].sum() + len(back) + len(on)
        if n_words >= least_words and (c.lines[k:j].sum() >= least_lines or n_words >= LONG_WORDS):
            out.append((at, start - sum(map(len, back))))
            at = stop + sum(map(len, on))
            while at < c.offsets[i + 1] and not words.UNSPACED[c.data[at]]:
                at += 1
        k = j
    out.append((at, int(c.offsets[i + 1])))
    return [(x, y) for x, y in out if y > x]


def least(shared: Iterable[dict]) -> dict[int, tuple[bytes, bytes, bytes]]:
    """By hash: a chunk's bytes, and the least ones before and after it that were sent."""
    out: dict[int, tuple[bytes, bytes, bytes]] = {}
    for x in shared:
        found = x["bytes"], x["before"], x["after"]
        if x["hash"] in out:
            found = tuple(min((z for z in y if z is not None), default=None) for y in zip(out[x["hash"]], found))
        out[x["hash"]] = found
    return {h: (b, before or b"", after or b"") for h, (b, before, after) in out.items()}


def deduplicate(docs: DataFrame, *, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with a new ``text``, and ``n_chars`` where there is one."""
    spark = docs.sparkSession
    rows, path = chunk_rows(docs), kit.scratch(spark, "line-chunks")
    kit.write(rows, path)  # read twice
    rows = spark.read.schema(rows.schema).parquet(path)
    shared = rows.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select("hash", "owner")
    uses = kit.written(rows.join(shared, "hash"), "shared-chunks")
    kit.drop(spark, path)
    names = [f"in_{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    own = docs.toDF(*names).withColumn("key", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    edges = [(F.min(x) < F.max(x)).alias(x) for x in ("last", "next")]
    wanted = uses.groupBy("hash").agg(F.min("owner").alias("key"), *edges)
    mine = wanted.groupBy("key").agg(F.collect_list(F.struct("hash", "last", "next")).alias("wanted"))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(as_strings(batch.column(batch.schema.get_field_index(names[text]))), SLICE_BYTES):
                c, wanted = Chunks(some), batch.column(batch.num_columns - 1).slice(at, len(some)).to_pylist()
                last, next_ = c.neighbours()
                out: list[list] = [[], [], [], [], [], []]
                for i, these in enumerate(wanted):
                    left = {x["hash"]: x for x in these}
                    for k in range(int(c.at[i]), int(c.at[i + 1])):
                        if x := left.pop(h := int(c.hash[k]), None):
                            for column, value in zip(out, (h, c.bytes(k), last[k], next_[k], c.before(k) if x["last"] else None, c.after(k) if x["next"] else None)):
                                column.append(value)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types)], names=["hash", "bytes", "last", "next", "before", "after"])

    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    # Written, so that the texts of one pass at a time lie in shuffle files.
    given = kit.written(own.select("key", names[text]).join(mine, "key").transform(kit.arrow(give, "hash long, bytes binary, last int, next int, before binary, after binary")), "owned-chunks").alias("given")
    met = uses.where("doc_id <> owner").select("hash", "doc_id", "last", "next").alias("met").join(given, "hash")
    # A chunk with the owner's neighbour is inside its run there.
    around = [F.when(F.col(f"met.{x}") != F.col(f"given.{x}"), F.col(side)).alias(side) for x, side in (("last", "before"), ("next", "after"))]
    theirs = met.select(F.col("doc_id").alias("key"), F.struct("hash", "bytes", *around).alias("x")).groupBy("key").agg(F.collect_list("x").alias("shared"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])  # without the key
            for at, some in slices(as_strings(batch.column(text)), SLICE_BYTES):
                part = batch.slice(at, len(some))
                c, given_ = Chunks(some), part.column(part.num_columns - 1).to_pylist()
                many = np.diff(c.at)
                twice = np.zeros(len(some), bool)
                order = np.lexsort((c.hash, c.doc))
                h, d = c.hash[order], c.doc[order]
                twice[d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]] = True
                out: list = some.to_pylist()
                for i in range(len(some)):
                    if many[i] and (given_[i] or twice[i]):
                        spans = kept(c, i, least(given_[i] or ()), least_lines, least_words)
                        out[i] = b"".join(c.data[a:b].tobytes() for a, b in spans).decode()
                columns = part.columns[:-1]
                columns[text] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    found = own.join(theirs, "key", "left")
    done = found.transform(kit.arrow(rewrite, docs.toDF(*names).schema)).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done


def op6_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return deduplicate(docs)
