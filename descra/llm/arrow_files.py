"""Operator 3: token ids as Arrow files of fixed-size lists.

``write`` puts the ids of all documents, in ascending doc_id order, into one
stream that is cut into sequences of equal length.  Each task owns a range of
doc_id and writes one Arrow IPC file whose record batches hold
``ids: fixed_size_list<uint16|uint32>[L]`` and ``mask: fixed_size_list<bool>[L]``
(a bit a token, an Arrow view but no numpy one; false marks padding, which only a
file's last sequence has),
beside an index file ``doc_id, offset, n_tokens``.  A memory-mapped or fetched file gives any sequence,
mask or document as a view: batch ``i // rows``, row ``i % rows``, no copy.

Files are written under an attempt's own name and moved to their final one, so a
retried or speculative task leaves one whole file.  The manifest (one row a
file) is a written table.

Defined results: null and empty texts are the end id alone; null doc_id sorts
first; rows with equal doc_id are each a document, ordered by a hash of the text and the
text; an empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit
from descra.llm.tokens import PieceEncoder, as_strings, slices

SEQUENCE, ROWS, END = 2048, 256, 2
MANIFEST = "file string, first long, n_documents long, n_tokens long, n_sequences long, start long"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class SequenceWriter:
    """Cuts a stream of ids into fixed-size lists and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.n_tokens, self.n_sequences = [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        full = self.length * self.rows
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - full + 1, full):
                self._batch(flat[i : i + full], full)
            flat = flat[len(flat) // full * full :]
            self.held, self.n_held = [flat], len(flat)

    def _batch(self, flat: np.ndarray, n: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:n] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(flat) // self.length

    def close(self) -> None:
        if self.n_held:
            flat = np.zeros(-(-self.n_held // self.length) * self.length, self.dtype)
            flat[: self.n_held] = np.concatenate(self.held)
            self._batch(flat, self.n_held)
        self.out.close()


def write(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = END, length: int = SEQUENCE, rows: int = ROWS) -> DataFrame:
    """Writes the ids of docs (doc_id, text) below path and returns the manifest: file, first (doc_id), n_documents, n_tokens, n_sequences, start."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, index, place = None, None, None, 0
        fs, where = file_system(path)
        part, attempt, first = TaskContext.get().partitionId(), uuid.uuid4().hex, None
        name = f"{where}/part-{part:06d}"
        for batch in batches:
            texts = as_strings(batch.column(1))
            for at, run in slices(texts):
                if out is None:
                    encoder = PieceEncoder(vocabulary)
                    fs.create_dir(where, recursive=True)
                    sinks = [fs.open_output_stream(f"{name}.{attempt}{x}") for x in ("", ".index")]
                    out = SequenceWriter(sinks[0], encoder.dtype, length, rows)
                    index = pa.ipc.new_file(sinks[1], pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))
                    first = batch.column(0)[at].as_py()
                ids, bounds = encoder.encode(run)
                many = np.diff(bounds) + 1
                with_ends = np.insert(ids, bounds[1:], end_id)
                starts = place + np.cumsum(many) - many
                place += int(many.sum())
                out.add(with_ends)
                index.write_batch(pa.record_batch([batch.column(0).slice(at, len(run)).cast(pa.int64()), pa.array(starts), pa.array(many)], schema=index_schema))
        if out is not None:
            out.close()
            index.close()
            for s in sinks:
                s.close()
            fs.move(f"{name}.{attempt}.index", f"{name}.index.arrow")
            fs.move(f"{name}.{attempt}", f"{name}.arrow")
            n_documents = count_rows(fs, f"{name}.index.arrow")
            yield pa.RecordBatch.from_pylist([{"file": f"part-{part:06d}", "first": first, "n_documents": n_documents, "n_tokens": out.n_tokens, "n_sequences": out.n_sequences}], schema=manifest_schema)

    index_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
    manifest_schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.repartitionByRange(kit.partitions(docs), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = kit.written(dealt.transform(kit.arrow(put, MANIFEST.rpartition(",")[0])), "manifest")
    # One row a file: as many as there are tasks, whatever the number of documents.
    spark, rows_, start = docs.sparkSession, [], 0
    for r in sorted(files.collect(), key=lambda r: r.file):
        rows_.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows_, MANIFEST)


def count_rows(fs, name: str) -> int:
    with fs.open_input_file(name) as f:
        r = pa.ipc.open_file(f)
        return sum(r.get_batch(i).num_rows for i in range(r.num_record_batches))


def open_file(fs, name: str) -> pa.ipc.RecordBatchFileReader:
    """A reader over the file: mapped into memory where the file system is local, else fetched range by range."""
    if fs.type_name == "local":
        return pa.ipc.open_file(pa.memory_map(name))
    return pa.ipc.open_file(fs.open_input_file(name))


def sequence(reader, i: int, column: str = "ids", rows: int = ROWS) -> pa.Array:
    """Sequence i of an open file (or its mask), as a view on the file's bytes; ``to_numpy()`` of ids is one too."""
    lists = reader.get_batch(i // rows).column(column)
    n = lists.type.list_size
    return lists.values.slice((lists.offset + i % rows) * n, n)


def documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit), from mask and index."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = file_system(path)
        for files in batches:
            for file, start in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                ids, index = (open_file(fs, f"{where}/{file}{x}.arrow") for x in ("", ".index"))
                stream = token_stream(ids)
                held, base = next(stream, np.zeros(0, np.uint32)), 0
                for b in range(index.num_record_batches):
                    docs = index.get_batch(b)
                    offset, many = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    for i, j in runs(many, 1 << 21):
                        end = int(offset[j - 1] + many[j - 1])
                        parts = [held[int(offset[i]) - base :]]
                        base += len(held) - len(parts[0])
                        have = base + len(parts[0])
                        while have < end:
                            parts.append(next(stream))
                            have += len(parts[-1])
                        held = np.concatenate(parts) if len(parts) > 1 else parts[0]
                        flat = held[: end - base].astype("<u4")
                        ends = np.concatenate([[0], np.cumsum(many[i:j])]) * 4
                        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
                        yield pa.record_batch([docs.column(0).slice(i, j - i), pa.array(offset[i:j] + start), docs.column(2).slice(i, j - i), data.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = manifest.select("file", "start")
    n = max(1, manifest.count())
    return files.repartition(n, "file").transform(kit.arrow(get, "doc_id long, start long, n_tokens long, ids binary"))


def token_stream(reader) -> Iterator[np.ndarray]:
    """The ids under the mask, batch by batch."""
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()
        yield ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]


def runs(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` ids each."""
    run = (np.cumsum(many) - many) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(many)]
    yield from zip(cuts, cuts[1:])


def op3_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = kit.scratch(spark, "arrow-tokens")
    manifest = write(kit.read(spark, sf_dir, "documents"), path)
    return documents(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
