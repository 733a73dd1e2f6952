"""Operator 1: tokens counted by section of a document.

A document is encoded once, whole.  Each token's span of bytes in the text is
joined by interval to the sections' spans (binary search of sorted bounds), and
a token that crosses a bound is allocated by the stated rule:

``start``     the section that holds its first byte (the default),
``end``       the section that holds its last byte,
``majority``  the section with most of its bytes, the earlier one in a tie,
``fraction``  every section, in proportion to the bytes (counts are then fractional).

Sections are the lines of a text, or, with ``spans``, a column of
array<struct<begin: int, end: int>> in characters, ascending and disjoint.
Bytes outside every section count for section -1.

Defined results: a null or empty text has one section 0 without tokens; null
spans mean no sections; repeated rows are each counted; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit
from descra.llm.tokens import SLICE_BYTES, PieceEncoder, as_strings, slices

RULES = ("start", "end", "majority", "fraction")


def allocate(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens [begin, end) to sections [low, high), ascending and disjoint: tokens of each section, and of none."""
    count = np.zeros(len(low))
    at = np.searchsorted(low, begin, "right") - 1
    last = np.searchsorted(low, np.maximum(end - 1, begin), "right") - 1
    width = np.maximum(end - begin, 1)

    def inside(i: np.ndarray, k) -> np.ndarray:
        return np.clip(np.minimum(end[i], high[k]) - np.maximum(begin[i], low[k]), 0, None)

    if rule in ("start", "end"):
        where, point = (at, begin) if rule == "start" else (last, np.maximum(end - 1, begin))
        ok = (where >= 0) & (point < high[np.maximum(where, 0)]) if len(low) else np.zeros(len(begin), bool)
        count += np.bincount(where[ok], minlength=len(low))
        return count, float((~ok).sum())
    whole = (at >= 0) & (at == last) & (end <= high[np.maximum(at, 0)]) if len(low) else np.zeros(len(begin), bool)
    count += np.bincount(at[whole], minlength=len(low))
    none = 0.0
    for i in np.flatnonzero(~whole):
        ks = np.arange(max(at[i], 0), last[i] + 1)
        part = inside(i, ks) if len(ks) else np.zeros(0)
        out = max(0, width[i] - part.sum())
        if rule == "fraction":
            count[ks] += part / width[i]
            none += out / width[i]
        elif len(ks) and part.max() >= out and part.max() > 0:
            count[ks[part.argmax()]] += 1
        else:
            none += 1
    return count, none


def count_tokens(docs: DataFrame, *, rule: str = "start", spans: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, section (from 0; -1: outside all), n_chars (code points), n_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or PieceEncoder(vocabulary)
            for at, run in slices(as_strings(batch.column(1)), SLICE_BYTES // 2):
                given = batch.column(2).slice(at, len(run)).to_pylist() if spans else None
                yield one_run(encoder, batch.column(0).slice(at, len(run)), pc.fill_null(run, ""), given)

    def one_run(encoder: PieceEncoder, keys: pa.Array, texts: pa.Array, given) -> pa.RecordBatch:
        begin, end, bounds = encoder.spans(texts)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        offsets = offsets - first
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        if given is None:
            # Every text's lines at once: a section begins with a text and after each line feed.
            feeds = np.flatnonzero(raw == 10)
            low = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
            doc = np.concatenate([np.arange(len(texts)), np.searchsorted(offsets, feeds, "right") - 1])
            doc.sort(kind="stable")
            high = np.concatenate([low[1:], [last - first]])
            here = np.flatnonzero(np.concatenate([doc[1:] == doc[:-1], [False]]))
            high[here] -= 1
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            if rule == "start":
                # Tokens begin in a line: a line feed is never the first byte of one.  Empty texts share their place, so search from the right.
                where = np.searchsorted(low, begin, "right") - 1
                n = np.bincount(where, minlength=len(low)).astype(float)
            else:
                n, stray = allocate(begin, end, low, high, rule)
                assert not stray and len(owner) == len(begin)
            section = np.arange(len(doc)) - np.searchsorted(doc, doc)
        else:
            doc_, section_, low_, high_, n_ = [], [], [], [], []
            for i, spans_i in enumerate(given):
                a, b = int(offsets[i]), int(offsets[i + 1])
                own = chars[a : b + 1] - chars[a]
                low_i = a + np.searchsorted(own, [s["begin"] for s in spans_i or ()], "left")
                high_i = a + np.searchsorted(own, [s["end"] for s in spans_i or ()], "left")
                n_i, none = allocate(begin[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]], low_i, high_i, rule)
                stray = int(none > 0)
                doc_ += [i] * (len(n_i) + stray)
                section_ += [*range(len(n_i)), *[-1] * stray]
                low_ += [*low_i, *[a] * stray]
                high_ += [*high_i, *[a] * stray]
                n_ += [*n_i, *[none] * stray]
            doc, section, low, high, n = (np.array(x) for x in (doc_, section_, low_, high_, n_))
            doc, section, low, high = (x.astype(np.int64) for x in (doc, section, low, high))
        return pa.record_batch([keys.take(pa.array(doc)), pa.array(section.astype(np.int32)), pa.array((chars[high] - chars[low]).astype(np.int64)), pa.array(n.astype(float) if rule == "fraction" else n.astype(np.int64))], names=["doc_id", "section", "n_chars", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(spans)] if spans else []))
    return docs.transform(kit.arrow(count, f"doc_id long, section int, n_chars long, n_tokens {'double' if rule == 'fraction' else 'long'}"))


def op1_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(kit.read(spark, sf_dir, "documents"))
