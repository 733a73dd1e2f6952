"""Operator 8: conversations rendered by a template that is treated as a black box.

A template is a function from turns [(role, text)] to one string.  Successive
prefixes of a conversation are rendered and compared: while a rendering goes on
from the one before, the new part is the new turn's span; what it takes away
from the end of the one before (a closing) belongs to no turn, and where it
changes an earlier turn's span the template rewrites history, which is reported
with the first turn that changes.  Inside a span the text's place is found by
rendering the turn with two texts that share neither their first nor last
character; the loss mask covers the texts of the assistant.

``marked`` is the default template.  It writes ``### Role: text </turn>`` a line
and puts a backslash before backslashes and control strings in roles and texts,
so that ``parse`` gets every role and text back.

Conversations are dealt by conv_id and streamed in order of turn; one is held at
a time, because a rendering is one string.

Defined results: null role or text is empty; equal turns are ordered by role,
then text; a null turn comes first; null conv_id is a conversation of its own;
repeated rows are repeated turns; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit

Turn = tuple[str, str]
CONTROL = re.compile(r"\\|###|</turn>")
SPANS = "array<struct<begin: int, end: int, text_begin: int, text_end: int, loss: boolean>>"
FORMATTED = f"conv_id long, formatted string, spans {SPANS}, rewrites int"
_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("text_begin", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())]))


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked(turns: list[Turn]) -> str:
    return "".join(f"### {_name(role)}: {escape(text)} </turn>\n" for role, text in turns)


def _name(role: str) -> str:
    """A plain lower-case role with a capital; any other as it is, after an equals sign."""
    return role.capitalize() if re.fullmatch("[a-z]+", role) else "=" + escape(role).replace(":", "\\:")


def parse(formatted: str) -> list[Turn]:
    """What ``marked`` was given."""
    turns, at = [], 0
    part = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?! </turn>\n)[^\\])*) </turn>\n", re.S)
    while at < len(formatted):
        m = part.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        name = m[1]
        turns.append((unescape(name[1:]) if name.startswith("=") else name.lower(), unescape(m[2])))
        at = m.end()
    return turns


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) >> 1
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_suffix(a: str, b: str, most: int) -> int:
    n = 0
    while n < most and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


def locate(turns: list[Turn], render: Callable[[list[Turn]], str], loss: Callable[[str], bool]) -> tuple[str, list[dict], int | None]:
    """The rendering, each turn's span and text span in it, and the first turn whose rendering changed later (None: history stays)."""
    before, spans, rewritten = render([]), [], None
    for k in range(len(turns)):
        now = render(turns[: k + 1])
        begin = shared_prefix(before, now)
        changed = [i for i, s in enumerate(spans) if s["end"] > begin and s["text_end"] > begin]
        if changed and rewritten is None:
            rewritten = changed[0]
        # A closing that the new turn took away was counted to the turn before it.
        if spans and not changed:
            spans[-1]["end"] = min(spans[-1]["end"], begin)
        role = turns[k][0]
        one, two = (render([*turns[:k], (role, probe)]) for probe in ("A", "B"))
        text_begin = shared_prefix(one, two)
        text_end = max(text_begin, len(now) - shared_suffix(one, two, len(one) - text_begin - 1 if one != two else 0))
        spans.append({"begin": begin, "end": len(now), "text_begin": text_begin, "text_end": text_end, "loss": loss(role)})
        before = now
    return before, spans, rewritten


def format_conversations(turns: DataFrame, *, render: Callable[[list[Turn]], str] = marked, loss: Callable[[str], bool] = lambda role: role == "assistant") -> DataFrame:
    """conv_id, formatted, spans (code points), rewrites (the first turn that a later one changed, else null)."""

    def flush(rows: list) -> pa.RecordBatch:
        made = [(c, *locate(t, render, loss)) for c, t in rows]
        return pa.record_batch([pa.array([r[0] for r in made], pa.int64()), pa.array([r[1] for r in made], pa.string()), pa.array([r[2] for r in made], _SPAN), pa.array([r[3] for r in made], pa.int32())], names=["conv_id", "formatted", "spans", "rewrites"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, held, size = [], None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and conv != now:
                    done.append((now, held))
                    held = []
                    if len(done) >= 500 or size > 1 << 22:
                        yield flush(done)
                        done, size = [], 0
                now = conv
                held.append((role or "", text or ""))
                size += len(text or "")
        if held:
            done.append((now, held))
        if done:
            yield flush(done)

    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    # The number of partitions follows the input and is fixed: conversations stay whole.
    ordered = ordered.repartition(kit.partitions(ordered), "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.select("conv_id", "role", "text").transform(kit.arrow(run, FORMATTED))


def digests(formatted: DataFrame) -> DataFrame:
    """What the output of ``marked`` holds, parsed and unescaped: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                under = "".join(unescape(text[s["text_begin"] : s["text_end"]]) for s in spans if s["loss"])
                out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(under), "loss_sha256": hashlib.sha256(under.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.select("conv_id", "formatted", "spans").transform(kit.arrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def op8_incremental_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = kit.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(kit.written(format_conversations(turns.unionByName(own)), "chat"))
