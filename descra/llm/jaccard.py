"""Operator 10: n-gram Jaccard join by a token-group matrix.

Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word
shingles.  One pass over the texts gives each document its set's size and a
64-bit digest; documents of equal sets are one class, so copies cost nothing
further.  The join is exact on 64-bit shingle hashes:

1. Meeting.  Linked sets differ in at most D = (a+b)(100-p)/(100+p) shingles.
   Hash ranges cut sets of a band of sizes into k > D parts, so linked sets agree
   in k - D whole parts at least.  Parts are ordered by how many shingles they
   hold, the most first, since the more a part holds the rarer it is, and a set
   gives the first D + 1 of them only, of which linked sets share one.  Sets that
   give the same part meet in a bucket.
2. Groups.  A class's core is its shingles of the lowest hashes, a share of the
   hash range that is three times the difference that a link allows; two classes
   that link differ little in their cores.  A class is held against the least
   class of each of its buckets, by a looser bound than a link's; where a bucket still holds several groups, its
   classes are split into blocks, each class is a query against the token union
   of every block, and only blocks whose union holds enough of it are looked
   into.  The connected classes are a group of similar documents: links stay
   inside a group.
3. Links.  A group is split into blocks of about ``block`` classes.  A block's
   whole sets are compared with one another.  Where a group has several blocks,
   one query for each component of a block is held against the first block, and
   what is then not in the group's largest component against all blocks: first
   core against the block's union of cores, its row of the matrix, which bounds
   every overlap inside; whole sets only for the blocks that this leaves open.
4. Components of all links, over written tables.

Each step gives links that span what it found (at most one a class and
component), never all pairs.  Cores and ids are shuffled, texts only for blocks
that are compared.  Every exchange is keyed by a part's hash, by a class, or by a
bounded block whose queries are streamed; buckets are streamed in sorted order,
never gathered.  What remains quadratic: n classes of one bucket or group that
neither link nor differ in their cores ask n * n / (2 * block) blocks.

Defined results: null, empty and wordless texts have the empty set and link with
nothing; fewer than n words are one shingle; rows that share a doc_id are one
node with the links of all of them; a null doc_id has a null component; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit, words
from descra.llm.tokens import as_strings, slices

SLICE_BYTES, BLOCK, BLOCK_SHINGLES, QUERIES, PREFIXES, COPIES = 1 << 20, 512, 1 << 18, 1024, 1 << 20, 1000
_U = np.uint64


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-word shingles, ascending, and where each text's begin."""
    data, offsets = words.raw(texts)
    begin, end, at = words.cut(data, offsets, words.UNSPACED)
    hashed = words.hashes(data, begin, end)
    many = np.diff(at)
    with np.errstate(over="ignore"):
        joined = np.zeros(len(hashed), _U)
        for k in range(n):
            # Words missing at a text's end count as one more, constant, word.
            part = np.zeros(len(hashed), _U)
            part[: max(len(hashed) - k, 0)] = hashed[k:]
            if k:
                left = np.repeat(at[1:], many) - np.arange(len(hashed))
                part[left <= k] = _U(0x5851F42D4C957F2D)
            joined = words.mix(joined * _U(0x9E3779B97F4A7C15) + part + _U(k + 1))
    keep = np.maximum(many - n + 1, np.minimum(many, 1))
    doc = np.repeat(np.arange(len(many)), keep)
    joined = joined[np.repeat(at[:-1] - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())]
    order = np.argsort(joined)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(many) < 1 << 16 else np.int64), kind="stable")]
    doc, joined = doc[order], joined[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (joined[1:] != joined[:-1])
    doc, joined = doc[new], joined[new]
    return joined, np.searchsorted(doc, np.arange(len(many) + 1))


def digests(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, as a signed long."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum(flat, dtype=_U)])
        return words.mix(total[at[1:]] - total[at[:-1]] + words.mix(np.diff(at).astype(_U))).view(np.int64)


class Bands:
    """Size bands and the number of parts in each."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        rest, both = 100 - percent, 100 + percent
        # Sets whose sizes sum to less than both / rest differ in nothing if they link.
        edges = [max(1, both // (2 * rest))] if rest else [most]
        while edges[-1] < most:
            edges.append(edges[-1] * 2 + 1)
        self.edges = np.array(edges)
        self.top = self.edges[1:] - 1
        differ = 2 * self.top * rest // both
        # A quarter more than have to be, so that parts of a single shingle need not be given.
        self.parts = differ + 2 + differ // 4

    def most_differ(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """In how many shingles a set of this size may differ from one of the band that it links with."""
        partner = np.minimum(self.top[band], size * 100 // self.percent)
        return (size + partner) * (100 - self.percent) // (100 + self.percent)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, "right") - 1

    def enter_next(self, size: np.ndarray) -> np.ndarray:
        """Whether a set may link with one of the next band: its partner has at most 100 / percent times its size."""
        band = self.of(size)
        return (size > 0) & (band + 1 < len(self.parts)) & (size * 100 >= self.edges[np.minimum(band + 1, len(self.edges) - 1)] * self.percent)


def signatures(flat: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature): of every set's parts the first that a link must share, those with the most shingles first."""
    size = np.diff(at)
    band = bands.of(size)
    own, up = np.flatnonzero(band >= 0), np.flatnonzero(bands.enter_next(size))
    sets, band = np.concatenate([own, up]), np.concatenate([band[own], band[up] + 1])
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many, parts = size[sets], bands.parts[band]
    entry = np.repeat(np.arange(len(sets)), many)
    value = flat[np.repeat(at[:-1][sets] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    with np.errstate(over="ignore"):
        part = ((value >> _U(32)) * parts[entry].astype(_U) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (part[1:] != part[:-1])]))
        holds = np.diff(np.append(first, len(value)))
        total = np.concatenate([[_U(0)], np.cumsum(value, dtype=_U)])
        total = total[np.append(first[1:], len(value))] - total[first]
        entry, part = entry[first], part[first]
        sign = words.mix(total + words.mix((band[entry] << 32 | part).astype(_U)))
    give = bands.most_differ(many, band) + 1
    order = np.lexsort((sign, -holds, entry))
    filled = np.bincount(entry, minlength=len(sets))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
    chosen = order[rank < give[entry[order]]]
    out_set, out = [sets[entry[chosen]]], [sign[chosen]]
    # Empty parts come last; a set gives some only where its filled ones are too few.
    for e in np.flatnonzero(filled < give):
        gone = np.setdiff1d(np.arange(parts[e]), part[np.searchsorted(entry, e) : np.searchsorted(entry, e + 1)])
        with np.errstate(over="ignore"):
            empty = np.sort(words.mix(words.mix((band[e] << 32 | gone).astype(_U))))[: give[e] - filled[e]]
        out_set.append(np.full(len(empty), sets[e]))
        out.append(empty)
    return np.concatenate(out_set), np.concatenate(out).view(np.int64)


def scan(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(as_strings(batch.column(1)), SLICE_BYTES):
                flat, begin = shingles(some, n)
                yield pa.record_batch([batch.column(0).slice(at, len(some)), pa.array(np.diff(begin).astype(np.int64)), pa.array(digests(flat, begin))], names=["doc_id", "n_shingles", "set_id"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.transform(kit.arrow(run, "doc_id long, n_shingles long, set_id long"))


def signature_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """signature, set_id: those of each set, which a task gives once for copies that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for _, some in slices(as_strings(batch.column(0)), SLICE_BYTES):
                flat, begin = shingles(some, n)
                ids = digests(flat, begin)
                fresh = []
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                many = np.diff(begin)[fresh]
                own = flat[np.repeat(begin[:-1][fresh] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                who, sign = signatures(own, np.concatenate([[0], np.cumsum(many)]).astype(np.int64), bands)
                yield pa.record_batch([pa.array(sign), pa.array(ids[fresh][who])], names=["signature", "set_id"])

    return docs.select("text").transform(kit.arrow(run, "signature long, set_id long"))


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (signature, set_id), sorted: bucket, set_id and the least set of each bucket with several sets.

    Near-duplicates share most of their signatures, so most buckets have the same sets as others.  A bucket that lies
    in one batch is named by a digest of its sets, and goes out once; one that spans batches is named by its signature.
    """
    last, least, held = None, None, False  # the run that is open: its signature, first set, and whether that set's row is still to come
    before, seen = None, set()
    for batch in batches:
        sign, sets = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(sign):
            continue
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (sets[1:] != sets[:-1])
        new[0] = before != (sign[0], sets[0])
        before = (sign[-1], sets[-1])
        sign, sets = sign[new], sets[new]
        if not len(sign):
            continue
        if held:
            sign, sets = np.insert(sign, 0, last), np.insert(sets, 0, least)
            held = False
        first = np.ones(len(sign), bool)
        first[1:] = sign[1:] != sign[:-1]
        run, start = np.cumsum(first) - 1, np.flatnonzero(first)
        head = sets[first]
        goes_on = last is not None and sign[0] == last
        if goes_on:
            head[0] = least
        many = np.bincount(run)
        ok = many > 1
        if goes_on and sets[0] != least:
            ok[0] = True
        last, least = sign[-1], head[-1]
        held = not ok[-1]
        if ok.any():
            with np.errstate(over="ignore"):
                total = np.add.reduceat(words.mix(sets.view(_U)), start)
                name = words.mix(total + words.mix(many.astype(_U))).view(np.int64)
                whole = np.ones(len(many), bool)
                whole[-1] = False
                whole[0] &= not goes_on
                name = np.where(whole, name, words.mix(sign[first].view(_U)).view(np.int64))
            for k in np.flatnonzero(ok & whole):
                if (x := int(name[k])) in seen:
                    ok[k] = False
                else:
                    seen.add(x)
            if len(seen) > 500_000:
                seen.clear()
            keep = ok[run]
            yield pa.record_batch([pa.array(name[run][keep]), pa.array(sets[keep]), pa.array(head[run][keep])], names=["bucket", "set_id", "least"])


def stream_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first n_keys columns, a batch for each key; keys are longs."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if held and key != held_key:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def linked(share: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return (100 + percent) * share >= percent * (n + sizes)


def link_block(flat: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Component of each set (its first member) under the links among these sets."""
    n, sizes = len(at) - 1, np.diff(at)
    tokens, number = np.unique(flat, return_inverse=True)
    root = np.arange(n)
    mark = np.zeros(len(tokens), np.int32)
    begin = np.minimum(at[:-1], max(len(flat) - 1, 0))
    for i in range(n):
        if (root == root[0]).all():
            break
        own = number[at[i] : at[i + 1]]
        mark[own] = 1
        share = np.where(sizes > 0, np.add.reduceat(mark[number], begin), 0) if len(flat) else np.zeros(n, np.int64)
        mark[own] = 0
        near = root[linked(share, sizes[i], sizes, percent) & (sizes > 0)]
        if len(near):
            low = near.min()
            root[np.isin(root, near)] = low
    return root


def core(flat: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's shingles in the lowest part of the hash range, as 32 bits of each, ascending."""
    share = min(1.0, 3 * (100 - percent) / (100 + percent))
    low = flat >> _U(40) < _U(int(share * (1 << 24)))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[low]
    token = flat[low].astype(np.uint32)
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
    owner, token = owner[new], token[new]
    return token, np.searchsorted(owner, np.arange(len(at))).astype(np.int64)


def cores(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, set_id, n_shingles, core (little-endian unsigned 32-bit) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(as_strings(batch.column(1)), SLICE_BYTES):
                flat, begin = shingles(some, n)
                token, first = core(flat, begin, percent)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(first * 4), pa.py_buffer(token.astype("<u4"))])
                yield pa.record_batch([batch.column(0).slice(at, len(some)), pa.array(digests(flat, begin)), pa.array(np.diff(begin).astype(np.int64)), data.cast(pa.binary())], names=["doc_id", "set_id", "n_shingles", "core"])

    return docs.select("doc_id", "text").transform(kit.arrow(run, "doc_id long, set_id long, n_shingles long, core binary"))


class Block:
    """Sets that queries are held against: their tokens (all, or those of their cores), sizes and components."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, percent: int):
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner = flat[order], owner[order]
        self.many, self.sizes, self.percent = np.diff(at), sizes, percent

    def near(self, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member): those that may link, and with whole sets do; a query that the block's union does not hold is not looked at."""
        p, m = self.percent, len(self.many)
        j = 0
        while j < len(sizes):
            # As many queries as share ``most`` tokens with members at the most, one at least.
            i, j = j, max(j + 1, int(np.searchsorted(at, at[j] + most // max(m, 1), "right")) - 1)
            own, many = flat[at[i] : at[j]], np.diff(at[i : j + 1])
            left = np.searchsorted(self.tokens, own, "left")
            found = np.searchsorted(self.tokens, own, "right") - left
            query = np.repeat(np.arange(j - i), many)
            missing = many - np.bincount(query, found > 0, j - i).astype(np.int64)
            # Of a query that links with a member, the union lacks at most the share that a link allows.
            open_ = 100 * missing <= (100 - p) * sizes[i:j]
            found = np.where(open_[query], found, 0)
            owner = self.owner[np.repeat(left - (np.cumsum(found) - found), found) + np.arange(found.sum())]
            common = np.bincount(np.repeat(query, found) * m + owner, minlength=(j - i) * m).reshape(j - i, m)
            apart = many[:, None] + self.many[None] - 2 * common
            linked = open_[:, None] & ((100 + p) * apart <= (100 - p) * (sizes[i:j, None] + self.sizes[None])) & (sizes[i:j, None] > 0) & (self.sizes[None] > 0)
            q, member = np.nonzero(linked)
            yield q + i, member


def unpack(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sets stored as binary: their tokens, and where each set's begin."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[int(offsets[0]) : int(offsets[-1])] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


KEYS = ("of", "block", "part")
ASKED = "of long, block long, part long, a long, b long"


def ask(percent: int, sets: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], own: bool) -> Callable:
    """Rows (of, block, part, is_query, set_id, component, ...) sorted so: near pairs (a, b) of a query and a member, one for each other component.

    ``sets`` gives a batch's tokens, where each set's begin, sizes and which rows to take.  Only a block's members are
    held; its queries are streamed.  ``own``: members are queries too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, block = None, None

        def close() -> Block:
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in held]))]).astype(np.int64)
            whole = np.concatenate([x[0] for x in held]), at, np.concatenate([x[2] for x in held])
            made = Block(*whole, percent)
            made.ids, made.components = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            made.whole = whole
            return made

        def pairs(block: Block, flat, at, sizes, ids, components) -> Iterator[pa.RecordBatch]:
            for q, member in block.near(flat, at, sizes):
                new = components[q] != block.components[member]
                q, member = q[new], member[new]
                _, first = np.unique(q * len(block.ids) + np.unique(block.components, return_inverse=True)[1][member], return_index=True)
                if len(first):
                    n = len(first)
                    yield pa.record_batch([*(pa.array(np.full(n, k)) for k in key), pa.array(ids[q[first]]), pa.array(block.ids[member[first]])], names=[*KEYS, "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                now, query = tuple(heads[:3, i].tolist()), bool(heads[3, i])
                if now != key:
                    if own and held:
                        block = close()
                        yield from pairs(block, *block.whole, block.ids, block.components)
                    key, block, held = now, None, []
                some = batch.slice(i, j - i)
                flat, at, sizes, take = sets(some)
                ids, components = some.column(4).to_numpy()[take], some.column(5).to_numpy()[take]
                if not query:
                    held.append((flat, at, sizes, ids, components))
                elif held:
                    if block is None:
                        block = close()
                    yield from pairs(block, flat, at, sizes, ids, components)
        if own and held:
            block = close()
            yield from pairs(block, *block.whole, block.ids, block.components)

    return run


def from_cores(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return *unpack(batch.column(7), "<u4"), batch.column(6).to_numpy(), np.arange(batch.num_rows)


def from_texts(n: int) -> Callable:
    """Whole sets of texts, of the rows whose text has the set that is asked for (rows may share a doc_id)."""

    def sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat, at = shingles(as_strings(batch.column(6)), n)
        right = digests(flat, at) == batch.column(4).to_numpy()
        many = np.diff(at)
        return flat[np.repeat(right, many)], np.concatenate([[0], np.cumsum(many[right])]).astype(np.int64), many[right], np.flatnonzero(right)

    return sets


def inner_links(n: int, percent: int) -> Callable:
    """Rows (of, block, set_id, text) by block: a row (of, block, set_id, root) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, 2):
            flat, at = shingles(as_strings(group.column(3)), n)
            right = np.flatnonzero(digests(flat, at) == group.column(2).to_numpy())
            many = np.diff(at)
            kept = np.zeros(len(many), bool)
            kept[right] = True
            root = link_block(flat[np.repeat(kept, many)], np.concatenate([[0], np.cumsum(many[right])]).astype(np.int64), percent)
            ids = group.column(2).to_numpy()[right]
            yield pa.record_batch([group.column(0).take(pa.array(right)), group.column(1).take(pa.array(right)), pa.array(ids), pa.array(ids[root])], names=["of", "block", "set_id", "root"])

    return run


def by_block(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def meet(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """bucket, set_id, least: the classes that meet."""
    found = by_block_sorted(signature_rows(docs, n, percent)).transform(kit.arrow(buckets, "bucket long, set_id long, least long"))
    return found.groupBy("bucket", "set_id").agg(F.min("least").alias("least"))


def group_sets(met: DataFrame, core: DataFrame, *, percent: int, block: int) -> DataFrame:
    """set_id, of: the classes that are near another one by their cores, and the least class of their group."""
    # Looser than a link, so that a family of near copies is one group and its buckets need no second look.
    percent = max(1, 100 - 3 * (100 - percent))
    a, b = (core.select(F.col("set_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("core").alias(f"core_{x}")) for x in "ab")
    stars = met.where("set_id <> least").select(F.col("set_id").alias("a"), F.col("least").alias("b")).distinct()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, x_at), (y, y_at) = unpack(batch.column(4), "<u4"), unpack(batch.column(5), "<u4")
                row = lambda at: np.repeat(np.arange(batch.num_rows, dtype=np.uint64) << _U(32), np.diff(at))
                both = row(x_at) | x.astype(_U), row(y_at) | y.astype(_U)
                common = np.bincount((np.intersect1d(*both) >> _U(32)).astype(np.int64), minlength=batch.num_rows)
                apart = np.diff(x_at) + np.diff(y_at) - 2 * common
                sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                yield batch.select([0, 1]).filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))

    near = stars.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "core_a", "core_b").transform(kit.arrow(close, "a long, b long"))
    near = kit.written(near, "near")
    known = kit.components(near).select(F.col("node").alias("set_id"), F.col("component").alias("of"))
    # Buckets that hold several groups: blocks of their classes, each class a query against the blocks.
    here = met.select("bucket", "set_id").join(known, "set_id", "left").withColumn("of", F.coalesce("of", "set_id"))
    here = kit.written(here, "here")
    apart = here.groupBy("bucket").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.ceil(F.count("*") / F.lit(block)).alias("blocks")).where("lo < hi").select("bucket", "blocks")
    mixed = here.join(apart, "bucket").withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks"))
    asked = mixed.withColumn("block", F.explode(F.sequence("own", F.col("blocks") - 1)))
    rows = asked.join(core, "set_id").select(F.col("bucket").alias("of"), "block", F.lit(0).cast("long").alias("part"), (F.col("block") != F.col("own")).alias("is_query"), "set_id", F.col("of").alias("component"), "n_shingles", "core")
    more = kit.written(blocked(rows).transform(kit.arrow(ask(percent, from_cores, own=True), ASKED)).select("a", "b"), "near")
    if more.isEmpty():
        return known
    return kit.components(near.unionByName(more)).select(F.col("node").alias("set_id"), F.col("component").alias("of"))


def blocked(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "is_query")


def link_sets(docs: DataFrame, ids: DataFrame, *, n: int, percent: int, block: int, queries: int) -> DataFrame:
    """Links (a, b) that span every component of the classes. ids: set_id, doc_id of one document of each class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = kit.written(meet(docs, n, percent), "buckets")
    wanted = kit.written(met.select("set_id").distinct().join(ids, "set_id"), "wanted")
    core = kit.written(cores(filtered(docs, wanted), n, percent).join(wanted, ["set_id", "doc_id"]).dropDuplicates(["set_id", "doc_id"]), "cores")
    groups = group_sets(met, core, percent=percent, block=block)
    sized = kit.written(core.join(groups, "set_id"), "groups")
    load = sized.groupBy("of").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    place = kit.written(sized.join(load, "of").select("of", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"), "set_id", "doc_id", "n_shingles", "core", "blocks"), "blocks")
    texts = filtered(docs, place)
    whole = by_block(texts.join(place.select("of", "block", "set_id", "doc_id").hint("merge"), "doc_id").select("of", "block", "set_id", "text"), "of", "block")
    inside = kit.written(whole.transform(kit.arrow(inner_links(n, percent), "of long, block long, set_id long, root long")), "roots")
    links = [inside.where("root <> set_id").select(F.col("set_id").alias("a"), F.col("root").alias("b"))]
    # Groups of several blocks; the others are done.
    large = place.where("blocks > 1").drop("blocks")
    if large.isEmpty():
        return links[0]

    def components() -> DataFrame:
        known = kit.components(links[0] if len(links) == 1 else links[0].unionByName(links[1])).select(F.col("node").alias("set_id"), "component")
        return kit.written(large.join(known, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "places")

    def held(asked: DataFrame, place: DataFrame) -> DataFrame:
        """Links of queries: asked has of, block, set_id."""
        asked = kit.written(asked, "asked")
        parts = asked.groupBy("of", "block").agg(F.ceil(F.count("*") / F.lit(queries)).alias("parts"))
        part = F.pmod(F.xxhash64("set_id"), "parts").alias("part")
        asking = asked.join(parts, ["of", "block"]).select("of", "block", part, F.lit(True).alias("is_query"), "set_id")
        members = lambda parts: parts.join(place.select("of", "block", "set_id"), ["of", "block"]).select("of", "block", "part", F.lit(False).alias("is_query"), "set_id")
        rows = asking.unionByName(members(parts.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))))
        bounded = blocked(rows.join(place.drop("of", "block"), "set_id").select(*KEYS, "is_query", "set_id", "component", "n_shingles", "core"))
        opened = kit.written(bounded.transform(kit.arrow(ask(percent, from_cores, own=False), ASKED)).select(*KEYS, F.col("a").alias("set_id")).distinct(), "opened")
        rows = opened.withColumn("is_query", F.lit(True)).unionByName(members(opened.select(*KEYS).distinct())).join(place.select("set_id", "doc_id", "component"), "set_id")
        rows = blocked(rows.join(filtered(docs, rows), "doc_id").select(*KEYS, "is_query", "set_id", "component", "text"))
        return kit.written(rows.transform(kit.arrow(ask(percent, from_texts(n), own=False), ASKED)).select("a", "b"), "links")

    # One query for each component of a block against the group's first block: most of what is one component joins here.
    known = components()
    first = known.groupBy("of").agg(F.min("block").alias("low"))
    some = known.groupBy("of", "block", "component").agg(F.min("set_id").alias("set_id")).join(first, "of").where("block <> low")
    links.append(held(some.select("of", F.col("low").alias("block"), "set_id"), known))
    # What is in another than the group's largest component asks all its blocks.
    known = components()
    size = known.groupBy("of", "component").agg(F.count("*").alias("size"))
    most = size.groupBy("of").agg(F.max(F.struct("size", "component")).alias("most")).select("of", F.col("most.component").alias("largest"))
    apart = known.join(most, "of").where("component <> largest").select("of", F.col("block").alias("own"), "set_id")
    blocks = known.select("of", "block").distinct()
    links.append(held(apart.join(blocks, "of").where("block <> own").select("of", "block", "set_id"), known))
    return kit.written(links[0].unionByName(links[1]).unionByName(links[2]), "links")


def filtered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most of the rows whose doc_id is not wanted, before they are shuffled.

    A semi join with residues of hashed ids, of which there are at most PREFIXES: that table is broadcast whatever the
    input's size.  Beyond it fewer rows are left out; the join that follows is exact.
    """
    n = wanted.count()
    size = min(PREFIXES, 1 << max(10, (8 * n).bit_length()))
    prefix = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    some = wanted.where("doc_id is not null").select(prefix("doc_id").alias("prefix")).distinct()
    return docs.withColumn("prefix", prefix("doc_id")).join(F.broadcast(some), "prefix", "left_semi").drop("prefix")


def by_block_sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("signature").sortWithinPartitions("signature", "set_id")


def near_duplicates(docs: DataFrame, *, n: int = 3, percent: int = 90, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row of docs (doc_id, text)."""
    seen = kit.written(scan(docs, n), "sets")
    classes = kit.written(seen.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    ids = classes.select("set_id", "doc_id")
    links = link_sets(docs, ids.where("doc_id is not null"), n=n, percent=percent, block=block, queries=queries)
    # Nodes are the least doc_id of each class, and any other doc_id whose rows are in several classes.
    low = ids.where("doc_id is not null")
    named = lambda c: low.select(F.col("set_id").alias(c), F.col("doc_id").alias(f"doc_{c}"))
    linked = links.join(named("a"), "a").join(named("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    several = seen.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
    shared = seen.where("n_shingles > 0").join(several, "doc_id").select("set_id", F.col("doc_id").alias("a")).join(low, "set_id").select("a", F.col("doc_id").alias("b")).where("a <> b")
    found = kit.components(linked.unionByName(shared))
    # Most classes have no link: they must not meet under a null component.
    lower = low.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id").select("set_id", F.col("component").alias("low"))
    lows = ids.join(lower, "set_id", "left").select("set_id", F.coalesce("low", "doc_id").alias("component_id"))
    # The copies of one class, which may be a third of all rows, are dealt to several tasks.
    most = max(COPIES, seen.count() // 50_000)
    many = classes.select("set_id", F.ceil(F.col("copies") / F.lit(most)).alias("salts"))
    hubs = many.where("salts > 1")  # at most rows / most
    lows = lows.join(many, "set_id").select("set_id", "component_id", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    return (
        seen.select("doc_id", "n_shingles", "set_id")
        .join(F.broadcast(hubs), "set_id", "left")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))))
        .join(lows, ["set_id", "salt"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
    )


def deduplicate(docs: DataFrame, *, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates: the rows of the smallest doc_id; rows without doc_id stay."""
    kept = near_duplicates(docs, n=n, percent=percent, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_anti").select(*docs.columns)


def op10_token_group_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(kit.read(spark, sf_dir, "documents"))
