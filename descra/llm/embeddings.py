"""Operator 2: embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared within a label (and a length) by cosine in double precision.

1. The second moments of all unit vectors give an orthogonal basis, leading
   directions first (sums per task, added up in a bounded number of steps; the
   driver sees length x length numbers).
2. Vectors are ordered within their label by a Z-order code of the leading
   coordinates, and cut into tiles of at most ``tile`` rows with the box of each
   leading coordinate.  A label of any size is many tiles.
3. Two tiles are compared only if their boxes come within the distance that the
   threshold allows; pairs of tiles are found by an equality join on cells of the
   first coordinate.
4. A comparison adds up leading coordinates first.  By Cauchy and Schwarz the
   rest of a product is at most the product of the suffix norms, so rows and
   columns without any product that could still reach the threshold are left out
   of the next step; what remains is decided on the vectors as they are given.

A pair of tiles returns a row for each linked vector (its number of links and the
smallest vector of its local component), never pairs of vectors.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows whose label or vec_id is null, link with nothing; rows that
share a vec_id are one node, whose n_links counts the links of all of them; a
null vec_id has a null component and kept null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit
from descra.llm.jaccard import stream_groups

THRESHOLD, TILE, BOX, PARTNERS = 0.98, 512, 12, 16
#: Leading coordinates at which a comparison stops to bound the rest.
STEPS = (8, 16, 32)
SLACK = 1e-9


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal-length vectors as rows of doubles, and which are fit to compare: no null or non-finite component, not zero."""
    n = len(column)
    column = column.cast(pa.large_list(pa.float64()))
    flat = column.flatten()
    bad = np.isnan(values := flat.to_numpy(zero_copy_only=False)) | ~np.isfinite(values)
    rows = values.reshape(n, -1) if n else np.zeros((0, 0))
    ok = ~bad.reshape(rows.shape).any(1) if n else np.zeros(0, bool)
    top = np.abs(np.where(ok[:, None], rows, 0)).max(1, initial=0) if rows.size else np.zeros(n)
    return rows, ok & (top > 0)


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(1, keepdims=True)
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def sized(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), size, embedding of the rows that may link."""
    return vectors.where("vec_id is not null and label is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("size"), "embedding")


def by_size(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(column).to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors an orthogonal basis (columns), by descending second moment over all of them."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, part in by_size(batch, 0):
                rows, ok = matrix(part.column(1))
                u = unit(rows[ok])
                total[size] = total.get(size, 0) + u.T @ u
        yield from packed(total)

    def packed(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if total:
            part = TaskContext.get().partitionId() % 16
            yield pa.record_batch([pa.array([part] * len(total), pa.int64()), pa.array(list(total), pa.int64()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["part", "size", "moments"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total[size] = total.get(size, 0) + np.frombuffer(m).reshape(size, size)
        yield from packed(total)

    schema = "part long, size long, moments binary"
    sums = vectors.select("size", "embedding").transform(kit.arrow(moments, schema)).repartition(16, "part").transform(kit.arrow(add, schema))
    total: dict[int, np.ndarray] = {}
    for r in sums.collect():  # at most 16 matrices of a length
        total[r.size] = total.get(r.size, 0) + np.frombuffer(r.moments).reshape(r.size, r.size)
    return {size: np.linalg.eigh(m)[1][:, ::-1].copy() for size, m in total.items()}


def tiles(vectors: DataFrame, basis: dict[int, np.ndarray], *, tile: int = TILE, box: int = BOX) -> DataFrame:
    """tile, label, size, low and high (boxes of the leading coordinates), ids and rows (binary): a written table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in by_size(batch, 2):
                rows, ok = matrix(part.column(3))
                if not ok.any():
                    continue
                part, rows = part.filter(pa.array(ok)), rows[ok]
                lead = unit(rows) @ basis[size][:, : min(6, size)]
                cell = np.clip((lead + 1) * 512, 0, 1023).astype(np.int64)
                z = np.zeros(len(cell), np.int64)
                for bit in range(9, -1, -1):
                    for k in range(cell.shape[1]):
                        z = z << 1 | cell[:, k] >> bit & 1
                yield pa.record_batch([part.column(0), part.column(1), part.column(2).cast(pa.int64()), pa.array(z), pa.array([x.tobytes() for x in rows], pa.binary())], names=["vec_id", "label", "size", "code", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        key = None

        def flush() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(x[1] for x in held)).reshape(len(held), -1)
            lead = unit(rows) @ basis[key[1]][:, : min(box, key[1])]
            return pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([lead.min(0).tolist()], pa.list_(pa.float64())), pa.array([lead.max(0).tolist()], pa.list_(pa.float64())), pa.array([np.array([x[0] for x in held], np.int64).tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())],
                names=["tile", "label", "size", "low", "high", "ids", "rows"],
            )

        for batch in batches:
            for vec, label, size, row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (key != (label, size) or len(held) >= tile):
                    yield flush()
                    number, held = number + 1, []
                key = (label, size)
                held.append((vec, row))
        if held:
            yield flush()

    coded = kit.written(vectors.transform(kit.arrow(code, "vec_id long, label string, size long, code long, row binary")), "coded")
    order = ["label", "size", "code", "vec_id"]
    ordered = coded.repartitionByRange(kit.partitions(coded), *order).sortWithinPartitions(*order)
    return kit.written(ordered.select("vec_id", "label", "size", "row").transform(kit.arrow(cut, "tile long, label string, size long, low array<double>, high array<double>, ids binary, rows binary")), "tiles")


def tile_pairs(cut: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: tiles of one label whose boxes may hold a pair that links."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    width = max(reach, 0.02)
    box = cut.select("tile", "label", "size", "low", "high", F.floor(F.col("low")[0] / width).alias("first"), F.floor((F.col("high")[0] + reach) / width).alias("last"))
    one = box.select(*(F.col(c).alias(f"a_{c}") for c in box.columns)).withColumn("cell", F.explode(F.sequence("a_first", "a_last")))
    two = box.select(*(F.col(c).alias(f"b_{c}") for c in box.columns)).withColumn("cell", F.explode(F.sequence("b_first", "b_last")))
    near = one.join(two, (F.col("a_label") == F.col("b_label")) & (F.col("a_size") == F.col("b_size")) & (one.cell == two.cell)).where((F.col("a_tile") <= F.col("b_tile")) & (one.cell == F.greatest("a_first", "b_first")))
    gap = F.expr("aggregate(sequence(0, size(a_low) - 1), 0D, (s, i) -> s + pow(greatest(0D, a_low[i] - b_high[i], b_low[i] - a_high[i]), 2))")
    return near.where(gap <= reach * reach).select(F.col("a_tile").alias("a"), F.col("b_tile").alias("b"))


def survivors(one: np.ndarray, two: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns (coordinates in order of the basis, unit length) whose product may reach the threshold."""
    size = one.shape[1]
    i, j = np.arange(len(one)), np.arange(len(two))
    total, done = np.zeros((len(one), len(two))), 0
    for step in (*(s for s in STEPS if s < size), size):
        total += one[i, done:step] @ two[j, done:step].T
        rest_one, rest_two = (np.sqrt((x[k, step:] ** 2).sum(1)) for x, k in ((one, i), (two, j)))
        open_ = total + np.outer(rest_one, rest_two) >= threshold - SLACK
        if step == size:
            a, b = np.nonzero(open_)
            return i[a], j[b]
        rows, columns = open_.any(1), open_.any(0)
        i, j, total, done = i[rows], j[columns], total[np.ix_(rows, columns)], step
        if not len(i):
            break
    return i[:0], j[:0]


def compare(one: np.ndarray, two: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of one, row of two) with cosine of at least the threshold; in one tile each pair once."""
    i, j = survivors(unit(one) @ basis, unit(two) @ basis, threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    scale_one, scale_two = (x / np.abs(x).max(1, keepdims=True) for x in (one, two))
    norm_one, norm_two = (np.sqrt((x * x).sum(1)) for x in (scale_one, scale_two))
    for k in range(0, len(i), 1 << 15):
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        keep[k : k + (1 << 15)] = np.einsum("ij,ij->i", scale_one[a], scale_two[b]) / (norm_one[a] * norm_two[b]) >= threshold
    return i[keep], j[keep]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each component of n nodes under links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def links(cut: DataFrame, basis: dict[int, np.ndarray], *, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n, root: for each compared pair of tiles and each vector linked there, its links and its local component."""
    pairs = kit.written(tile_pairs(cut, threshold), "tile-pairs")
    data = cut.select("tile", "size", "ids", "rows")
    # A tile's partners are dealt in parts; its own rows lead each part.
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    parts = dealt.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("parts"))
    dealt = kit.written(dealt.join(parts, "a").select("a", (F.col("part") % F.col("parts")).alias("part"), "b"), "dealt")
    own = dealt.select("a", "part").distinct().join(data, F.col("a") == F.col("tile")).select("a", "part", F.lit(None).cast("long").alias("b"), "size", "ids", "rows")
    others = dealt.join(data, F.col("b") == F.col("tile")).select("a", "part", "b", "size", "ids", "rows")
    rows = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, ids = None, None, None
        for batch in batches:
            for a, part, b, size, some, data_ in zip(*(batch.column(i).to_pylist() for i in range(6))):
                theirs = np.frombuffer(data_).reshape(-1, size)
                their_ids = np.frombuffer(some, np.int64)
                if b is None:
                    key, mine, ids = (a, part), theirs, their_ids
                    continue
                assert key == (a, part)
                i, j = compare(mine, theirs, basis[size], threshold, a == b)
                if not len(i):
                    continue
                both = ids if a == b else np.concatenate([ids, their_ids])
                j = j if a == b else j + len(ids)
                order = np.argsort(both, kind="stable")
                rank = np.empty(len(both), np.int64)
                rank[order] = np.arange(len(both))
                root = local_roots(len(both), rank[i], rank[j])
                n = np.bincount(np.concatenate([rank[i], rank[j]]), minlength=len(both))
                some = np.flatnonzero(n)
                ordered = both[order]
                yield pa.record_batch([pa.array(ordered[some]), pa.array(n[some]), pa.array(ordered[root[some]])], names=["vec_id", "n", "root"])

    return rows.transform(kit.arrow(run, "vec_id long, n long, root long"))


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, label, embedding)."""
    fit = sized(vectors)
    basis = bases(fit)
    found = kit.written(links(tiles(fit, basis, tile=tile), basis, threshold=threshold), "vector-links")
    count = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    component = kit.components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), "component")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return (
        ids.join(count, "vec_id", "left")
        .join(component, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op2_pca_tiled_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(kit.read(spark, sf_dir, "embeddings"))
