"""What the operators of this subpackage share: tables of the input folder and written intermediate tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECORDS: ContextVar[tuple[list[str], ...]] = ContextVar("records", default=())
#: A folder for each local session that names none.
_LOCAL: dict[str, str] = {}


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``scratch`` gives meanwhile in this thread, in order."""
    made: list[str] = []
    token = _RECORDS.set((*_RECORDS.get(), made))
    try:
        yield made
    finally:
        _RECORDS.reset(token)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where that is unset, a local master gets a folder of our own; on a cluster it is an error, since each
    executor would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='descra-')}"
        top = _LOCAL[context.applicationId]
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _RECORDS.get():
        made.append(path)
    return path


#: Has Spark remove an execution's shuffle files at its end; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """df as Parquet, after which its shuffle files are gone: a chain of such steps needs the disk of its largest one."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: lineage ends here, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a written table or folder that nothing needs any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a batch between Spark and Python: texts may be long, so rows alone do not bound one.
ARROW_BYTES = 8 << 20


def arrow(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: mapInArrow with batches bounded in bytes, after which a worker gives its free memory back."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    def apply(df: DataFrame) -> DataFrame:
        conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(name).strip().lower()).groups()
        most = int(number) << 10 * " kmgtp".index(unit or " ")
        if not 0 < most <= ARROW_BYTES:
            conf.set(name, ARROW_BYTES)
        return df.mapInArrow(released, schema)

    return apply


def partitions(df: DataFrame) -> int:
    """As many as the scan has: they follow the input's size."""
    return max(1, df.rdd.getNumPartitions())


#: Links that one task joins, and how many neighbours of a node meet in one task beyond that.
FEW_LINKS, NEIGHBOURS = 1 << 18, 1000


def components(edges: DataFrame, name: str = "components", *, few: int = FEW_LINKS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Connected components of edges (a, b): node, component (the smallest node reachable), for every node in an edge.

    Up to ``few`` distinct edges, counted first, one task joins them.  Beyond that, large-star and small-star steps
    over written tables alternate until nothing changes; every step is a shuffle of at most two rows an edge.  It needs
    a minimum per node, which is pre-aggregated, and a join in which the neighbours of a node are dealt to one task for
    each ``neighbours`` of them: the nodes with more are listed, at most 50,000 of them whatever the input, and broadcast.
    Edges with a null end are left out; loops and repeated edges count for nothing.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    path, before = scratch(spark, name), None
    write(both, path)  # each step reads its edges several times
    now = spark.read.schema(both.schema).parquet(path)
    many = now.count()
    if many <= few:
        return written(now.repartition(1).transform(arrow(joined, "node long, component long")), name)
    while True:
        most = max(neighbours, many // 25_000)
        two_way = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: a larger neighbour goes to the smallest of a node's neighbourhood.
        large = with_least(two_way, most, F.least(F.min("v"), F.first("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node's smaller neighbours, and itself, go to the smallest of them.
        small = with_least(large, most, F.min("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch(spark, name)
        write(small, new)
        now = spark.read.schema(small.schema).parquet(new)
        # Done when every node has one parent and no parent has one itself, and nothing moved.
        state = now.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        drop(spark, path)
        path, many = new, state[0]
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_least(edges: DataFrame, most: int, least) -> DataFrame:
    """edges (u, v) with m, the ``least`` of each u; no task gets more than about ``most`` edges of a node."""
    per_node = edges.groupBy("u").agg(least.alias("m"), F.ceil(F.count("*") / F.lit(most)).alias("salts"))
    hubs = per_node.where("salts > 1").select("u", "salts")  # at most 2 * edges / most rows
    dealt = edges.join(F.broadcast(hubs), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).alias("salt"))
    return dealt.join(per_node.select("u", "m", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v): node and component of each end."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = number[: len(u)], number[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        least = np.minimum(root[a], root[b])
        for end in (a, b, root[a], root[b]):
            np.minimum.at(low, end, least)
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])
