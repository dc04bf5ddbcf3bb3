"""Shared building blocks of the corpus operators.

* scratch tables in the shared folder of the cluster (``spark.checkpoint.dir``),
* zero-copy access to Arrow text buffers and vectorised word splitting/hashing,
* connected components as an iterated DataFrame computation.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Bases of two independent polynomial hashes; odd, so that they have inverses modulo 2**64.
POLY = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)



# ---------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set there has to be one machine
    alone (a local master): then it is a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "verbena"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there,
    so a lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/verbena-llm/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.verbena_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "verbena_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows and bytes of an Arrow batch: whole texts are long, and a worker holds a few batches at a time.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session gives Python workers batches of at most BATCH_ROWS rows and about
    BATCH_BYTES bytes (a longer row is alone) from now on, unless the session sets fewer."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (conf.get(key, None) or "").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df


def tidied(fn):
    """A function of batches whose worker gives freed memory back when its task ends."""

    def run(batches):
        yield from fn(batches)
        trim()

    return run


def trim() -> None:
    """Give freed memory back to the system: a worker process goes on to other stages."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if release is not None:
        release(0)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Keep exactly the columns an operator reads; extra columns, clashing ones too, go."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def process_store(name: str) -> dict:
    """A dictionary for the life of a process. Functions come to a worker by value, anew with every
    task, and would bring the globals they read along; this one stays where it is."""
    return sys.__dict__.setdefault("_verbena_held", {}).setdefault(name, {})


# ---------------------------------------------------------------- text buffers
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int):
    """Ranges of whole documents of about ``limit`` bytes; a longer one is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """POLY[which]**i and its inverse for i < n, kept for the next batch."""
    store = process_store("powers")
    if which not in store or len(store[which][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (POLY[which], pow(POLY[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        store[which] = out
    return store[which][0][:n], store[which][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a uint64 array."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): bytes [s, e) hash to (sums[e] - sums[s]) * inverse[s]."""
    p, q = powers(len(data) + 1, which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return sums, q


#: ASCII lower-casing of A-Z only, as a byte table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Lower-cased text: letters a-z, digits and everything beyond ASCII.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Everything but blank, tab, line feed, vertical tab, form feed, carriage return.
NONSPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Words of lower-cased bytes: (document index, start, end, 64-bit hash) arrays, in
    text order. Words never cross documents."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    sums, inverse = prefix_hash(data)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return docs, starts, ends, hashes


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- connected components
def connected_components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a, b): rows (node, component), the
    component being its smallest node. Nodes without an edge do not appear.

    Min-label hooking with pointer jumping: each round a node and its parent take the
    smallest grandparent seen over their edges, then pointers are halved; the number of
    rounds grows with the logarithm of the longest path. Every step is a partially
    aggregated group-by or a join that adaptive execution can split, every round ends in
    a table in the shared folder, and only the number of changes reaches the driver.
    """
    e = materialise(
        edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{tag}-edges"
    )
    parent = materialise(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), f"{tag}-parent")
    for _ in range(max_rounds):
        top = parent.select(F.col("node").alias("up"), F.col("up").alias("grand"))
        grand = parent.join(top, "up").select("node", "up", "grand")
        seen = e.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("seen"))
        best = grand.join(seen, "node").withColumn("seen", F.least("seen", "grand"))
        offers = best.select(F.inline(F.array(F.struct(F.col("node").alias("node"), F.col("seen").alias("up")), F.struct(F.col("up").alias("node"), F.col("seen").alias("up")))))
        offered = offers.groupBy("node").agg(F.min("up").alias("offer"))
        fresh = materialise(
            parent.join(offered, "node").select("node", F.least("up", "offer").alias("up"), (F.col("offer") < F.col("up")).alias("moved")), f"{tag}-parent"
        )
        moved = fresh.where("moved").limit(1).count()
        discard(parent)
        parent = fresh.select("node", "up")
        parent.verbena_path = fresh.verbena_path
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    discard(e)
    return parent.select("node", F.col("up").alias("component"))
