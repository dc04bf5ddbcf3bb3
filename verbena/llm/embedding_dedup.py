"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected onto many random lines. Two vectors at the similarity sought are
close on almost every line, others on few: the window around a query on a line counts a collision
for every vector inside, and a pair is verified (cosine in double precision) only when its count
over all lines reaches a level calibrated for recall.

Which pairs meet at all is decided by tables: in each, the halves of ``k`` further lines on which a
vector lies make its bucket, and there are so many tables that a pair at the threshold shares a
bucket in one of them with the recall asked for. ``k`` grows with the logarithm of the rows, so
buckets stay small, the tables with a power of about 0.15. Inside a bucket vectors are sorted on one
line, and the runs inside the windows are enumerated. A pair counts in the first table in which its
keys agree, so sums over tables are exact. A bucket with many vectors is cut into blocks, each pair
of which is a unit of work of bounded size. A unit returns counts for each vector and a spanning
forest of its links, never all pairs. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import connected_components, discard, materialise, tidied

#: Vectors that a bucket holds on average if they are spread evenly, and that one block holds.
BUCKET = 200
BLOCK = 2_000
#: Projections that count, and their share of collisions that pairs at the threshold reach; also
#: the share of pairs at the threshold that meet in a table.
LINES = 32
RECALL = 0.999
#: Half width of the window whose runs are enumerated and of a counting window, in standard
#: deviations of the difference at the threshold.
RUN_SIGMAS, WINDOW_SIGMAS = 3.3, 2.0
#: Pairs that are counted at once, and lines after which those that cannot reach the count go.
PAIRS_AT_ONCE = 1 << 20
LINES_AT_ONCE = 4


def tail(n: int, p: float, least: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def calibrated_count(lines: int = LINES, recall: float = RECALL) -> int:
    """The largest count that pairs at the threshold still reach with the recall asked for."""
    p = math.erf(WINDOW_SIGMAS / math.sqrt(2))
    return max(k for k in range(1, lines + 1) if k == 1 or tail(lines, p, k) >= recall)


def table_sizes(rows: int, threshold: float) -> tuple[int, int]:
    """(lines of a table, tables): buckets of about BUCKET vectors, and so many tables that two
    vectors at the threshold share a bucket with the recall asked for."""
    k = max(0, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** k
    return k, 1 if meet >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def directions(size: int, lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, lines))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as double precision unit vectors; scaled first, so that squares stay finite."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(k: int, tables: int, width: int):
    """rep, copies, the components as bytes, their number, and the key of every table."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :]
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.stack([flat[ends[i] - size : ends[i]] for i in own])
                keys = np.zeros((len(own), tables), np.int64)
                lines = directions(int(size), k * tables, 1)
                for s in range(0, len(own) if k else 0, 1_000):
                    bits = (unit(x[s : s + 1_000]) @ lines >= 0).reshape(-1, tables, k)
                    keys[s : s + 1_000] = (bits * (np.int64(1) << np.arange(k, dtype=np.int64) % 63)).sum(axis=2)
                raw = [row.tobytes() for row in x.astype(f"<f{width}")]
                at = pa.array(own)
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(raw, pa.binary()), pa.array(np.full(len(own), size), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["rep", "copies", "raw", "size", "keys"],
                )

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of links."""
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def runs(low: np.ndarray, high: np.ndarray):
    """Pairs (i, j) with low[i] <= j < high[i], in parts of about PAIRS_AT_ONCE."""
    sizes = np.maximum(high - low, 0)
    ends = np.cumsum(sizes)
    s = 0
    while s < len(low):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS_AT_ONCE, "right")))
        own = sizes[s:e]
        i = np.repeat(np.arange(s, e), own)
        j = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + low[i]
        yield i, j
        s = e


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float, met):
    """Pairs (i, j) of rows of ``x`` and ``y`` (of ``x`` with itself, each once, if ``y`` is None)
    that reach the threshold, found by their collisions; ``met(i, j)``: whether a pair counts
    elsewhere."""
    sigma = math.sqrt(max(2 - 2 * threshold, 1e-12))
    lines = directions(x.shape[1], LINES, 2)
    least, window = calibrated_count(), WINDOW_SIGMAS * sigma + 1e-6
    on_x = (x @ lines).T.astype(np.float32)
    order = np.argsort(on_x[0], kind="stable")
    if y is None:
        y, on_y, order_y = x, on_x, order
    else:
        on_y = (y @ lines).T.astype(np.float32)
        order_y = np.argsort(on_y[0], kind="stable")
    line, line_y = on_x[0][order], on_y[0][order_y]
    high = np.searchsorted(line_y, line + (RUN_SIGMAS * sigma + 1e-6), "right")
    low = np.arange(1, len(line) + 1) if y is x else np.searchsorted(line_y, line - (RUN_SIGMAS * sigma + 1e-6))
    for a, b in runs(low, high):
        i, j = order[a], order_y[b]
        count = np.zeros(len(i), np.int8)
        for t in range(0, LINES, LINES_AT_ONCE):
            for k in range(t, min(t + LINES_AT_ONCE, LINES)):
                count += np.abs(on_x[k][i] - on_y[k][j]) <= window
            alive = count >= least - (LINES - min(t + LINES_AT_ONCE, LINES))
            i, j, count = i[alive], j[alive], count[alive]
        fresh = ~met(i, j)
        i, j = i[fresh], j[fresh]
        good = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        yield i[good], j[good]


LINK_SCHEMA = "rep bigint, n_links bigint, other bigint"


def link_units(threshold: float, width: int):
    """Of rows sorted by unit (its first block, then its second): link counts of every vector and a
    spanning forest of the links."""
    marks = ("unit", "table", "size", "key", "low", "high")
    names = (*marks, "side", "rep", "copies", "raw", "keys")

    def linked(rows):
        size, (side, rep, copies, raw, keys) = rows[2], rows[len(marks) :]
        x = unit(np.frombuffer(b"".join(raw), f"<f{width}").reshape(len(raw), int(size[0])))
        keys = np.stack(keys)[:, :-1]  # of the tables before this one
        first, second = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        alone = side[0] == 0
        other = first if alone else second
        totals = np.zeros(len(rep), np.int64)
        left, right = [], []
        if len(first) and len(other) and len(rep) > 1:
            met = lambda i, j: (keys[first[i]] == keys[other[j]]).any(axis=1)
            for i, j in linked_pairs(x[first], None if alone else x[second], threshold, met):
                i, j = first[i], other[j]
                totals += np.bincount(i, weights=copies[j], minlength=len(rep)).astype(np.int64)
                totals += np.bincount(j, weights=copies[i], minlength=len(rep)).astype(np.int64)
                a, b = forest(rep[i], rep[j])
                left += a
                right += b
            left, right = forest(np.array(left, np.int64), np.array(right, np.int64))
        some = totals > 0
        ids = pa.array(np.r_[rep[some], np.array(left, np.int64)])
        others = pa.array([None] * int(some.sum()) + right, pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(np.r_[totals[some], np.zeros(len(left), np.int64)]), others], names=["rep", "n_links", "other"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [np.asarray(batch.column(k).to_pylist(), object) if k == "raw" else batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            cut = np.flatnonzero(np.any([v[1:] != v[:-1] for v in part[: len(marks)]], axis=0)) + 1
            for s, e in zip(np.r_[0, cut[:-1]], cut, strict=True) if len(cut) else ():
                yield linked([v[s:e] for v in part])
            held = [v[cut[-1] if len(cut) else 0 :] for v in part]
        if held is not None:
            yield linked(held)

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Null vectors, empty ones, zero vectors and vectors with null or non-finite components link
    with nothing, nor do vectors of different sizes. Rows that share an id count once (with the
    smallest usable vector); a row without id links with nothing and is its own group without a
    component; ties do not matter; an empty table gives no rows; other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind, width = ("array<float>", 4) if kind == "array<float>" else ("array<double>", 8)
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    usable = source.where("vec_id is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))
    once = materialise(usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("*", F.xxhash64("embedding").alias("print1"), F.xxhash64(F.lit(1), "embedding").alias("print2")), "vectors")
    classes = materialise(once.groupBy("print1", "print2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vector-classes")
    members = materialise(once.select("vec_id", "print1", "print2").join(classes.select("print1", "print2", "rep", "copies"), ["print1", "print2"]).select("vec_id", "rep", "copies"), "vector-members")
    discard(once)
    k, tables = table_sizes(classes.count(), threshold)
    points = classes.select("rep", "copies", "embedding").mapInArrow(tidied(keyed(k, tables, width)), "rep bigint, copies bigint, raw binary, size int, keys array<bigint>")
    points = materialise(points, "vector-keys")
    buckets = points.select("size", F.posexplode("keys").alias("table", "key"))
    crowded = materialise(buckets.groupBy("table", "size", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK), "crowded")
    crowded = crowded.select("table", "size", "key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    placed = points.select("rep", "copies", "raw", "size", "keys", F.posexplode("keys").alias("table", "key")).join(crowded, ["table", "size", "key"], "left")
    # a unit is a block, or a pair of blocks of one bucket; blocks are dealt by a hash
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    dealt = placed.select(F.xxhash64("table", "size", "key", low, high).alias("unit"), "table", "size", "key", low.alias("low"), high.alias("high"), side.alias("side"), "rep", "copies", "raw", F.slice("keys", 1, F.col("table") + 1).alias("keys"))
    found = dealt.repartition("unit").sortWithinPartitions("unit", "table", "size", "key", "low", "high", "side").mapInArrow(tidied(link_units(threshold, width)), LINK_SCHEMA)
    found = materialise(found, "links")
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n_links").alias("beyond"))
    groups = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "vectors")
    told = members.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("vec_id", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = source.select("vec_id").join(told, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
