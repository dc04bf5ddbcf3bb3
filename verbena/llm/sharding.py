"""Hilbert-curve sharding with DataFrame operations only.

Each metadata dimension is quantised into equally filled cells by the order of its values,
the cells are turned into an index on a Hilbert curve, rows are sorted by it, and the sorted
rows are cut into runs. Neighbours on the curve are close in *every* dimension, so the
minimum and maximum of each dimension in a shard stay tight and readers can skip shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm._common import materialise

#: Position inside a partition, as ``monotonically_increasing_id`` numbers rows.
ROW_BITS = (1 << 33) - 1


def ranked(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """``df`` with its global 0-based position by ``keys`` as ``position``.

    Rows are dealt by ranges of the keys and sorted inside each partition; a partition's
    offset is the sum of the counts before it. Only one row for each partition is gathered.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(dealt.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("at")), tag)
    counts = placed.groupBy("pid").count()
    offsets = counts.select("pid", (F.sum("count").over(Window.orderBy("pid")) - F.col("count")).alias("before"))
    # one row for each partition: bounded by the number of partitions
    return placed.join(F.broadcast(offsets), "pid").withColumn("position", F.col("before") + F.col("at")).drop("pid", "at", "before")


def cell_bounds(df: DataFrame, dims: list[str], cells: int) -> dict[int, list[tuple[int, object]]]:
    """For each dimension, (cell, least value) of its non-empty cells: at most ``cells``
    pairs. All values are counted; equal values share a cell."""
    numeric = [t not in ("string", "binary", "boolean", "date") and not t.startswith("timestamp") for t in (dict(df.dtypes)[d] for d in dims)]
    parts = [
        F.struct(F.lit(k).alias("dim"), (F.col(d).cast("double") if num else F.lit(None).cast("double")).alias("v"), (F.lit(None).cast("string") if num else F.col(d).cast("string")).alias("s"))
        for k, (d, num) in enumerate(zip(dims, numeric, strict=True))
    ]
    values = df.select(F.inline(F.array(*parts))).groupBy("dim", "v", "s").agg(F.count("*").alias("n"))
    dealt = values.repartitionByRange("dim", "v", "s")
    dealt = materialise(dealt.select("*", F.spark_partition_id().alias("pid")), "cells")
    own = F.sum("n").over(Window.partitionBy("pid", "dim").orderBy("v", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = dealt.groupBy("dim", "pid").agg(F.sum("n").alias("n"))
    before = sums.select("dim", "pid", (F.sum("n").over(Window.partitionBy("dim").orderBy("pid")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("dim")).alias("total"))
    cell = F.floor((F.col("before") + F.col("own") - F.col("n")) * cells / F.col("total"))
    least = dealt.withColumn("own", own).join(F.broadcast(before), ["dim", "pid"]).groupBy("dim", cell.alias("cell")).agg(F.min(F.struct("v", "s")).alias("least"))
    bounds: dict[int, list[tuple[int, object]]] = {k: [] for k in range(len(dims))}
    for row in least.orderBy("dim", "cell").collect():  # at most len(dims) * cells rows
        value = row["least"]["v"] if numeric[row["dim"]] else row["least"]["s"]
        if value is not None:
            bounds[row["dim"]].append((int(row["cell"]), value))
    return bounds


def hilbert_stages(n: int, bits: int) -> list[dict[str, str]]:
    """Projections that turn cells x0..x(n-1) into the curve index ``h``: the inverse undo
    of excess work, Gray encoding and bit interleaving, one projection for each step so
    that no expression is repeated."""
    stages: list[dict[str, str]] = []
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if i == 0:
                stages.append({"x0": f"case when (x0 & {q}) <> 0 then x0 ^ {p} else x0 end"})
            else:
                stages.append({"x0": f"case when (x{i} & {q}) <> 0 then x0 ^ {p} else x0 ^ ((x0 ^ x{i}) & {p}) end", f"x{i}": f"case when (x{i} & {q}) <> 0 then x{i} else x{i} ^ ((x0 ^ x{i}) & {p}) end"})
        q >>= 1
    for i in range(1, n):
        stages.append({f"x{i}": f"x{i} ^ x{i - 1}"})
    terms = " ^ ".join(f"(case when (x{n - 1} & {1 << k}) <> 0 then {(1 << k) - 1} else 0 end)" for k in range(1, bits)) or "0"
    stages.append({"t": terms})
    stages.append({f"x{i}": f"x{i} ^ t" for i in range(n)})
    weights = [(i, k, n * k + (n - 1 - i)) for k in range(bits) for i in range(n)]
    stages.append({"h": " | ".join(f"shiftleft(shiftright(x{i}, {k}) & 1, {to})" for i, k, to in weights)})
    return stages


def with_hilbert(df: DataFrame, dims: list[str], bits: int = 4) -> DataFrame:
    """``df`` with the Hilbert index of its quantised dimensions as ``hilbert`` (long). Null
    values fall into the first cell."""
    bounds = cell_bounds(df, dims, 1 << bits)
    kept = df.columns
    for k, d in enumerate(dims):
        cell = None
        for number, value in reversed(bounds[k]):
            test = F.col(d).cast("double" if not isinstance(value, str) else "string") >= F.lit(value)
            cell = F.when(test, number) if cell is None else cell.when(test, number)
        df = df.withColumn(f"x{k}", (F.lit(0) if cell is None else cell.otherwise(0)).cast("bigint"))
    for stage in hilbert_stages(len(dims), bits):
        df = df.withColumns({c: F.expr(e).cast("bigint") for c, e in stage.items()})
    return df.select(*kept, F.col("h").alias("hilbert"))


def hilbert_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4) -> DataFrame:
    """Cut ``docs`` along the curve into ``shards`` runs whose row counts are at most one
    apart (law ``rows``): doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law,
    shard, slot (position in the shard), grown_shard (null), hilbert.

    Ties on the curve are broken by doc_id, checksum and the order of reading; repeated rows get
    slots of their own; a null text has no bytes; null dimensions sort first; with fewer rows than shards
    some shards are empty; an empty table gives no rows. The whole curve order is one range
    partitioned sort whose keys no two rows share, so that a hot source, a group of copies or rows
    without doc_id are cut like anything else.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *[F.col(d).alias(f"dim{k}") for k, d in enumerate(dims)], (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    # the texts are read once; with a number of its own every row can be dealt anywhere
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    curve = with_hilbert(rows, [f"dim{k}" for k in range(len(dims))], bits)
    placed = ranked(curve.select("doc_id", "size", "text_crc32", "row", "hilbert"), ["hilbert", "doc_id", "text_crc32", "row"], "curve")
    total = rows.count()
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("position") - start)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
    )


def shard_statistics(docs: DataFrame, placed: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """The pruning table: for each shard its rows and the least and greatest value of every
    dimension, as a manifest would hold them."""
    wide = docs.select("doc_id", *dims).join(placed.select("doc_id", "shard"), "doc_id")
    return wide.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
