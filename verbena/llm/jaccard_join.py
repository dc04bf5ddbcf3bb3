"""Exact n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix
filters, and groups of linked documents.

A document is the set of its word n-grams. N-grams are ordered from rare to frequent, so two
similar sets must share one of the first few; only those prefixes are joined, and every pair
that survives the filters is verified once on the whole sets. Equal sets are one class from
the start.

Because groups are wanted, links inside a group that is already known need no test: linear rounds
link each class with its neighbours and with one hub under each n-gram, and the prefix join then
takes only classes of different groups. ``jaccard_join`` is the join itself, without that short cut.

The n-gram counts that define "rare" come from a table of counters over all documents, sized by
the bytes of the texts up to a limit; any order gives the same result, so it affects speed alone.
In place of a recursive suffix filter two bounds are used that need no whole sets: parity bits
(n-grams that only one set has flip one each) and, for long sets, the overlap of the prefixes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm._common import LOWER, NONSPACE, connected_components, discard, doc_chunks, materialise, mix, signed, small_batches, split_words, text_buffers, tidied

#: The counters are a power of two, one for so many text bytes, between these bounds.
COUNTER_BYTES = 64
LEAST_BITS, MOST_BITS = 18, 24
#: Counters that travel in one row.
SLICE = 1 << 14
#: Counts are kept as so many steps for each doubling, one byte each.
STEPS = 6
#: Words (64 bits) of the parity form, and the difference from which it tells little.
PARITY = 8
LONG = 96
CHUNK_BYTES = 1 << 20
#: Linear rounds before the prefix join.
ROUNDS = 2
#: Partners of a home that are compared in one place, and homes in one row of a guest.
PARTNERS = 500
HOMES = 64
#: Rows of the bit table (64 bits each) that keeps texts without a pair from being moved.
FILTER_ROWS = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct n-gram hashes of each document; with fewer words the whole
    sequence is one n-gram, without words the set is empty."""
    docs, _, _, words = split_words(LOWER[data], offsets, NONSPACE)
    bounds = np.searchsorted(docs, np.arange(len(offsets)))
    grams = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        grams = mix(grams + words[k : k + len(grams)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mix(whole + w)
            yield whole
        else:
            yield words[:0]


def sets_of(batch: pa.RecordBatch, size: int):
    """(row, set) of a batch whose second column is the text."""
    data, offsets = text_buffers(batch.column(1))
    for i, j in doc_chunks(offsets, CHUNK_BYTES):
        part = offsets[i : j + 1]
        yield from enumerate(shingle_sets(data[part[0] : part[-1]], part - part[0], size), i)


def slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams & np.uint64((1 << bits) - 1)).astype(np.int64)


SLICE_SCHEMA = "slice int, width int, counts binary"


def slice_rows(table: np.ndarray, first: int):
    """Non-empty slices of counters, each in the narrowest type."""
    for k in range(0, len(table), SLICE):
        part = table[k : k + SLICE]
        most = int(part.max(initial=0))
        if most:
            part = part.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([first + k // SLICE], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "width", "counts"])


def counter(size: int, bits: int):
    def count(batches):
        table = np.zeros(1 << bits, np.int32)
        for batch in batches:
            held, n = [], 0
            for _, grams in sets_of(batch, size):
                held.append(grams)
                n += len(grams)
                if n > 500_000:
                    add(table, held)
                    n = 0
            add(table, held)
        yield from slice_rows(table, 0)

    def add(table, held):
        if held:
            at, times = np.unique(slots(np.concatenate(held), bits), return_counts=True)
            table[at] += times.astype(np.int32)
            held.clear()

    return count


def add_slices(batches):
    """Sums of the slices that a task gets, as levels of one byte."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, width, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            part = np.frombuffer(zlib.decompress(raw), {1: np.uint8, 2: np.uint16, 8: np.int64}[width]).astype(np.int64)
            held[k] = held[k] + part if k in held else part
    for k, part in held.items():
        level = np.minimum(np.round(np.log2(part + 1.0) * STEPS), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([1], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["slice", "width", "counts"])


def gram_levels(texts: DataFrame, size: int) -> tuple[bytes, int]:
    """(levels, bits): how frequent the n-grams of each slot are, a byte each (16 MB at most,
    compressed). Tasks add up what they read, slices are added up by other tasks as a stream."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (int(total) // COUNTER_BYTES).bit_length()))
    slices = texts.mapInArrow(tidied(counter(size, bits)), SLICE_SCHEMA).repartition("slice").mapInArrow(tidied(add_slices), SLICE_SCHEMA)
    table = np.zeros(1 << bits, np.uint8)
    for row in slices.toLocalIterator():  # at most 2**bits / SLICE rows
        table[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return zlib.compress(table.tobytes(), 1), bits


def least_share(n: np.ndarray | int, percent: int):
    """Least intersection of a set of n with any set that reaches the similarity."""
    return -(-n * percent // 100)


def need_of(percent: int, a: str, b: str) -> str:
    """SQL: the least intersection of two sets of these sizes that reaches the similarity."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


PREFIX_SCHEMA = "doc_id bigint, n bigint, print1 bigint, print2 bigint, parity array<bigint>, prefix array<bigint>"


def prefixer(shared, bits: int, size: int, percent: int):
    def prefixes(batches):
        levels = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            rows, out = [], [[] for _ in range(5)]
            for row, grams in sets_of(batch, size):
                n = len(grams)
                order = np.argsort(levels[slots(grams, bits)], kind="stable")  # ties by hash
                rows.append(row)
                out[0].append(n)
                out[1].append(int(signed(np.add.reduce(mix(grams), keepdims=True))[0]) if n else 0)
                out[2].append(int(signed(np.bitwise_xor.reduce(mix(grams + np.uint64(1)), keepdims=True))[0]) if n else 0)
                out[3].append(parity(grams))
                out[4].append(signed(grams[order[: n - least_share(n, percent) + 1]]) if n else grams.view(np.int64))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=["doc_id", "n", "print1", "print2", "parity", "prefix"])

    return prefixes


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY classes whether it has an odd number of members. Every n-gram
    that only one of two sets has changes one bit, so the bits that differ are a lower bound
    of their difference."""
    odd = np.bincount((grams >> np.uint64(28)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sorted_columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def shared_only(batches):
    """Of rows sorted by token, those whose token another row has. The first and the last run
    of a partition stay: their token may go on in the next one."""
    names = ("token", "pos", "n", "rep")
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = sorted_columns(batch, names)
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        token = rows[0]
        head = np.r_[True, token[1:] != token[:-1]]
        start = np.flatnonzero(head)
        sizes = np.diff(np.r_[start, len(token)])
        keep = sizes >= 2
        keep[0] |= first
        first = False
        last = start[-1]
        held = [x[last:] for x in rows]
        keep = np.repeat(keep, sizes)
        keep[last:] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=list(names))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=list(names))


def neighbours(percent: int):
    """Of rows sorted by (token, place): pairs of rows that stand side by side under a token."""

    def pairs(batches):
        names = ("token", "rep", "n", "component")
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = sorted_columns(batch, names)
            if last is not None:
                rows = [np.r_[a, b] for a, b in zip(last, rows, strict=True)]
            token, rep, n, component = rows
            same = (token[1:] == token[:-1]) & (component[1:] != component[:-1])
            same &= np.minimum(n[1:], n[:-1]) * 100 >= np.maximum(n[1:], n[:-1]) * percent
            a, b = rep[:-1][same], rep[1:][same]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            last = [x[-1:] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return pairs


def linear_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Candidate pairs (a, b) of classes of different components, at most two for each row
    (token, pos, n, rep, component): with the class beside it under the token and with the hub of
    the token. In the first turn the hub is the class with the fewest rarer n-grams, later any."""
    place = F.col("pos") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    rows = rows.select("token", place.alias("place"), "n", "rep", "component")
    keys = ("token", "place", "rep")
    beside = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(neighbours(percent)), "a bigint, b bigint")
    hubs = rows.groupBy("token").agg(F.min(F.struct("place", "rep", "n", "component")).alias("hub"))
    led = rows.join(hubs, "token").where(f"component <> hub.component and rep <> hub.rep and least(n, hub.n) * 100 >= greatest(n, hub.n) * {percent}")
    led = led.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
    return beside.unionByName(led).distinct()


def prefix_pairs(rows: DataFrame, bits: DataFrame, percent: int, apart: bool) -> DataFrame:
    """All candidate pairs (a, b) that share a token and pass the length, positional and parity
    filters; with ``apart`` only those of different components. The smaller set of a pair has its
    token among the first that must hold one (its prefix as the indexed set); a pair is made where
    the tokens before this one differ, so not again under each token of a common run."""
    before = Window.partitionBy("rep").orderBy("pos")
    rows = rows.withColumn("last1", F.lag("token").over(before)).withColumn("last2", F.lag("token", 2).over(before)).join(bits, "rep")
    x, y = rows.where(f"pos <= n - {need_of(percent, 'n', 'n')}").alias("x"), rows.alias("y")
    need = need_of(percent, "x.n", "y.n")
    passed = [
        "(x.n < y.n or (x.n = y.n and x.rep < y.rep))",
        "x.component <> y.component" if apart else "x.rep <> y.rep",
        f"x.n * 100 >= y.n * {percent}",
        f"least(x.before, y.before) + least(x.n - x.pos, y.n - y.pos) >= {need}",
        "not (x.alone and y.alone and (coalesce(x.last1 = y.last1, false) or coalesce(x.last1 = y.last2, false) or coalesce(x.last2 = y.last1, false)))",
        f"{' + '.join(f'bit_count(x.p{k} ^ y.p{k})' for k in range(PARITY))} <= x.n + y.n - 2 * {need}",
    ]
    found = x.join(y, F.expr("x.token = y.token and " + " and ".join(passed)))
    return found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def packed_texts(batches):
    """Texts of documents that have to be compared, compressed."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=["homes", "doc_id", "size", "packed"])


def compared(size: int, percent: int):
    """Of texts sorted by home, the home's own first: pairs that reach the similarity. One home's
    sets (more than one only where rows share its id) are held at a time."""

    def sets_of_rows(batch):
        codec = pa.Codec("zstd", 1)
        sizes = batch.column("size").to_numpy()
        offsets = np.r_[0, np.cumsum(sizes)]
        packed = batch.column("packed")
        for i, j in doc_chunks(offsets, CHUNK_BYTES):
            raw = b"".join(codec.decompress(packed[k].as_buffer(), int(sizes[k]), asbytes=True) for k in range(i, j))
            yield from shingle_sets(np.frombuffer(raw, np.uint8), offsets[i : j + 1] - offsets[i], size)

    def compare(batches):
        home, own = None, []
        for batch in batches:
            a, b = [], []
            keys = zip(*(batch.column(k).to_pylist() for k in ("home", "place", "guest", "doc_id")), strict=True)
            for (at, place, guest, doc), grams in zip(keys, sets_of_rows(batch), strict=True):
                if (at, place) != home:
                    home, own = (at, place), []
                if not guest:
                    own.append(grams)
                    continue
                for mine in own:
                    both = int((mine[np.minimum(np.searchsorted(mine, grams), len(mine) - 1)] == grams).sum()) if len(mine) else 0
                    if both and both * 100 >= percent * (len(mine) + len(grams) - both):
                        a.append(at)
                        b.append(doc)
                        break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity bits, and for long sets whose prefixes, allow the similarity: of
    the set whose prefix ends first, all n-grams in both sets that stand in its prefix are in both
    prefixes, so at least all but its n-grams behind it have to be."""
    differ = " + ".join(f"bit_count(get(pa, {k}) ^ get(pb, {k}))" for k in range(PARITY))
    brief = classes.select("rep", "n", "parity")
    kept = pairs.join(brief.toDF("a", "na", "pa"), "a").join(brief.toDF("b", "nb", "pb"), "b").withColumn("need", F.expr(need_of(percent, "na", "nb")))
    kept = kept.where(f"{differ} <= na + nb - 2 * need").select("a", "b", "na", "nb", "need").distinct()
    kept = kept.withColumn("long", F.expr(f"na + nb - 2 * need > {LONG}"))
    heads = classes.where(f"2 * n - 2 * {need_of(percent, 'n', 'n')} > {LONG} - 4 * {PARITY}").select("rep", "prefix")
    full = kept.where("long").join(heads.toDF("a", "ha"), "a", "left").join(heads.toDF("b", "hb"), "b", "left")
    fits = "coalesce(size(array_intersect(ha, hb)) >= least(need - na + size(ha), need - nb + size(hb)), true)"
    return kept.where("not long").select("a", "b").unionByName(full.where(fits).select("a", "b").distinct())


def filter_place(doc_id: Column) -> tuple[Column, Column]:
    """Row and bit of an id in a bit table of FILTER_ROWS rows."""
    h = F.xxhash64(doc_id)
    return F.pmod(h, F.lit(FILTER_ROWS)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int"))


def filter_bits(ids: DataFrame) -> DataFrame:
    """The bit table of ``ids`` (doc_id): it is of bounded size, so that it can be broadcast."""
    slot, bit = filter_place(F.col("doc_id"))
    return ids.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))


def with_pairs(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` without most rows whose doc_id is not among ``ids``, so that they are not moved.
    The caller's join is exact."""
    slot, bit = filter_place(F.col("doc_id"))
    return texts.join(F.broadcast(filter_bits(ids)), slot == F.col("__slot")).where(F.col("__bits").bitwiseAND(bit) != 0).select("doc_id", "text")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity: the filters that need no whole sets,
    then one exact intersection for each pair."""
    kept = materialise(plausible(pairs, classes, percent), f"{tag}-pairs")
    # A pair is compared at the home of the member with more partners; a home with many of them
    # has several places, each with its own copy of the home's text.
    partners = kept.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("partners"))
    both = kept.join(partners.toDF("a", "of_a"), "a").join(partners.toDF("b", "of_b"), "b")
    dealt = materialise(both.select(F.expr("if(of_a >= of_b, a, b)").alias("home"), F.expr("if(of_a >= of_b, b, a)").alias("doc_id"), F.least("of_a", "of_b").alias("partners")), f"{tag}-dealt")
    homes = dealt.groupBy("home").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("places"))
    guests = dealt.join(homes, "home").select("doc_id", "home", F.pmod(F.xxhash64("doc_id"), F.col("places")).cast("int").alias("place"), F.lit(True).alias("guest"), F.pmod(F.xxhash64("home"), F.ceil(F.col("partners") / HOMES)).alias("lot"))
    hosts = homes.select(F.col("home").alias("doc_id"), "home", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(False).alias("guest"), F.lit(-1).cast("bigint").alias("lot"))
    roles = guests.unionByName(hosts).withColumn("lot", F.when(F.col("guest"), F.col("lot")).otherwise(-1 - F.floor(F.col("place") / HOMES)))
    roles = materialise(roles.groupBy("doc_id", "lot").agg(F.collect_list(F.struct("home", "place", "guest")).alias("homes")), f"{tag}-roles")
    chosen = with_pairs(texts, roles.select("doc_id")).join(roles, "doc_id").select("doc_id", "text", "homes")
    packed = chosen.mapInArrow(tidied(packed_texts), "homes array<struct<home:bigint,place:int,guest:boolean>>, doc_id bigint, size bigint, packed binary")
    packed = packed.select(F.explode("homes").alias("at"), "doc_id", "size", "packed").select("at.*", "doc_id", "size", "packed")
    found = packed.repartition("home", "place").sortWithinPartitions("home", "place", "guest").mapInArrow(tidied(compared(size, percent)), "a bigint, b bigint")
    found = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-links")
    discard(kept, dealt, roles)
    return found


def indexed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, members, classes, rows): members are doc_id, n, print1, print2 of every row, classes
    are those of equal sets with parity and prefix, rows are the n-grams in the prefixes of classes
    that another class shares (token, pos, n, rep, before)."""
    texts = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels, bits = gram_levels(texts, size)
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    every = materialise(texts.mapInArrow(tidied(prefixer(shared, bits, size, percent)), PREFIX_SCHEMA), "members")
    shared.destroy()
    members = materialise(every.select("doc_id", "n", "print1", "print2"), "prints")
    classes = materialise(
        every.where("n > 0 and doc_id is not null").groupBy("n", "print1", "print2").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix")), "classes"
    )
    discard(every)
    rows = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token")).select("token", F.col("pos").cast("bigint").alias("pos"), "n", "rep")
    row_schema = "token bigint, pos bigint, n bigint, rep bigint"
    shared = rows.repartitionByRange("token", "pos", "n", "rep").sortWithinPartitions("token", "pos", "n", "rep").mapInArrow(tidied(shared_only), row_schema)
    # Positional filter of a single row: n-grams of no other class cannot be shared, so at most
    # its shared n-grams up to here and all behind it are in an intersection.
    before = F.row_number().over(Window.partitionBy("rep").orderBy("pos")) - 1
    shared = shared.withColumn("before", before.cast("bigint")).where(F.expr(f"(before + n - pos) * 100 >= n * {percent}"))
    return texts, members, classes, materialise(shared, "shared")


def parity_columns(classes: DataFrame) -> DataFrame:
    """The parity words of each class beside its representative, and whether no other class (of a
    row that shares the id) has the same one."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("rep")) == 1
    return classes.select("rep", alone.alias("alone"), *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY)])


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every
    row; two documents link when the Jaccard similarity of their n-gram sets is at least
    ``percent`` hundredths. Exact: every filter only drops what cannot link.

    Null and empty texts have no n-grams and link with nothing; equal sets always link; a row
    without doc_id has no component; of rows that share a doc_id each has the component of its
    own text; an empty table gives no rows; other columns are ignored.
    """
    texts, members, classes, rows = indexed(docs, size, percent)
    known = docs.sparkSession.createDataFrame([], "node bigint, component bigint")

    def grown(links: DataFrame, tag: str) -> DataFrame:
        return connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), tag)

    def still_open() -> DataFrame:
        """Rows of the tokens that stand in classes of several components."""
        named = rows.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
        return materialise(named.join(mixed, "token", "left_semi"), "open")

    left = materialise(rows.withColumn("component", F.col("rep")), "open")
    for turn in range(ROUNDS):
        links = verified(linear_pairs(left, percent, turn), classes, texts, size, percent, f"turn{turn}")
        if not links.take(1):
            break
        known = grown(links, f"turn{turn}")
        discard(left, links)
        left = still_open()
    links = verified(prefix_pairs(left, parity_columns(classes), percent, True), classes, texts, size, percent, "apart")
    if links.take(1):
        known = grown(links, "apart")
    discard(left, links)
    named = classes.select("n", "print1", "print2", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("n", "print1", "print2", F.coalesce("component", "rep").alias("component"))
    out = members.join(named, ["n", "print1", "print2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join as (links, members): every verified pair (a, b) of representatives of
    different sets, and for every row doc_id, n_shingles, representative (the smallest doc_id with
    an equal set) and n_links (the other documents it links with, rows that share an id counted
    once). Nulls, ties and empty texts as in ``jaccard_groups``; the links grow with the pairs."""
    texts, members, classes, rows = indexed(docs, size, percent)
    left = rows.withColumn("component", F.col("rep"))
    links = verified(prefix_pairs(left, parity_columns(classes), percent, False), classes, texts, size, percent, "join")
    named = members.join(classes.select("n", "print1", "print2", "rep"), ["n", "print1", "print2"], "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("representative"))
    sizes = named.where("n_shingles > 0 and doc_id is not null").groupBy("representative").agg(F.count_distinct("doc_id").alias("copies"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = ends.join(sizes.withColumnRenamed("representative", "b"), "b").groupBy("a").agg(F.sum("copies").alias("beyond")).withColumnRenamed("a", "representative")
    out = named.join(sizes, "representative", "left").join(beyond, "representative", "left")
    n_links = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("beyond", F.lit(0))).otherwise(0)
    return links, out.select("doc_id", "n_shingles", "representative", n_links.cast("bigint").alias("n_links"))


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id; of rows that
    share that id all stay. Documents without words or without id all stay."""
    rest = materialise(jaccard_groups(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    own = uuid.uuid4().hex  # names that no column of ``docs`` has
    slot, bit = filter_place(F.col("doc_id").cast("bigint"))
    marked = docs.withColumn(f"place {own}", slot).withColumn(f"bit {own}", bit).join(F.broadcast(filter_bits(rest).toDF(f"place {own}", f"bits {own}")), f"place {own}", "left")
    doubtful = F.coalesce(F.col(f"`bits {own}`").bitwiseAND(F.col(f"`bit {own}`")) != 0, F.lit(False))
    # most rows stay where they are; only those whose bit is set meet the exact list
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clear, met = marked.where(~doubtful).select(*columns), marked.where(doubtful).select(*columns)
    return clear.unionByName(met.join(rest.toDF(f"copy {own}"), F.col("doc_id") == F.col(f"`copy {own}`"), "left_anti"))
