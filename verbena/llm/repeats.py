"""Removal of repeated byte strings: a Burrows-Wheeler transform with threshold-bounded
interval expansion, dealt over the cluster by content.

Strings of ``length`` bytes that start at two places are found in three steps.

1. Content decides anchors: in every window of ``length`` bytes the k-gram with the least hash
   (the leftmost of equal ones), so equal strings have equal anchors at equal distance. Only
   places that share an anchor can repeat. Equal surroundings are settled by their count.
2. Surroundings that differ but share an anchor are put into one text with its Burrows-Wheeler
   transform. Common prefixes are derived by increasing value: a boundary between suffixes
   whose prefixes differ before l bytes extends backward, over the preceding bytes, to
   boundaries that differ before l + 1, breadth first, until ``length``. Suffixes that no
   boundary separates then share at least ``length`` bytes.
3. The covered bytes are joined to their documents and removed.

The surroundings of an anchor that has very many are sorted, once by what follows the anchor and
once backward by what precedes it, and trimmed to what each shares with another; those that have
become equal are settled by their count. If many are left, they are dealt into blocks, each with a
transform of its own; the strings that a block has found to be alone, and one of each kind that
repeats in it, then meet those of the other blocks by 128-bit hashes. No place holds all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import discard, doc_chunks, materialise, mix, prefix_hash, signed, small_batches, text_buffers, tidied

LENGTH = 400
#: Bytes of an anchor; a shorter string cannot be one.
GRAM = 200
CHUNK_BYTES = 2 << 20
#: Bytes of one transform, and the different surroundings of an anchor that one holds at most, or a
#: block on average.
TEXT_BYTES = 1 << 18
MAX_SURROUNDINGS = 1_000
#: Place bits beside the hash in the window minimum; longer documents are read in pieces.
PLACE = 24


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of each window of ``size`` values."""
    out = len(values) - size + 1
    blocks = -(-len(values) // size)
    grid = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:out], ahead[size - 1 : size - 1 + out])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Places of all anchors, their hashes, and a function that hashes byte ranges with another
    base."""
    n = len(data)
    sums, inverse = prefix_hash(data)

    def span_hash(s, e):
        other, back = prefix_hash(data, 1)
        return mix((other[e] - other[s]) * back[s] + (e - s).astype(np.uint64))

    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), span_hash
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << PLACE) - 1)
    found = []
    size = length - gram + 1
    piece = (1 << PLACE) - 1
    for s in range(0, len(grams) - size + 1, piece - size + 1):
        part = grams[s : s + piece]
        least = window_minima((part & ~low) | np.arange(len(part), dtype=np.uint64), size)
        start = np.arange(s, s + len(least))
        doc = np.searchsorted(offsets, start, "right") - 1
        inside = start + length <= offsets[doc + 1]
        found.append(np.unique(least[inside] & low).astype(np.int64) + s)
    at = np.unique(np.concatenate(found))
    return at, grams[at], span_hash


ANCHOR_SCHEMA = "doc_id bigint, doc_print bigint, gram bigint, around bigint, pos bigint, before int, behind int"


def anchor_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in doc_chunks(offsets, CHUNK_BYTES):
                part = offsets[i : j + 1]
                local = part - part[0]
                at, grams, span_hash = anchors(data[part[0] : part[-1]], local, length, gram)
                doc = np.searchsorted(local, at, "right") - 1
                s = np.maximum(at - (length - gram), local[doc])
                e = np.minimum(at + length, local[doc + 1])
                around = mix(span_hash(s, e) + (at - s).astype(np.uint64)) if len(at) else grams
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(signed(grams)), pa.array(signed(around)), pa.array(at - local[doc]), pa.array((at - s).astype(np.int32)), pa.array((e - at).astype(np.int32))],
                    names=["doc_id", "doc_print", "gram", "around", "pos", "before", "behind"],
                )

    return run


PIECE_SCHEMA = "gram bigint, hot boolean, doc_id bigint, doc_print bigint, start bigint, many boolean, piece binary, place int"


def cut_pieces(batches):
    """The surroundings asked for (``wanted``) of each document, and where the anchor is in them."""
    for batch in batches:
        out = [[] for _ in range(8)]
        for doc_id, doc_print, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            raw = text.encode()
            for w in wanted:
                s = w["pos"] - w["before"]
                for k, v in enumerate((w["gram"], w["hot"], doc_id, doc_print, s, w["many"], raw[s : w["pos"] + w["behind"]], w["before"])):
                    out[k].append(v)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["gram", "hot", "doc_id", "doc_print", "start", "many", "piece", "place"])


SIDE_SCHEMA = "gram bigint, side binary, doc_id bigint, doc_print bigint, start bigint, many boolean, piece binary, place int"


def common_lengths(grams: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """For each row but the last, the bytes that its side shares with the next one's (of one gram)."""
    sizes = np.array([len(x) for x in sides])
    width = int(sizes.max(initial=0))
    table = np.zeros((len(sides), width + 1), np.uint8)
    table[np.repeat(np.arange(len(sides)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(sides), np.uint8)
    differ = table[1:] != table[:-1]
    differ[:, -1] = True
    return np.where(grams[1:] == grams[:-1], np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1])), 0)


def trimmed_sides(length: int, gram: int, behind: bool):
    """Of pieces sorted by gram and side: each cut, ``behind`` the anchor or before it, to what it
    shares with a neighbour; those that are too short then go. What the first and the last of a
    partition share beyond it is not known, so they stay as they are on that side."""

    def cut(rows, best):
        for (key, _, doc_id, doc_print, start, many, piece, place), n in zip(rows, best.tolist(), strict=True):
            if behind:
                piece = piece[: place + gram + n]
                side = piece[:place][::-1]
            else:
                piece, start, place, side = piece[place - n :], start + place - n, n, None
            if len(piece) >= length:
                yield key, side, doc_id, doc_print, start, many, piece, place

    def packed(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["gram", "side", "doc_id", "doc_print", "start", "many", "piece", "place"])

    def run(batches):
        held, before = [], 1 << 30  # the last row, and what it shares with the one before it
        for batch in batches:
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if not rows:
                continue
            shared = np.r_[before, common_lengths(np.array([r[0] for r in rows]), [r[1] for r in rows])]
            best = np.minimum(np.maximum(shared[:-1], shared[1:]), [len(r[1]) for r in rows[:-1]])
            yield packed(list(cut(rows[:-1], best)))
            held, before = rows[-1:], int(shared[-1])
        if held:
            yield packed(list(cut(held, np.array([len(held[0][1])]))))

    return run


def sorted_classes(key: np.ndarray, bits: int):
    """(order, class from 1 of each place) of keys of so many bits; equal keys may stand in any
    order. Where key and place fit one integer together, that is what is sorted."""
    n = len(key)
    place_bits = max(1, (n - 1).bit_length())
    if bits + place_bits <= 64:
        packed = key.astype(np.uint64) << np.uint64(place_bits)
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        ranked = packed >> np.uint64(place_bits)
    else:
        order = np.argsort(key)
        ranked = key[order]
    new = np.ones(n, np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(new)
    return order, classes


def sort_suffixes(symbols: np.ndarray, ends: np.ndarray, length: int):
    """(order, place of each suffix in it, depth, classes): suffixes of a text of pieces, each
    closed by a 0, sorted by more than ``length`` symbols; ``classes`` are equal where the first
    ``depth`` < ``length`` symbols are. Nothing is compared beyond the end of a piece."""
    n = len(symbols)
    left = ends - np.arange(n)  # symbols from here to the end of the piece, its 0 included
    used = np.zeros(int(symbols.max()) + 1, np.int64)
    used[symbols] = 1
    used[0] = 1
    narrow = (np.cumsum(used) - 1)[symbols]  # the closing 0 stays 0
    bits = max(1, int(used.sum() - 1).bit_length())
    step = max(1, min((64 - max(1, (n - 1).bit_length())) // bits, length))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: n - k] |= np.where(left[: n - k] > k, narrow[k:], 0)
    order, classes = sorted_classes(key, step * bits)
    depth, known = step, (0, None) if step >= length else (step, classes)
    while depth <= length:
        class_bits = int(classes.max()).bit_length()
        key = classes << class_bits
        key[: n - depth] |= np.where(left[: n - depth] > depth, classes[depth:], 0)
        order, classes = sorted_classes(key, 2 * class_bits)
        depth *= 2
        if depth < length:
            known = (depth, classes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, *known


def long_groups(symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group number): suffixes of one group share at least ``length``
    symbols; the others are alone.

    ``cut[i]``: suffixes i - 1 and i of the order differ before the current prefix length. A
    prefix length below the depth of the sort is settled by its classes; from there lengths
    rise one by one: i is cut at l + 1 if, one symbol on, a cut at l lies between the two.
    """
    order, place, depth, classes = sort_suffixes(symbols, ends, length)
    n = len(order)
    cut = np.ones(n, bool)
    short = ends[order] - order <= length  # less than ``length`` symbols before the closing 0
    if depth:
        cut[1:] = classes[order[1:]] != classes[order[:-1]]
    else:
        cut[1:] = symbols[order[1:]] != symbols[order[:-1]]
        cut[1:] |= symbols[order[1:]] == 0
        depth = 1
    # a closing 0 within the depth: pieces end differently
    cut[1:] |= (ends[order] - order <= depth)[1:] | (ends[order] - order <= depth)[:-1]
    open_ = np.flatnonzero(~cut)
    u, v = place[order[open_ - 1] + 1], place[order[open_] + 1]
    low, high = np.minimum(u, v), np.maximum(u, v)
    # in a run of one preceding byte a cut extends to exactly one place; only where other
    # bytes lie between the two neighbours a range has to be looked at
    single = high - low == 1
    extends = np.full(n + 1, -1, np.int64)
    extends[high[single]] = open_[single]
    open_, low, high = open_[~single], low[~single], high[~single]
    front = np.flatnonzero(cut)
    for _ in range(length - depth):
        before = np.cumsum(cut, dtype=np.int32)
        hit = before[high] > before[low]
        next_ = extends[front]
        next_ = np.concatenate([next_[next_ >= 0], open_[hit]])
        front = next_[~cut[next_]]
        if not len(front):
            break  # no boundary spreads any more: the rest share all that follows
        cut[front] = True
        if hit.sum() * 8 > len(hit):
            open_, low, high = open_[~hit], low[~hit], high[~hit]
    cut[1:] |= short[1:] | short[:-1]
    return order, np.cumsum(cut)


SPAN_SCHEMA = "doc_id bigint, doc_print bigint, start bigint, stop bigint, h1 bigint, h2 bigint, settled boolean"


def span_batch(spans=(), alone=(), settled=()):
    """Rows of SPAN_SCHEMA: covered ranges, strings that are alone in their block, and one string
    of each kind that repeats there."""
    rows = [(*x, None, None, True) for x in spans] + [(*x, False) for x in alone] + [(None, None, None, None, *x, True) for x in settled]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = (*[pa.int64()] * 6, pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "doc_print", "start", "stop", "h1", "h2", "settled"])


def repeated_spans(pieces: list[tuple], length: int, block: bool = False):
    """(spans, alone, settled) of pieces (gram, block, doc_id, doc_print, start, many, bytes). A
    start counts if its group has another place, or a piece that occurs many times: its range is
    among the spans. Of a block, also the other strings with their hashes, and the hashes of one
    string of each group that repeats."""
    sizes = np.array([len(p[6]) + 1 for p in pieces])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"\0".join(p[6] for p in pieces) + b"\0", np.uint8)
    symbols = text.astype(np.int64) + 1
    symbols[ends - 1] = 0
    piece = np.repeat(np.arange(len(pieces)), sizes)
    order, group = long_groups(symbols, ends[piece], length)
    counts = np.bincount(group)
    live = ends[piece[order]] - order > length if block else counts[group] > 1
    order, group = order[live], group[live]
    if not len(order):
        return [], [], []
    owner = piece[order]
    start = np.array([p[4] for p in pieces], np.int64)
    many = np.array([p[5] for p in pieces], bool)
    names: dict[tuple, int] = {}
    doc = np.array([names.setdefault((p[2], p[3]), len(names)) for p in pieces], np.int64)
    at = start[owner] + order - (ends - sizes)[owner]
    # places of a group: the first one, and whether there is another
    spot = doc[owner] * (int(at.max()) + 1) + at
    least, most = np.full(len(counts), np.iinfo(np.int64).max), np.full(len(counts), -1)
    np.minimum.at(least, group, spot)
    np.maximum.at(most, group, spot)
    often = np.zeros(len(counts), bool)
    np.logical_or.at(often, group, many[owner])
    repeats = ((least < most) | often)[group]
    alone, settled = [], []
    if block:
        hashes = []
        for which in (0, 1):
            sums, inverse = prefix_hash(text, which)
            hashes.append(signed(mix((sums[order + length] - sums[order]) * inverse[order])))
        _, one = np.unique(group, return_index=True)
        first = one[repeats[one]]
        settled = list(zip(*(h[first].tolist() for h in hashes), strict=True))
        for k in one[~repeats[one]].tolist():
            p = pieces[owner[k]]
            alone.append((p[2], p[3], int(at[k]), int(at[k]) + length, int(hashes[0][k]), int(hashes[1][k])))
    good = repeats & ~many[owner]
    owner, at = owner[good], at[good]
    by = np.lexsort((at, owner))
    owner, at = owner[by], at[by]
    if not len(owner):
        return [], alone, settled
    new = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + length)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(owner)] - 1
    spans = [(pieces[p][2], pieces[p][3], s, e + length) for p, s, e in zip(owner[first].tolist(), at[first].tolist(), at[last].tolist(), strict=True)]
    return spans, alone, settled


def transform_groups(length: int):
    """Of pieces sorted by gram and block: groups of whole grams up to TEXT_BYTES, one transform
    each; a block of a gram has one of its own."""

    def run(batches):
        held, fresh, size, key = [], [], 0, None

        def closed():
            """The group that has come to its end goes to the others, or is worked on if a block."""
            nonlocal held, size
            if key is not None and key[1] >= 0:
                yield span_batch(*repeated_spans(fresh, length, True))
            elif len(fresh) > 1:
                held += fresh
                size += sum(len(p[6]) for p in fresh)
                if size > TEXT_BYTES:
                    yield span_batch(*repeated_spans(held, length))
                    held, size = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    yield from closed()
                    fresh, key = [], row[:2]
                fresh.append(row)
        yield from closed()
        if held:
            yield span_batch(*repeated_spans(held, length))

    return run


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_surroundings: int = MAX_SURROUNDINGS) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, ranges): documents as doc_id, doc_print, text; for each document with
    repeats its ranges, possibly overlapping, as ``spans``."""
    keyed = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("doc_print"), "text")
    found = materialise(keyed.mapInArrow(tidied(anchor_rows(length, gram)), ANCHOR_SCHEMA), "anchors")
    place = F.struct("doc_id", "doc_print", "pos", "before", "behind")
    around = materialise(found.groupBy("gram", "around").agg(F.count("*").alias("times"), F.min(place).alias("place")), "around")
    shared = around.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest")).where("kinds > 1 and fewest = 1")
    # equal surroundings: every place of them repeats
    often = around.where("times > 1").select("gram", "around")
    equal = found.join(often, ["gram", "around"]).select("doc_id", "doc_print", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("behind")).alias("stop"))
    # different surroundings of one anchor
    wanted = around.join(shared.select("gram", (F.col("kinds") > max_surroundings).alias("hot")), "gram").select("hot", "gram", (F.col("times") > 1).alias("many"), "place.*")
    asked = wanted.groupBy("doc_id", "doc_print").agg(F.collect_list(F.struct("gram", "pos", "before", "behind", "many", "hot")).alias("wanted"))
    same = (keyed["doc_print"] == asked["doc_print"]) & keyed["doc_id"].eqNullSafe(asked["doc_id"])
    with_text = keyed.join(asked, same).select(keyed["doc_id"], keyed["doc_print"], keyed["text"], asked["wanted"])
    pieces = materialise(with_text.mapInArrow(tidied(cut_pieces), PIECE_SCHEMA), "pieces")
    told = ("doc_id", "doc_print", "start")
    # of an anchor with very many: trimmed from both sides, equal ones settled, the rest in blocks
    hot = pieces.where("hot").select("gram", F.substring("piece", F.col("place") + gram + 1, F.lit(length)).alias("side"), *told, "many", "piece", "place")
    for behind in (True, False):
        hot = hot.repartitionByRange("gram", "side", *told).sortWithinPartitions("gram", "side", *told).mapInArrow(tidied(trimmed_sides(length, gram, behind)), SIDE_SCHEMA)
    hot = materialise(hot, "trimmed")
    kinds = materialise(hot.groupBy("gram", "place", "piece").agg(F.count("*").alias("n"), F.bool_or("many").alias("many"), F.min(F.struct(*told)).alias("one")), "kinds")
    again = hot.where("not many").join(kinds.where("n > 1 or many").select("gram", "place", "piece"), ["gram", "place", "piece"], "left_semi").select("doc_id", "doc_print", "start", (F.col("start") + F.length("piece")).alias("stop"))
    left = kinds.groupBy("gram").agg(F.count("*").alias("left")).where("left > 1").select("gram", F.ceil(F.col("left") / max_surroundings).cast("int").alias("blocks"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("piece"), F.col("blocks")).cast("int")).otherwise(-1)
    dealt = kinds.join(left, "gram").select("gram", block.alias("block"), "one.*", (F.col("many") | (F.col("n") > 1)).alias("many"), "piece")
    dealt = dealt.unionByName(pieces.where("not hot").select("gram", F.lit(-1).alias("block"), *told, "many", "piece"))
    worked = materialise(dealt.repartition("gram", "block").sortWithinPartitions("gram", "block").mapInArrow(tidied(transform_groups(length)), SPAN_SCHEMA), "worked")
    different = worked.where("h1 is null").select("doc_id", "doc_print", "start", "stop").unionByName(again)
    # strings of the blocks: one that another block has too repeats
    spot = F.struct("doc_id", "doc_print", "start")
    strings = worked.where("h1 is not null")
    twice = strings.groupBy("h1", "h2").agg(F.min(F.when(~F.col("settled"), spot)).alias("a"), F.max(F.when(~F.col("settled"), spot)).alias("b"), F.bool_or("settled").alias("m")).where("m or a <> b").select("h1", "h2")
    across = strings.where("not settled").join(twice, ["h1", "h2"], "left_semi").select("doc_id", "doc_print", "start", "stop")
    spans = equal.unionByName(different).unionByName(across)
    # neighbouring anchors cover nearly the same bytes: equal rows go before they are gathered
    ranges = spans.groupBy("doc_id", "doc_print").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    ranges = materialise(ranges, "ranges")
    discard(found, around, pieces, hot, kinds, worked)
    return keyed, ranges


REPORT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removal_rows(batches):
    for batch in batches:
        out = [[] for _ in range(4)]
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode()
            merged = merge_spans((s["start"], s["stop"]) for s in spans.as_py() or ())
            kept, at = [], 0
            for s, e in merged:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            for k, v in enumerate((len(raw), sum(e - s for s, e in merged), len(merged), hashlib.sha256(b"".join(kept)).hexdigest())):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_surroundings: int = MAX_SURROUNDINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document: each byte inside a
    ``length``-byte string that starts anywhere else is removed, judged on the input.

    Null texts count as empty; texts shorter than ``length`` keep all; repeated rows repeat each
    other; overlapping repeats count; an empty table gives no rows; other columns are ignored.
    """
    keyed, ranges = repeated_ranges(docs, length, gram, max_surroundings)
    same = (keyed["doc_print"] == ranges["doc_print"]) & keyed["doc_id"].eqNullSafe(ranges["doc_id"])
    joined = keyed.join(ranges, same, "left").select(keyed["doc_id"], keyed["text"], ranges["spans"])
    return joined.mapInArrow(tidied(removal_rows), REPORT_SCHEMA)
