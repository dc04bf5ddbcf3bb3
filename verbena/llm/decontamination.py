"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed block by block: every task turns its documents into
posting lists (term -> word positions, sorted) and stores them in the shared folder. The
index is partitioned by document, so building it moves no row between machines and a very
common term is spread over all blocks. A query set of word sequences is then matched
against every block: the rarest term of a sequence *in that block* gives the first
candidate positions, which are intersected with the offset-adjusted lists of the other
terms from rare to frequent; most sequences end at the first missing term.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import ALNUM, LOWER, discard, doc_chunks, materialise, only, signed, small_batches, split_words, text_buffers, tidied

BLOCK_SCHEMA = "doc_ids array<bigint>, n_words array<int>, terms binary, starts binary, postings binary"
MATCH_SCHEMA = "block bigint, ord int, spans array<int>, items array<string>"
WINDOW_SCHEMA = "window array<bigint>, item_id string"
#: Text bytes that make one block of the index.
BLOCK_BYTES = 1 << 20
#: Windows that one pass over the index takes along, about (80 bytes each at ten words); a larger
#: query set is matched in several passes whose matches are merged.
PASS_WINDOWS = 400_000
#: Contaminated rows up to this number are broadcast (8 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def build_block(data: np.ndarray, offsets: np.ndarray):
    """Posting lists of some documents: (words per document, distinct terms, list starts,
    positions). Positions are word ordinals that run through the whole block."""
    docs, _, _, terms = split_words(LOWER[data], offsets, ALNUM)
    n_words = np.bincount(docs, minlength=len(offsets) - 1).astype(np.int32)
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    return n_words, ranked[head], np.r_[head, len(ranked)].astype(np.uint32), order.astype(np.uint32)


def index_batches(batches):
    for batch in batches:
        ids = batch.column(0)
        data, offsets = text_buffers(batch.column(1))
        for i, j in doc_chunks(offsets, BLOCK_BYTES):
            part = offsets[i : j + 1]
            n_words, terms, starts, postings = build_block(data[part[0] : part[-1]], part - part[0])
            own = ids.slice(i, j - i)
            # gaps between neighbouring positions compress better than positions
            gaps = np.diff(postings, prepend=np.uint32(0)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int32()))]
                + [pa.array([x.tobytes()], pa.binary()) for x in (terms, starts, gaps)],
                names=["doc_ids", "n_words", "terms", "starts", "postings"],
            )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the positional index of ``docs`` and return its table, a row for each block with a
    number of its own (equal blocks stay apart).

    Null texts count as empty, documents with equal ids are separate, an empty table gives
    an empty index, and columns other than the two named are ignored.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(tidied(index_batches), BLOCK_SCHEMA).select(F.monotonically_increasing_id().alias("block"), "*"), "postings")


class Block:
    """One block of the index, opened for searching."""

    def __init__(self, n_words, terms, starts, postings):
        self.terms, self.starts = np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.uint32).astype(np.int64)
        self.postings = np.cumsum(np.frombuffer(postings, np.uint32), dtype=np.uint32).astype(np.int64)
        self.first = np.r_[0, np.cumsum(n_words)].astype(np.int64)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Index of each word among the block's terms, -1 where it has none."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term] : self.starts[term + 1]]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after the other in one document."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        order = np.argsort(sizes, kind="stable")
        found = self.positions(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            own = self.positions(terms[k])
            at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
            found = found[own[at] == found + k]
        found = found[found >= 0]
        return found[self.document(found) == self.document(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most ``slop`` words
        away in the same document."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        order = np.argsort(sizes, kind="stable")
        found = self.positions(terms[order[0]])
        doc = self.document(found)
        low, high = np.maximum(found - slop, self.first[doc]), np.minimum(found + slop, self.first[doc + 1] - 1)
        for k in order[1:]:
            own = self.positions(terms[k])
            fits = np.searchsorted(own, low) < np.searchsorted(own, high, "right")
            found, low, high = found[fits], low[fits], high[fits]
        return found


def matcher(shared, slop):
    """A function for mapInArrow: the documents of each block of the index that any window hits,
    with all their matches.

    ``shared``: {length: uint64 matrix of windows} and {length: list of item lists}."""

    def match(batches):
        windows, items = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n_words = np.asarray(row["n_words"], np.int64)
                block = Block(n_words, row["terms"], row["starts"], row["postings"])
                spans: dict[int, list[int]] = {}
                found: dict[int, set[str]] = {}
                for size, matrix in windows.items():
                    at = block.lookup(matrix)
                    for w in np.flatnonzero((at >= 0).all(axis=1)):
                        hits = block.phrase(at[w]) if slop is None else block.near(at[w], slop)
                        width = size if slop is None else 1
                        for d, p in zip(block.document(hits).tolist(), hits.tolist(), strict=True):
                            p -= int(block.first[d])
                            spans.setdefault(d, []).extend((p, p + width))
                            found.setdefault(d, set()).update(items[size][w])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(spans), pa.int64()), pa.array(list(spans), pa.int32()), pa.array(list(spans.values()), pa.list_(pa.int32())), pa.array([sorted(found[d]) for d in spans], pa.list_(pa.string()))],
                    names=["block", "ord", "spans", "items"],
                )

    return match


def item_windows(text: str | None, size: int | None) -> list[tuple[int, ...]]:
    """Windows of ``size`` consecutive words of an item; a shorter one is a window itself."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = signed(split_words(LOWER[raw], np.array([0, len(raw)]), ALNUM)[3]).tolist()
    if size is None or len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def window_rows(size: int | None):
    """The windows of the items of a batch."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(dict.fromkeys(item_windows(text, size)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64())), pa.array([item] * len(own), pa.string())], names=["window", "item_id"])

    return run


def query_passes(items: DataFrame, size: int | None):
    """The query set in parts of about PASS_WINDOWS: ({length: windows}, {length: item lists}). The
    windows are a table; the driver holds one part at a time."""
    rows = items.mapInArrow(tidied(window_rows(size)), WINDOW_SCHEMA).groupBy("window").agg(F.collect_set("item_id").alias("items"))
    rows = materialise(rows, "windows")
    passes = max(1, -(-rows.count() // PASS_WINDOWS))
    for turn in range(passes):
        part = rows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == turn).toPandas()
        by_size = {int(n): own for n, own in part.groupby(part["window"].map(len).astype(int))}
        yield {n: np.stack(own["window"].to_numpy()).astype(np.int64).view(np.uint64) for n, own in by_size.items()}, {n: [sorted(x) for x in own["items"]] for n, own in by_size.items()}
    discard(rows)


def search(index: DataFrame, items: DataFrame, size: int | None = 10, slop: int | None = None) -> DataFrame:
    """Match every item (item_id string, text) against the index: exact windows of ``size``
    words, or with ``slop`` all words of a window near each other. One row for each document that
    has a match: block, ord, spans (flat start/end word positions), items (sorted)."""
    context = index.sparkSession.sparkContext
    found = []
    for part in query_passes(items, size):
        shared = context.broadcast(part)
        found.append(materialise(index.mapInArrow(tidied(matcher(shared, slop)), MATCH_SCHEMA), "matches"))
        shared.destroy()
    if len(found) == 1:
        return found[0]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("block", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def covered(spans: np.ndarray) -> int:
    """Positions covered by flat start/end pairs."""
    if not len(spans):
        return 0
    low, high = spans[0::2], spans[1::2]
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    before = np.r_[low[0], high[:-1]]
    return int(np.maximum(high - np.maximum(low, before), 0).sum())


def report_batches(batches):
    for batch in batches:
        rows = batch.to_pydict()
        rows["items"] = [x or [] for x in rows["items"]]
        hits = [covered(np.asarray(s or [], np.int64)) for s in rows["spans"]]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in rows["items"]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in rows["items"]], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hits])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


REPORT_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def decontamination_report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row for each document: its words, the words inside any occurrence of a benchmark
    window, the number and digest of the items hit, and whether it is contaminated.

    Null and empty texts have no words and are clean; an item without words matches nothing;
    an item without an id still marks words but is not counted; items that share an id count
    once; repeated documents are reported each; empty tables give empty or clean reports.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    index = build_index(only(docs, "doc_id", "text"))
    found = search(index, items, size)
    every = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ord", "x"))
    every = every.select("block", "ord", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").cast("bigint").alias("n_words"))
    return every.join(found, ["block", "ord"], "left").select("doc_id", "n_words", "spans", "items").mapInArrow(tidied(report_batches), REPORT_SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; clean rows stay untouched, and
    so do rows whose text is null or empty. A row is known by a hash of its id and text."""
    row = F.xxhash64("doc_id", "text")
    index = build_index(docs.select(row.alias("doc_id"), "text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = search(index, items, size)
    hit = found.join(index.select("block", F.posexplode("doc_ids").alias("ord", "row")), ["block", "ord"]).select("row").distinct()
    hit = materialise(hit, "contaminated")
    discard(index)
    if hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    return docs.join(hit, row == hit["row"], "left_anti")
