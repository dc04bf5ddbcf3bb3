"""Brown class-based bigram language model.

Word counts cover the whole training part of the corpus. The most frequent words are put into
classes by exchange clustering on their bigram counts. Every other word of the training part
then goes to the class that its neighbours make most likely: one of those learnt, or the class
of its spelling, which is also where unseen words belong. A token costs its class transition
(bigram smoothed by the class share) and its emission from the class.

Counts and classes of the most frequent words fit a table of bounded size that every task holds;
the rest stay distributed, and the rare tokens of all documents are joined with them. What the
driver sends to the tasks is plain arrays: the executors need not have this package.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import LOWER, NONSPACE, discard, doc_chunks, materialise, signed, small_batches, split_words, text_buffers, tidied

#: Words that sequential exchange moves first, the classes it moves them between, and its sweeps.
CLUSTERED, CLASSES, SWEEPS = 1_000, 48, 6
#: Words whose counts every task holds (12 bytes each).
HELD_WORDS = 1 << 18
#: Weight of the class shares in the transition probabilities.
PRIOR = 20.0
CHUNK_BYTES = 2 << 20
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
#: Context entries that are weighed against all learnt classes at once (a word is never split).
ENTRIES = 1 << 14

# The last byte of a word (sentence marks, clause marks, other ASCII punctuation)
# and the lead bytes of its letters (two bytes up to Latin, other two bytes, three, four).
ENDINGS = {**dict.fromkeys(b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~", 3), **dict.fromkeys(b".!?", 1), **dict.fromkeys(b",;:", 2)}
LEADS = ((0xC2, 0xC9), (0xCA, 0xDF), (0xE0, 0xEF), (0xF0, 0xFF))
#: ending x script x length x digit
SURFACE = 4 * 5 * 4 * 2

_ENDING = np.zeros(256, np.int64)
_ENDING[list(ENDINGS)] = list(ENDINGS.values())
#: Bit 0: a digit; bits 1 to 4: a lead byte of each range.
_FLAGS = np.zeros(256, np.uint8)
_FLAGS[48:58] = 1
for _k, (_low, _high) in enumerate(LEADS, 1):
    _FLAGS[_low : _high + 1] = 1 << _k
#: The highest script among the flags.
_SCRIPT = np.array([(x >> 1).bit_length() for x in range(32)], np.int64)


def surface_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Surface class of each word: its ending, the script of its letters, length and digits."""
    if not len(starts):
        return np.zeros(0, np.int64)
    edges = np.stack([starts, ends], 1).ravel()
    flags = np.bitwise_or.reduceat(np.r_[_FLAGS[data], np.uint8(0)], edges)[::2]
    size = np.digitize(ends - starts, (4, 7, 11))
    return ((_ENDING[data[ends - 1]] * 5 + _SCRIPT[flags]) * 4 + size) * 2 + (flags & 1)


def chunks(batch: pa.RecordBatch):
    """(first row, last row, documents, word hashes, surface classes) of parts of a batch whose
    second column is the text."""
    data, offsets = text_buffers(batch.column(1))
    for i, j in doc_chunks(offsets, CHUNK_BYTES):
        part = offsets[i : j + 1]
        raw = LOWER[data[part[0] : part[-1]]]
        docs, starts, ends, words = split_words(raw, part - part[0], NONSPACE)
        yield i, j, docs, words, surface_classes(raw, starts, ends)


def count_words(batches):
    """(word, surface class, count) over the training documents that a task reads."""
    held, size = [], 0

    def flush():
        words, classes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        names, first, at = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(names)).astype(np.int64)
        return names, classes[first], total

    def packed(names, classes, total):
        for s in range(0, len(names), 100_000):
            e = s + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(signed(names[s:e])), pa.array(classes[s:e].astype(np.int32)), pa.array(total[s:e])], names=["word", "surface", "c"])

    for batch in batches:
        train = batch.column(2).to_numpy(zero_copy_only=False)
        for i, j, docs, words, classes in chunks(batch):
            mine = train[i:j][docs] if len(docs) else np.zeros(0, bool)
            names, first, counts = np.unique(words[mine], return_index=True, return_counts=True)
            held.append((names, classes[mine][first], counts.astype(np.int64)))
            size += len(names)
            if size > 4 * FLUSH:
                merged = flush()
                held = [merged]
                size = len(merged[0])
                if size > FLUSH:
                    yield from packed(*merged)
                    held, size = [], 0
    if held:
        yield from packed(*flush())


class Vocabulary:
    """The most frequent words: sorted hashes, counts, and category ids for all tokens.

    Categories: clustered words 0..n-1, then the surface classes, then the document end."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, category: np.ndarray):
        self.words, self.counts, self.category = words, counts, category
        self.n = int((category >= 0).sum())
        self.end = self.n + SURFACE

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, clustered: np.ndarray) -> Vocabulary:
        """Of distinct words in any order; ``clustered``: those that exchange moves, among them."""
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        category = np.full(len(words), -1, np.int32)
        category[np.searchsorted(words, clustered)] = np.arange(len(clustered), dtype=np.int32)
        return cls(words, counts, category)

    def state(self) -> tuple:
        return self.words, self.counts, self.category

    def lookup(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def sequence(self, docs: np.ndarray, n_docs: int, at: np.ndarray, surface: np.ndarray):
        """Categories of all tokens with a document end behind each document, and the
        documents and the places of the words among them."""
        category = np.where(at >= 0, self.category[at] if len(self.category) else -1, -1)
        category = np.where(category >= 0, category, self.n + surface)
        place = np.arange(len(docs)) + docs
        out = np.full(len(docs) + n_docs, self.end, np.int64)
        out[place] = category
        of = np.repeat(np.arange(n_docs), np.bincount(docs, minlength=n_docs) + 1)
        return out, of, place


def bigram_counter(shared, slice_rows: int):
    def count(batches):
        vocabulary = Vocabulary(*shared.value)
        size = vocabulary.end + 1
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, docs, words, surface in chunks(batch):
                tokens, of, _ = vocabulary.sequence(docs, j - i, vocabulary.lookup(words), surface)
                before = np.r_[vocabulary.end, tokens[:-1]]
                mine = train[i:j][of] if len(of) else np.zeros(0, bool)
                pairs, counts = np.unique((before * size + tokens)[mine], return_counts=True)
                table[pairs] += counts
        for k in range(0, size, slice_rows):
            part = table[k * size : (k + slice_rows) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    return count


def add_tables(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.int64)
            held[k] = held[k] + part if k in held else part
    for k, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def bigrams(rows: DataFrame, shared, vocabulary: Vocabulary) -> np.ndarray:
    """Counts of category pairs over all training documents; the table's size depends on the
    parameters alone."""
    size, slice_rows = vocabulary.end + 1, 16
    schema = "slice int, counts binary"
    sums = rows.mapInArrow(tidied(bigram_counter(shared, slice_rows)), schema).repartition("slice").mapInArrow(tidied(add_tables), schema)
    table = np.zeros((size, size), np.int64)
    for row in sums.collect():
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int64).reshape(-1, size)
        table[row["slice"] : row["slice"] + len(part)] = part
    return table


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(table: np.ndarray, n: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each category: the first ``n`` are moved, one at a time, to the class that
    raises the likelihood of the class bigrams most; the others keep a class of their own."""
    size = len(table)
    classes = max(1, min(classes, n)) if n else 0
    of = np.r_[np.arange(n) % max(classes, 1), classes + np.arange(size - n)].astype(np.int64)
    k = classes + size - n
    table = table.astype(float)
    by_row = np.zeros((k, size))
    np.add.at(by_row, of, table)
    joint = np.zeros((k, k))
    np.add.at(joint.T, of, by_row.T)
    order = np.argsort(-(table.sum(0)[:n]), kind="stable")
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            row = np.bincount(of, weights=table[w], minlength=k)
            column = np.bincount(of, weights=table[:, w], minlength=k)
            loop = table[w, w]
            old = of[w]
            row[old] -= loop
            column[old] -= loop
            if not row.any() and not column.any() and not loop:
                continue
            joint[old] -= row
            joint[:, old] -= column
            joint[old, old] -= loop
            rows, columns = joint.sum(1), joint.sum(0)
            head = joint[:classes]
            side = joint[:, :classes]
            gain = (entropy(head + row) - entropy(head)).sum(1) + (entropy(side + column[:, None]) - entropy(side)).sum(0)
            c = np.arange(classes)
            own = joint[c, c]
            gain += entropy(own + row[c] + column[c] + loop) - entropy(own + row[c]) - entropy(own + column[c]) + entropy(own)
            gain -= entropy(rows[c] + row.sum() + loop) - entropy(rows[c]) + entropy(columns[c] + column.sum() + loop) - entropy(columns[c])
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            moved += new != old
            of[w] = new
            joint[new] += row
            joint[:, new] += column
            joint[new, new] += loop
        if not moved:
            break
    return of


class ClassModel:
    """Transition and emission logarithms (base 10) between classes: the learnt ones, then a
    spelling class for each surface, then the document end. ``mass`` has tokens plus types of the
    words in a class, and 1; an emission still lacks log10(c + 1) of the word."""

    def __init__(self, joint: np.ndarray, learnt: int, mass: np.ndarray):
        self.joint, self.learnt, self.k, self.mass = joint.astype(float), learnt, len(joint), mass
        share = (joint.sum(0) + 1) / (joint.sum() + self.k)
        self.prior = PRIOR * share
        self.leave = joint.sum(1) + PRIOR
        self.move = np.log10((joint + self.prior) / self.leave[:, None])
        self.emit = -np.log10(self.mass)
        self.emit[-1] = 0.0


def class_mass(k: int, sums: dict[int, tuple[int, int]]) -> np.ndarray:
    """Of (tokens, types) by class."""
    return np.array([sum(sums.get(c, (0, 0))) + 1.0 for c in range(k)])


def context_counter(shared):
    """(word, surface, contexts) of the words that have no learnt class yet: a context is the
    class of a neighbour (behind: plus the number of classes) and its count, in one integer."""

    def count(batches):
        *state, of = shared.value
        vocabulary = Vocabulary(*state)
        k, n = int(of.max()) + 1, vocabulary.n
        held, size = [], 0

        def flush():
            words, surface, codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((codes, words))
            words, surface, codes, counts = words[order], surface[order], codes[order], counts[order]
            new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (codes[1:] != codes[:-1])])
            return words[new], surface[new], codes[new], np.add.reduceat(counts, new)

        def packed(words, surface, codes, counts):
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            edge = np.r_[first, len(words)]
            entries = codes | counts << 16
            for s in range(0, len(first), 50_000):
                e = min(s + 50_000, len(first))
                at = (8 * (edge[s : e + 1] - edge[s])).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(entries[edge[s] : edge[e]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(signed(words[first[s:e]])), pa.array(surface[first[s:e]].astype(np.int32)), data], names=["word", "surface", "contexts"])

        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, docs, words, surface in chunks(batch):
                tokens, _, place = vocabulary.sequence(docs, j - i, vocabulary.lookup(words), surface)
                mine = np.flatnonzero(train[i:j][docs] & (tokens[place] >= n)) if len(docs) else np.zeros(0, np.int64)
                if not len(mine):
                    continue
                classes, place = of[tokens], place[mine]
                # the place before the first token is the last one, a document end
                codes = np.r_[classes[place - 1], k + classes[place + 1]]
                held.append((np.tile(words[mine], 2), np.tile(surface[mine], 2), codes, np.ones(len(codes), np.int64)))
                size += len(codes)
                if size > 3 * FLUSH:
                    merged = flush()
                    held, size = [merged], len(merged[0])
                    if size > FLUSH:
                        yield from packed(*merged)
                        held, size = [], 0
        if held:
            yield from packed(*flush())

    return count


def chooser(shared):
    """(word, class, c): each word, read in sorted order, goes to the class under which its
    tokens and their neighbours are most likely, the learnt classes or its spelling class
    (whose counts are taken without the word's own). It leaves the spelling class if it gains
    more than it takes to name one class of so many; else a word seen once fits any too well."""

    def choose(words, surface, sizes, entries, model):
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        index = np.repeat(np.cumsum(np.r_[False, words[1:] != words[:-1]]), sizes)
        k, learnt = model.k, model.learnt
        keys, inverse = np.unique(index * (2 * k) + (entries & 0xFFFF), return_inverse=True)
        times = np.bincount(inverse, weights=entries >> 16)
        index, code = keys // (2 * k), keys % (2 * k)
        before = code < k
        c = np.bincount(index, weights=times * before, minlength=len(first))
        own = learnt + surface[first].astype(np.int64)
        s, other = own[index], code % k
        pair = np.where(before, model.joint[other, s], model.joint[s, other])
        behind = np.where(before, model.prior[s], model.prior[other])
        leave = np.where(before, model.leave[other], model.leave[s] - c[index])
        stay = np.bincount(index, weights=times * np.log10((np.maximum(pair - times, 0) + behind) / leave), minlength=len(first))
        stay -= c * np.log10(np.maximum(model.mass[own] - c, 1))
        chosen = own
        if learnt:
            table = np.r_[model.move[:, :learnt], model.move[:learnt].T]
            start = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
            gain = np.add.reduceat(times[:, None] * table[code], start, axis=0) + c[:, None] * model.emit[:learnt]
            best = gain.argmax(1)
            chosen = np.where(gain[np.arange(len(best)), best] > stay + math.log10(learnt + 1), best, own)
        return pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(chosen.astype(np.int32)), pa.array(c.astype(np.int64))], names=["word", "class", "c"])

    def merged(words, surface, sizes, entries):
        """The rows of one word as one row: no more entries than there are contexts."""
        codes, inverse = np.unique(entries & 0xFFFF, return_inverse=True)
        times = np.bincount(inverse, weights=entries >> 16, minlength=len(codes)).astype(np.int64)
        return words[:1], surface[:1], np.array([len(codes)], np.int64), codes | times << 16

    def run(batches):
        model = ClassModel(*shared.value)
        kept = None  # the last word, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            words, surface = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            part = (words, surface, np.array([len(x) // 8 for x in raw], np.int64), np.frombuffer(b"".join(raw), np.int64))
            if kept is not None:
                part = tuple(np.concatenate(x) for x in zip(kept, part, strict=True))
            words, surface, sizes, entries = part
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            at = np.r_[0, np.cumsum(sizes)][first]
            # whole words, all but the last one
            for i, j in doc_chunks(at, ENTRIES):
                s, e = first[i], first[j]
                yield choose(words[s:e], surface[s:e], sizes[s:e], entries[at[i] : at[j]], model)
            s = first[-1]
            kept = merged(words[s:], surface[s:], sizes[s:], entries[at[-1] :])
        if kept is not None:
            yield choose(*kept, model)

    return run


def frequent(counts: DataFrame) -> Column:
    """Whether a word is among the most frequent ones, about HELD_WORDS at most: those above a step of a logarithmic
    scale, found from the number of words at each step (so tasks send on only what is held), and
    of the step in which the bound lies a share by hash."""
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    total, least, share = 0, 0, 1.0
    for s in sorted(steps, reverse=True):
        least = s
        if total + steps[s] > HELD_WORDS:
            share = (HELD_WORDS - total) / steps[s]
            break
        total += steps[s]
    cut = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    return (step > least) | ((step == least) & cut)


def clustered(counts: DataFrame) -> DataFrame:
    """The CLUSTERED most frequent words, ties by hash."""
    return counts.orderBy(F.desc("c"), "word").limit(CLUSTERED).select("word", "c")


SEQUENCE_SCHEMA = "row_key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, own double, classes binary, places array<int>, rare array<bigint>"
FILLED_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, own double, classes binary"


def sequencer(shared):
    """The class of every token of a document (two bytes each), as far as the held words tell:
    other words have their spelling class for now and are listed with their places."""

    def sequence(batches):
        *state, classes, learnt = shared.value
        vocabulary = Vocabulary(*state)
        for batch in batches:
            out = [[] for _ in range(6)]
            for i, j, docs, words, surface in chunks(batch):
                n_docs = j - i
                at = vocabulary.lookup(words)
                known = at >= 0
                c = np.where(known, vocabulary.counts[at] if len(classes) else 0, 0)
                of = np.where(known, classes[at] if len(classes) else 0, learnt + surface).astype(np.uint16)
                out[0].append(np.bincount(docs, minlength=n_docs))
                out[1].append(np.bincount(docs, weights=known, minlength=n_docs).astype(np.int64))
                out[2].append(np.bincount(docs, weights=np.log10(c + 1.0), minlength=n_docs))
                edge = np.searchsorted(docs, np.arange(n_docs + 1))
                for d in range(n_docs):
                    s, e = edge[d], edge[d + 1]
                    rare = np.flatnonzero(~known[s:e])
                    out[3].append(of[s:e].tobytes())
                    out[4].append(rare.astype(np.int32))
                    out[5].append(signed(words[s:e][rare]))
            if not out[0]:
                continue
            keys = np.frombuffer(os.urandom(8 * batch.num_rows), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0), pa.array(~batch.column(2).to_numpy(zero_copy_only=False))]
                + [pa.array(np.concatenate(x)) for x in out[:3]]
                + [pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "held_out", "n_tokens", "n_known", "own", "classes", "places", "rare"],
            )

    return sequence


def fill(batches):
    """Put the joined classes of rare words in their places."""
    for batch in batches:
        classes = batch.column(5).to_pylist()
        for row, (at, of) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
            if at:
                own = np.frombuffer(classes[row], np.uint16).copy()
                own[at] = of
                classes[row] = own.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(classes, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "own", "classes"])


def with_ends(column: pa.Array, end: int):
    """(document, class before, class) of all tokens of a batch and the document ends."""
    rows = [np.frombuffer(x, np.uint16) for x in column.to_pylist()]
    of = np.repeat(np.arange(len(rows)), [len(x) + 1 for x in rows])
    tail = np.array([end], np.uint16)
    tokens = np.concatenate([x for row in rows for x in (row, tail)]).astype(np.int64) if rows else np.zeros(0, np.int64)
    return of, np.r_[end, tokens[:-1]][: len(tokens)], tokens


def class_pairs(k: int):
    def count(batches):
        table = np.zeros(k * k, np.int64)
        for batch in batches:
            _, before, tokens = with_ends(batch.column(0), k - 1)
            table += np.bincount(before * k + tokens, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    return count


def class_bigrams(filled: DataFrame, k: int) -> np.ndarray:
    """Counts of class pairs over all training documents."""
    schema = "slice int, counts binary"
    sums = filled.where("not held_out").select("classes").mapInArrow(tidied(class_pairs(k)), schema).coalesce(1).mapInArrow(tidied(add_tables), schema).collect()
    return sum((np.frombuffer(zlib.decompress(r["counts"]), np.int64).reshape(k, k) for r in sums), np.zeros((k, k), np.int64))


def scorer(shared, divisor: float, end_count: int):
    def score(batches):
        model = ClassModel(*shared.value)
        for batch in batches:
            of, before, tokens = with_ends(batch.column(5), model.k - 1)
            own, words = batch.column(4).to_numpy(), batch.column(2).to_numpy()
            log = np.bincount(of, weights=model.move[before, tokens] + model.emit[tokens], minlength=batch.num_rows)
            base = own + math.log10(end_count + 1.0) - (words + 1) * divisor
            known = batch.column(3).to_numpy() + int(end_count > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words + 1), pa.array(known), pa.array(base), pa.array(own + log)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


class Trained:
    """What training gives: ``words`` (word, class, c) of the whole training part, distributed;
    its most frequent words with their classes as arrays; tokens and types of every class."""

    def __init__(self, words, vocabulary, classes, learnt, k, mass, tokens, types, ends, scratch=()):
        self.scratch = scratch  # the tables that ``words`` reads
        self.words, self.vocabulary, self.classes, self.learnt, self.k = words, vocabulary, classes, learnt, k
        self.mass, self.tokens, self.types, self.ends = mass, tokens, types, ends


def training_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and whether the row is learnt from."""
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))


def train(rows: DataFrame) -> Trained:
    """Counts, classes and class sizes of the training part of (doc_id, text, train)."""
    spark = rows.sparkSession
    context = spark.sparkContext
    schema = "word bigint, surface int, c bigint"
    counts = materialise(rows.mapInArrow(tidied(count_words), schema).groupBy("word").agg(F.min("surface").alias("surface"), F.sum("c").alias("c")), "words")
    ends = rows.where("train").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, types = sums["n"] + ends, sums["v"] + (ends > 0)
    top = clustered(counts).toPandas()
    seeds = top["word"].to_numpy(np.int64).view(np.uint64)
    often = frequent(counts)
    held = counts.where(often).select("word", "c").toPandas()
    both = {**dict(zip(held["word"].tolist(), held["c"].tolist(), strict=True)), **dict(zip(top["word"].tolist(), top["c"].tolist(), strict=True))}
    vocabulary = Vocabulary.of(np.array(list(both), np.int64).view(np.uint64), np.array(list(both.values()), np.int64), seeds)
    table = bigrams(rows, context.broadcast(vocabulary.state()), vocabulary)
    of = exchange(table, vocabulary.n)
    learnt = int(of[: vocabulary.n].max()) + 1 if vocabulary.n else 0
    k = int(of.max()) + 1
    joint = np.zeros((k, k))
    np.add.at(joint, (of[:, None], of[None, :]), table)
    # tokens and types of the classes, the words beyond the clustered ones being in their spelling classes
    top_class, top_count = of[: len(seeds)].astype(np.int64), top["c"].to_numpy(np.int64)
    placed = spark.createDataFrame([(w, c, n) for w, c, n in zip(top["word"].tolist(), top_class.tolist(), top_count.tolist(), strict=True)], "word bigint, class int, c bigint")
    rest = counts.join(F.broadcast(placed.select("word")), "word", "left_anti").groupBy("surface").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    sums = {c: (int(top_count[top_class == c].sum()), int((top_class == c).sum())) for c in range(learnt)}
    sums |= {learnt + r["surface"]: (r["n"], r["v"]) for r in rest}
    # every other word of the training part chooses its class by its neighbours
    first = context.broadcast((*vocabulary.state(), of))
    begun = context.broadcast((joint, learnt, class_mass(k, sums)))
    contexts = rows.mapInArrow(tidied(context_counter(first)), "word bigint, surface int, contexts binary").repartition("word").sortWithinPartitions("word")
    chosen = materialise(contexts.mapInArrow(tidied(chooser(begun)), "word bigint, class int, c bigint"), "classes")
    words = chosen.unionByName(placed)
    sums = {r["class"]: (r["n"], r["v"]) for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    found = chosen.where(often).select("word", "class").toPandas()
    classes = np.zeros(len(vocabulary.words), np.uint16)
    classes[vocabulary.lookup(found["word"].to_numpy(np.int64).view(np.uint64))] = found["class"].to_numpy()
    classes[vocabulary.lookup(seeds)] = top_class
    discard(counts)
    return Trained(words, vocabulary, classes, learnt, k, class_mass(k, sums), tokens, types, ends, (chosen,))


def sequenced(rows: DataFrame, trained: Trained) -> DataFrame:
    """The class of every token of every row, with its word counts."""
    shared = rows.sparkSession.sparkContext.broadcast((*trained.vocabulary.state(), trained.classes, trained.learnt))
    sequences = materialise(rows.mapInArrow(tidied(sequencer(shared)), SEQUENCE_SCHEMA), "sequences")
    rare = sequences.select("row_key", F.explode(F.arrays_zip("places", "rare")).alias("x")).select("row_key", F.col("x.places").alias("place"), F.col("x.rare").alias("word"))
    rare = rare.join(trained.words, "word").groupBy("row_key").agg(F.collect_list(F.struct("place", "class")).alias("x"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("more"), F.count("*").alias("seen"))
    joined = sequences.drop("places", "rare").join(rare, "row_key", "left")
    joined = joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("own"), "classes", F.col("x.place").alias("places"), F.col("x.class").alias("found"))
    filled = materialise(joined.mapInArrow(tidied(fill), FILLED_SCHEMA), "filled")
    discard(sequences)
    return filled


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and
    perplexity (of a token, by the score) of every whole text.

    Null and empty texts are one document end; rows without doc_id take part in training;
    repeated rows count each; with no training text every word is unknown; an empty table
    gives no rows; other columns are ignored.
    """
    rows = training_rows(docs)
    trained = train(rows)
    filled = sequenced(rows, trained)
    discard(*trained.scratch)
    model = docs.sparkSession.sparkContext.broadcast((class_bigrams(filled, trained.k), trained.learnt, trained.mass))
    divisor = math.log10(trained.tokens + trained.types + 1)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = filled.mapInArrow(tidied(scorer(model, divisor, trained.ends)), schema)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
