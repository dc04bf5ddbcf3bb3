"""SentencePiece models on the tokenizers library.

The model file is read field by field (it is a protocol buffer), and its normaliser, white
space marker, scores and byte fallback are rebuilt as a ``tokenizers.Tokenizer``. Batches are
encoded by the library's threads; parity with the original library is verified.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import process_store, small_batches, tidied

MARK = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that go to the tokenizer at once.
BATCH_CHARS = 1 << 19


def fields(data: bytes):
    """(field number, value) of a protocol buffer message: ints, floats as 4 raw bytes, bytes."""
    i = 0

    def varint(i):
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """pieces [(text, score, type)], kind (1 unigram, 2 BPE), byte_fallback, and the
    normaliser's charsmap, dummy_prefix, squeeze and escape."""
    model = {"pieces": [], "kind": 1, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            model |= {"kind": spec.get(3, 1), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    model["unk_id"] = next((i for i, p in enumerate(model["pieces"]) if p[2] == UNKNOWN), 0)
    return model


def bpe_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges of a BPE model by falling score of what they make: every split of a piece into
    two pieces."""
    score = {p: s for p, s, t in pieces if t in (NORMAL, USER, UNUSED)}
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    merges = [(-s, rank[p], rank[p[:i]], p[:i], p[i:]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    return [(a, b) for *_, a, b in sorted(merges)]


def rebuild(data: bytes, cache: int = 10_000):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model file says; ``cache``:
    words that its BPE model keeps."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse_model(data)
    pieces = model["pieces"]
    if model["suffix"] or not model["escape"]:
        raise ValueError("white space as suffix or without marker is not supported")
    if model["kind"] == 2:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=bpe_merges(pieces), unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"], cache_capacity=cache)
    elif model["kind"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk_id"], byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model kind {model['kind']} is not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # Where no piece has a marker behind another character, no merge crosses the start of a
    # word, and words can be encoded (and cached) one by one.
    if model["kind"] == 2 and not any(MARK in p.lstrip(MARK) for p, _, t in pieces if t in (NORMAL, USER)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    user = [AddedToken(p, normalized=False) for p, _, t in pieces if t == USER]
    if user:
        tokenizer.add_tokens(user)
    ends = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


def once(name: str, key, make):
    """What ``make`` gives, kept for the last two keys in this process."""
    store = process_store(name)
    if key not in store:
        while len(store) > 1:
            store.pop(next(iter(store)))
        store[key] = make()
    return store[key]


def loaded(data: bytes):
    return once("rebuilt", data, lambda: rebuild(data))


def original(data: bytes):
    import sentencepiece

    return once("original", data, lambda: sentencepiece.SentencePieceProcessor(model_proto=data))


def text_groups(texts: list[str], limit: int = BATCH_CHARS):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


#: A control character that separates words handed over together; it is a token of its own.
SEPARATOR = "\x01"
#: Words whose ids a worker keeps; then it starts anew.
KEPT_WORDS = 450_000
#: Words handed to the tokenizer as one string.
JOINED_WORDS = 2_000


def separable(model: dict) -> bool:
    """No piece has a marker behind another character and the normaliser changes nothing:
    then no token crosses the start of a word, and a text is encoded word by word."""
    pieces = model["pieces"]
    inner = any(MARK in p.lstrip(MARK) or (SEPARATOR in p and p != SEPARATOR) for p, _, t in pieces if t in (NORMAL, USER, UNUSED))
    return bool(not inner and not model["charsmap"] and not model["squeeze"] and model["dummy_prefix"] and model["byte_fallback"] and not any(t == USER for *_, t in pieces))


class Numbers(dict):
    """Numbers words as they are looked up; ``fresh`` has the new ones in order."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """Encodes texts through their distinct words, which are encoded once and kept.

    New words are joined by a separator and encoded as a multithreaded batch; with
    ``verify`` the same strings go through the original library, and the ids back through the
    library's decoder, so every word form that occurs is compared both ways. No token crosses
    the start of a word, so what holds for the words of a text holds for the text."""

    def __init__(self, data: bytes, threads: int, verify: bool):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.threads, self.verify = rebuild(data, 0), threads, verify
        self.original = original(data) if verify else None
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(SEPARATOR, "isolated")
        (self.cut,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.split = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.flat, self.sizes, self.good = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def groups(self, words: list[str]):
        """Runs of words that can be joined; one that holds the separator is alone."""
        held: list[str] = []
        for w in words:
            if SEPARATOR in w:
                if held:
                    yield held
                yield [w]
                held = []
            else:
                held.append(w)
                if len(held) == JOINED_WORDS:
                    yield held
                    held = []
        if held:
            yield held

    def learn(self, words: list[str]) -> None:
        groups = list(self.groups(words))
        joined = [SEPARATOR.join(g) for g in groups]
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        spelled = self.tokenizer.decode_batch(encoded, skip_special_tokens=False) if self.verify else joined
        rows, sizes, good = [], [], []
        for group, text, got, back in zip(groups, joined, encoded, spelled, strict=True):
            ids = np.asarray(got, np.int32)
            if len(group) == 1:
                rows.append(ids)
                sizes.append(np.array([len(ids)]))
            else:
                cuts = np.flatnonzero(ids == self.cut)
                rows.append(np.delete(ids, cuts))
                sizes.append(np.diff(np.r_[-1, cuts, len(ids)]) - 1)
            good.append(np.ones(len(group), bool))
            if self.verify:
                blank = text.replace(MARK, " ")
                # the original puts a marker in front, so the separator goes first
                theirs = np.asarray(self.original.encode(SEPARATOR + blank, num_threads=self.threads), np.int32)[2:]
                if not np.array_equal(ids, theirs) or back != blank[1:]:
                    good[-1][:] = [self.agrees(w, r) for w, r in zip(group, np.split(rows[-1], np.cumsum(sizes[-1])[:-1]), strict=True)]
        self.flat = np.concatenate([self.flat, *rows])
        self.sizes = np.concatenate([self.sizes, *sizes]).astype(np.int64)
        self.good = np.concatenate([self.good, *good])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def agrees(self, word: str, ids: np.ndarray) -> bool:
        blank = word[1:].replace(MARK, " ")
        return self.original.encode(blank) == ids.tolist() and self.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == blank

    def encode(self, texts: list[str]):
        """(ids of all texts end to end, tokens per text, texts whose words all agree)."""
        if len(self.known) > KEPT_WORDS:
            self.clear()
        words = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ends = np.cumsum([len(ws) for ws in words])
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(ends[-1]) if len(ends) else 0)
        if self.known.fresh:
            self.learn(self.known.fresh)
            self.known.fresh = []
        sizes, starts = self.sizes[at], self.starts[at] if len(at) else at
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
        bounds = np.r_[0, ends]
        bad = np.r_[0, np.cumsum(~self.good[at])]
        return ids, np.diff(total[bounds]), np.diff(bad[bounds]) == 0


class TextEncoder:
    """Encodes whole texts, for models that are not separable."""

    def __init__(self, data: bytes, threads: int, verify: bool):
        self.tokenizer, self.threads = rebuild(data), threads
        self.original = original(data) if verify else None

    def encode(self, texts: list[str]):
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        good = np.ones(len(texts), bool)
        if self.original:
            theirs, back = self.original.encode(texts, num_threads=self.threads), self.tokenizer.decode_batch(rows, skip_special_tokens=False)
            normal = [self.original.decode(x) for x in theirs]
            good = np.array([a == b and x == y for a, b, x, y in zip(rows, theirs, back, normal, strict=True)], bool)
        return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64), good


def encoder_for(data: bytes, threads: int, verify: bool):
    return once("encoders", (data, threads, verify), lambda: (WordEncoder if separable(parse_model(data)) else TextEncoder)(data, threads, verify))


ENCODE_SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint, parity boolean"


def encoder(data: bytes, threads: int, verify: bool):
    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        own = encoder_for(data, threads, verify)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in text_groups(texts):
                ids, sizes, good = own.encode(texts[i:j])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                same = pa.array(good) if verify else pa.nulls(j - i, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(sizes), same], names=["doc_id", "ids", "n_tokens", "parity"])

    return encode


def encode(docs: DataFrame, model: bytes, threads: int = 2, verify: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens and parity of every whole text; parity: the original library gives
    the same ids, and the tokenizers decoder makes the normalised text of them (null unless
    ``verify``).

    ``model`` is the content of the model file, read once on the driver (files of this kind
    are a few megabytes at most). Null and empty texts have no tokens; rows are independent,
    so repeats, ties and skew do not matter; other columns are ignored.
    """
    return read_texts(docs).mapInArrow(tidied(encoder(model, threads, verify)), ENCODE_SCHEMA)


def read_texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def decoder(data: bytes):
    def decode(batches):
        tokenizer = loaded(data)
        for batch in batches:
            texts = tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return decode


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give an empty text."""
    return rows.select("doc_id", "ids").mapInArrow(tidied(decoder(model)), "doc_id bigint, text string")


DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, parity boolean"


def digest_batches(batches):
    for batch in batches:
        column = batch.column("ids")
        flat, offsets = column.values.to_numpy().astype("<i4"), column.offsets.to_numpy()
        digests = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(digests, pa.string()), batch.column("parity")], names=["doc_id", "n_tokens", "ids_sha256", "parity"])


def encode_digest(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``encode`` with a digest (ids as 32-bit little endian) in place of the ids."""
    run = encoder(model, threads, True)
    return read_texts(docs).mapInArrow(tidied(lambda batches: digest_batches(run(batches))), DIGEST_SCHEMA)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
