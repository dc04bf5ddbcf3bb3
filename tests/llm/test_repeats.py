"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from verbena.llm.repeats import long_groups, repeat_report, window_minima


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        runs = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        out.append((i, len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passage = [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows = [(k, " ".join([word() for _ in range(r.randint(0, 20))] + ([r.choice(passage)] if r.random() < 0.6 else []) + [word() for _ in range(r.randint(0, 20))])) for k in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, ""), (103, "ab" * 40), (104, "x" * 70), (None, passage[0]), (105, "\0\1" * 20 + passage[1])]
    return rows


@pytest.mark.parametrize("length,gram,most", [(24, 12, 1000), (24, 12, 2), (16, 5, 1000)])
def test_against_brute_force(spark, length, gram, most):
    rows = corpus(length)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' as doc_print", "1 as spans")
    got = sorted(map(tuple, repeat_report(df, length, gram, most).collect()), key=str)
    assert got == brute(rows, length)


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_window_minima():
    v = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for size in (1, 2, 7, 300):
        assert window_minima(v, size).tolist() == [min(v[i : i + size]) for i in range(300 - size + 1)]


def test_groups_share_the_length():
    r = random.Random(3)
    pieces = ["".join(r.choice("ab") for _ in range(40)) for _ in range(6)]
    symbols, ends = [], []
    for p in pieces:
        symbols += [ord(c) + 1 for c in p] + [0]
        ends += [len(symbols)] * (len(p) + 1)
    text = "".join(p + "$" for p in pieces)
    for length in (3, 9, 15):
        order, group = long_groups(np.array(symbols), np.array(ends), length)
        by = {}
        for s, g in zip(order.tolist(), group.tolist(), strict=True):
            by.setdefault(g, []).append(text[s : s + length])
        want = Counter(text[s : s + length] for s in range(len(text)) if "$" not in text[s : s + length] and len(text[s : s + length]) == length)
        got = Counter()
        for members in by.values():
            if len(members) > 1:
                assert len(set(members)) == 1 and "$" not in members[0]
                got[members[0]] += len(members)
        assert got == {k: v for k, v in want.items() if v > 1}
