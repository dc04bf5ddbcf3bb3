"""Jaccard join and embedding groups against brute force."""

import math
import random
import re

import numpy as np
import pytest

from verbena.llm._common import connected_components
from verbena.llm.embedding_dedup import calibrated_count, embedding_groups, table_sizes
from verbena.llm.jaccard_join import first_of_groups, jaccard_groups, jaccard_join


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_copies(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 40
    bases = [[r.choice(vocabulary) for _ in range(r.choice((2, 8, 12, 40, 90)))] for _ in range(20)]
    rows = []
    for k in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.2:
            words = words[: -r.randint(1, 3)] + ["The"] * r.randint(0, 2)
        rows.append((k * 3 % 151, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE"), (505, "x " * 5000), (506, "x " * 4000)]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_groups(spark, size, percent, monkeypatch):
    if size == 5:  # many places for a home, few bits, and the prefix join alone
        for name, value in (("PARTNERS", 2), ("HOMES", 1), ("FILTER_ROWS", 2), ("LONG", 0), ("ROUNDS", 0), ("LEAST_BITS", 3)):
            monkeypatch.setattr(f"verbena.llm.jaccard_join.{name}", value)
    rows = near_copies(size)
    sets = {i: sets_of(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(links) > 20
    want = components(ids, links)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'c' as component")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(df, size, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    kept = {r["doc_id"] for r in first_of_groups(df, size, percent).collect()}
    assert kept == {i for i in ids if want[i] == i}
    pairs, members = jaccard_join(df, size, percent)
    named = {r["doc_id"]: r for r in members.collect()}
    first = {}
    for i in ids:
        first.setdefault(frozenset(sets[i]) or i, i)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a, b in links if first[frozenset(sets[a])] == a and first[frozenset(sets[b])] == b and sets[a] != sets[b]}
    for i in ids:
        assert named[i]["representative"] == first[frozenset(sets[i]) or i]
        assert named[i]["n_links"] == sum(i in x for x in links)


def test_rows_that_share_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[1:]), " ".join(reversed(words)), " ".join([*reversed(words)][1:])]
    rows = [(1, texts[0]), (1, texts[2]), (5, texts[1]), (6, texts[3]), (7, "else")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7)}


def test_jaccard_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_groups(none).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c")]
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (7, 7), (7, 7)]


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (100, 101), (102, 102)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("bucket,block", [(200, 2000), (10, 2000), (60, 7)])
def test_embedding_groups(spark, monkeypatch, bucket, block):
    monkeypatch.setattr("verbena.llm.embedding_dedup.BUCKET", bucket)
    monkeypatch.setattr("verbena.llm.embedding_dedup.BLOCK", block)
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 16))
    vectors = [(c + r.standard_normal(16) * s).tolist() for c in centres for s in r.uniform(0.02, 0.45, 20)]
    rows = [(k, v) for k, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 0.0]), (906, [1.0, 0.0]), (907, vectors[0]), (908, [1e200] * 16), (909, [2e200] * 16)]
    rows += [(2000 + k, vectors[17]) for k in range(25)]  # many equal vectors
    unit = {i: np.array(v, float) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in embedding_groups(df).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
    want = components([i for i, _ in rows], links)
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.97 * len(want)
    for i in (900, 901, 902, 903, 904):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[905]["n_links"] == got[906]["n_links"] == 1 and got[908]["n_links"] == 1


def test_recall_at_ten_thousand_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((10_000, 32))
    for k in range(0, 6_000, 2):  # pairs close to the threshold
        x[k + 1] = x[k] + r.standard_normal(32) * np.linalg.norm(x[k]) * r.uniform(0.05, 0.062)
    x[6_000:6_300] = x[6_000] + r.standard_normal((300, 32)) * 0.15
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_groups(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")).collect()}
    want = close.sum(axis=1)
    assert all(got[k] <= want[k] for k in got) and want.sum() > 50_000
    assert sum(got.values()) >= 0.995 * want.sum()
    assert sum(got[k] for k in range(6_000)) >= 0.99 * want[:6_000].sum()


def test_tables():
    assert table_sizes(0, 0.95) == table_sizes(200, 0.95) == (0, 1)
    for rows in (1_000, 51_282, 10**9):
        k, tables = table_sizes(rows, 0.95)
        meet = (1 - math.acos(0.95) / math.pi) ** k
        assert rows / 2**k <= 200 and 1 - (1 - meet) ** tables >= 0.999


def test_calibration():
    assert 20 < calibrated_count() < 32
