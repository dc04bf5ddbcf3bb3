"""Toxicity and language model: held-out quality, plain versions, edge cases."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from verbena.llm._common import NONSPACE, split_words
from verbena.llm.class_lm import PRIOR, SURFACE, chooser, exchange, lm_scores, surface_classes, train, training_rows
from verbena.llm.toxicity import ChainModel, fit, tag_toxic, toxicity_report


def corpus(seed=3, n=400):
    r = random.Random(seed)
    plain = ["the", "of", "river", "stone", "cloud", "and", "über", "casa"]
    bad = ["idiotic", "idiotas", "moronic", "scum"]
    rows, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.25
        words = [r.choice(plain) + r.choice(["", ","]) for _ in range(r.randint(3, 60))]
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((k, " ".join(words)))
        if r.random() < 0.8:
            labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = corpus()
    rows += [(900, None), (901, ""), (902, "scum " * 3000), (3, rows[3][1]), (None, "river")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0.5 as score", "'x' as lang")
    lab = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity_report(docs, lab).collect()
    assert len(got) == len(rows)
    truth = {k: t for k, _, t in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.97 * len(held)
    tagged = {r["doc_id"]: r for r in tag_toxic(docs, lab).collect()}
    text = next(t for k, t in rows if k in tagged and tagged[k]["spans"])
    found = next(r for r in tagged.values() if r["text"] == text)
    for s in found["spans"]:
        assert re.match("idiot|moron|scum", text[s["start"] : s["end"]])
    one = {r["score"] for r in toxicity_report(docs, lab.where("toxic = 0")).collect()}
    assert len(one) == 1


def test_marginals_match_the_padded_chain():
    model = ChainModel(3)
    model.weights, model.bias, model.trans = np.array([2.0, -1.0, 0.5]), -1.5, np.array([[0.3, -0.7], [0.1, 0.9]])
    n, positions = 9, np.array([0, 3, 4, 8])
    features = np.array([[0, -1], [1, 2], [0, 2], [2, -1]])
    full = np.full((1, n, 2), -1)
    full[0, positions] = features
    gamma, _ = model.posteriors(model.emission(full), np.ones((1, n), bool))
    assert model.marginals(n, positions, features) == pytest.approx(gamma[0, positions])


def test_marginals_against_all_tag_sequences():
    model = ChainModel(3)
    model.weights, model.bias, model.trans = np.array([1.5, -0.5, 0.8]), -0.7, np.array([[0.2, -0.4], [-0.1, 0.6]])
    n, positions = 7, np.array([1, 2, 5])
    features = np.array([[0, -1], [1, 2], [0, 2]])
    emission = np.full(n, model.bias)
    emission[positions] = model.emission(features)
    total, hit = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(e for e, t in zip(emission, tags, strict=True) if t) + sum(model.trans[a, b] for a, b in itertools.pairwise(tags)))
        total += weight
        hit += weight * np.array(tags)
    assert model.marginals(n, positions, features) == pytest.approx((hit / total)[positions])


@pytest.mark.parametrize("place", ["first", "alone", "last"])
def test_cues_at_the_edges_of_short_texts_train_the_chain(spark, place):
    r = random.Random(5)
    words = ["the", "of", "river", "stone", "cloud", "and"]
    rows, labels = [], []
    for k in range(600):
        text = [r.choice(words) for _ in range(r.randint(1, 4))]
        if k % 4 == 0:
            text = {"first": ["moronic", *text], "alone": ["moronic"], "last": [*text, "moronic"]}[place]
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known, model = fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert len(known) and model.weights.max() > 0.5
    assert model.marginals(3, np.array([0]), np.arange(len(known))[None, :5]).max() > 0.5


def base_scores(rows):
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\0end"] for k, t in rows}
    train = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(train.values()), len(train)
    return {k: (len(ws), sum(train[w] > 0 for w in ws), total, sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in ws)) for k, ws in tokens.items()}


def lm_corpus(n=300):
    r = random.Random(8)
    nouns, verbs = [f"noun{k}" for k in range(30)], [f"verb{k}" for k in range(30)]
    rows = [(k, " ".join(w for _ in range(r.randint(0, 15)) for w in ("The", r.choice(nouns), r.choice(verbs), f"rare{r.randrange(4000)}."))) for k in range(n)]
    return [*rows, (900, None), (901, ""), (902, "a " * 4000), (903, "é x\x0by")]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr("verbena.llm.class_lm.HELD_WORDS", 80)
    monkeypatch.setattr("verbena.llm.class_lm.CLUSTERED", 40)
    rows = lm_corpus()
    got = lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as train", "'w' as word")).collect()
    want = base_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    assert lm_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_score_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr("verbena.llm.class_lm.HELD_WORDS", 60)
    monkeypatch.setattr("verbena.llm.class_lm.CLUSTERED", 30)
    rows = lm_corpus(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    state = train(training_rows(docs))
    chosen = {r["word"]: (r["class"], r["c"]) for r in state.words.collect()}
    end = state.k - 1

    def tokens(text):
        raw = np.frombuffer((text or "").lower().encode(), np.uint8)
        _, starts, ends, words = split_words(raw, np.array([0, len(raw)]), NONSPACE)
        return [chosen.get(w, (state.learnt + s, 0)) for w, s in zip(words.view(np.int64).tolist(), surface_classes(raw, starts, ends).tolist(), strict=True)]

    of = {k: tokens(t) for k, t in rows}
    learnt = {k for k in of if zlib.crc32(str(k).encode()) % 7 != 2}
    pairs, kinds, size = Counter(), Counter(), Counter()
    for k in learnt:
        line = [end, *[c for c, _ in of[k]], end]
        pairs.update(itertools.pairwise(line))
    for c, n in chosen.values():
        kinds[c] += 1
        size[c] += n
    entries, total = Counter(), sum(pairs.values())
    leaves = Counter()
    for (a, b), n in pairs.items():
        entries[b] += n
        leaves[a] += n
    for r in lm_scores(docs).collect():
        score, before = 0.0, end
        for c, n in [*of[r["doc_id"]], (end, None)]:
            score += math.log10((pairs[before, c] + PRIOR * (entries[c] + 1) / (total + state.k)) / (leaves[before] + PRIOR))
            if n is not None:
                score += math.log10((n + 1) / (size[c] + kinds[c] + 1))
            before = c
        assert r["score"] == pytest.approx(score)
        assert r["perplexity"] == pytest.approx(10 ** (-score / r["n_tokens"]))


def test_words_that_occur_once(spark, monkeypatch):
    monkeypatch.setattr("verbena.llm.class_lm.HELD_WORDS", 50)
    monkeypatch.setattr("verbena.llm.class_lm.CLUSTERED", 20)
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(10))) for k in range(40)], "doc_id bigint, text string")
    state = train(training_rows(docs))
    assert state.vocabulary.n == 20 and 20 < len(state.vocabulary.words) < 120
    assert all(r["score"] < 0 for r in lm_scores(docs).collect())


def test_words_beyond_the_clustered_ones_learn_classes(spark, monkeypatch):
    # two kinds of words with the same spelling; only their neighbours tell them apart
    monkeypatch.setattr("verbena.llm.class_lm.CLUSTERED", 104)
    r = random.Random(4)
    kinds = [[f"w{10000 + 2 * k + kind}" for k in range(400)] for kind in (0, 1)]
    rows = [(k, " ".join(w for _ in range(20) for kind in (r.randrange(2),) for w in (("le", "un")[kind], r.choice(kinds[kind]), ("va", "est")[kind]))) for k in range(300)]
    swapped = [(k + 1_000_000, t.replace("le w", "LE w").replace("un w", "le w").replace("LE w", "un w").replace("va", "VA").replace("est", "va").replace("VA", "est")) for k, t in rows[:40]]
    for held in (1 << 18, 150):
        monkeypatch.setattr("verbena.llm.class_lm.HELD_WORDS", held)
        docs = spark.createDataFrame(rows + [x for x in swapped if zlib.crc32(str(x[0]).encode()) % 7 == 2], "doc_id bigint, text string")
        got = {x["doc_id"]: x for x in lm_scores(docs).collect()}
        odd = [k for k in got if k >= 1_000_000]
        straight = [x["score"] / x["n_tokens"] for k, x in got.items() if x["held_out"] and k < 1_000_000]
        # with classes by spelling alone these are 0.14 apart
        assert odd and straight and sum(straight) / len(straight) > 1 + sum(got[k]["score"] / got[k]["n_tokens"] for k in odd) / len(odd)


def test_words_choose_in_bounded_memory():
    # a batch whose words all stand beside every class, each word in two rows
    r, learnt, n = np.random.default_rng(6), 48, 400
    k = learnt + SURFACE + 1
    shared = SimpleNamespace(value=(r.integers(0, 50, (k, k)).astype(float), learnt, np.full(k, 5000.0)))
    words = np.repeat(np.sort(r.choice(1 << 40, n, replace=False)), 2)
    contexts = [(np.arange(2 * k) | r.integers(1, 9, 2 * k) << 16).astype(np.int64).tobytes() for _ in words]
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(r.integers(0, SURFACE, n), 2).astype(np.int32)), pa.array(contexts, pa.binary())], names=["word", "surface", "contexts"])
    tracemalloc.start()
    whole = pa.Table.from_batches(chooser(shared)([batch])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(whole) == n
    assert whole == pa.Table.from_batches(chooser(shared)(batch.slice(i, 1) for i in range(2 * n))).to_pylist()
    assert peak < 40 << 20


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(1)
    n = 24
    kind = np.arange(n) % 3
    table = np.zeros((n + 2, n + 2), int)
    for a in range(n):
        for b in range(n):
            if kind[b] == (kind[a] + 1) % 3:
                table[a, b] = r.integers(5, 20)

    def likelihood(of):
        k = of.max() + 1
        joint = np.zeros((k, k))
        np.add.at(joint, (of[:, None], of[None, :]), table)
        h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return h(joint) - h(joint.sum(0)) - h(joint.sum(1))

    start = np.r_[np.arange(n) % 4, 4, 5]
    of = exchange(table, n, classes=4)
    assert likelihood(of) > likelihood(start)
    assert of[n:].tolist() == [4, 5] and SURFACE > 0
