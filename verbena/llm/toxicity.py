"""Toxic spans by a linear-chain conditional random field.

Document labels give token labels: n-grams of letters at the start of words (and whole words)
that occur far more often in toxic documents are cues, and the tokens of toxic documents that
carry a cue are tagged. A two-tag chain with these features and transitions is trained on the
tagged tokens; forward-backward marginals give the offending offsets, and their aggregate over
a document, calibrated by a logistic model, gives its score.

Fitting reads at most ``SAMPLE_DOCS`` labelled rows (picked by a hash of the id) and at most
about ``MAX_WINDOWS`` token sequences of them; scoring reads every whole text. What the driver
sends to the tasks is plain arrays: the executors need not have this package.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm._common import ALNUM, discard, doc_chunks, materialise, mix, prefix_hash, signed, small_batches, split_words, text_buffers, tidied

#: Labelled rows that the model is fitted on, at most.
SAMPLE_DOCS = 12_000
#: Features that the model holds, at most (16 bytes each); the evidence asked for leaves far fewer.
MAX_FEATURES = 1 << 16
#: Token sequences that the chain is trained on, about; of more, a share by hash.
MAX_WINDOWS = 50_000
#: Bytes of the word starts that are features besides the whole word.
STARTS = (4, 5, 6, 7)
#: Featureless tokens on each side of a cue that a training sequence has.
MARGIN = 4
THRESHOLD = 0.3
#: Log-likelihood ratio from which a feature is in the model, and from which it tags a token:
#: the second is what no feature of a corpus reaches by chance.
FEATURE_EVIDENCE, CUE_EVIDENCE = 18.0, 25.0
CHUNK_BYTES = 1 << 20


def token_features(data: np.ndarray, offsets: np.ndarray):
    """(document, start, end) of every token and its feature hashes, a column for the whole
    word and one for each start (0 where the word is shorter)."""
    docs, starts, ends, words = split_words(data, offsets, ALNUM)
    columns = [words]
    if len(words):
        sums, inverse = prefix_hash(data)
        for k in STARTS:
            long = ends - starts >= k
            h = np.zeros(len(starts), np.uint64)
            s = starts[long]
            h[long] = mix((sums[s + k] - sums[s]) * inverse[s] + np.uint64(k))
            columns.append(h)
    else:
        columns += [words] * len(STARTS)
    return docs, starts, ends, np.stack(columns, 1)


def lowered(column: pa.Array):
    return text_buffers(pc.utf8_lower(column))


def chunks_of(column: pa.Array):
    data, offsets = lowered(column)
    for i, j in doc_chunks(offsets, CHUNK_BYTES):
        part = offsets[i : j + 1]
        yield i, j, data[part[0] : part[-1]], part - part[0]


def feature_counts(batches):
    """Documents with each feature, by label, summed over what the task reads."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in chunks_of(batch.column(0)):
            docs, _, _, features = token_features(data, offsets)
            doc = np.repeat(docs, features.shape[1])
            flat = features.ravel()
            order = np.lexsort((flat, doc))
            doc, flat = doc[order], flat[order]
            once = np.r_[True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])][: len(flat)] & (flat != 0)
            doc, flat = doc[once], flat[once]
            names, at = np.unique(flat, return_inverse=True)
            hits = np.bincount(at, weights=toxic[i:j][doc], minlength=len(names)).astype(np.int64)
            total = np.bincount(at, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(hits), pa.array(total - hits)], names=["feature", "toxic", "clean"])


def active_tokens(features: np.ndarray, known: np.ndarray):
    """Index of each known feature of each token, -1 elsewhere."""
    if not len(known):
        return np.full(features.shape, -1)
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return np.where((known[at] == features) & (features != 0), at, -1)


def live_tokens(texts: pa.Array, known: np.ndarray):
    """(row, number of tokens, positions of the tokens with known features, those features as
    indices, -1 for none) of every text."""
    for i, j, data, offsets in chunks_of(texts):
        docs, _, _, features = token_features(data, offsets)
        at = active_tokens(features, known)
        first = np.searchsorted(docs, np.arange(j - i + 1))
        live = np.flatnonzero((at >= 0).any(axis=1))
        edge = np.searchsorted(live, first)
        for d in range(j - i):
            own = live[edge[d] : edge[d + 1]]
            yield i + d, int(first[d + 1] - first[d]), own - first[d], at[own]


#: Places of a training sequence.
SPAN = 2 * MARGIN + 1
WINDOW_SCHEMA = "part int, toxic int, places int, features array<int>"


def training_windows(known: np.ndarray):
    """Sequences of SPAN tokens around the tokens with known features: label of the text, places
    inside the text and the features of every place. A sequence starts MARGIN tokens before its
    first such token, or with the text; what lies behind the text's end is padding."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            part, label, places, rows = [], [], [], []
            for row, n, positions, found in live_tokens(batch.column(0), known):
                done = -1
                for k, p in enumerate(positions.tolist()):
                    if p <= done:
                        continue
                    start = max(p - MARGIN, 0)
                    done = start + SPAN - 1
                    own = np.full((SPAN, found.shape[1]), -1, np.int32)
                    end = int(np.searchsorted(positions, done, "right"))
                    own[positions[k:end] - start] = found[k:end]
                    part.append((p * 0x9E3779B1 + n * 0x85EBCA6B + int(found[k].max()) * 0xC2B2AE35) % (1 << 20))
                    label.append(int(toxic[row]))
                    places.append(min(SPAN, n - start))
                    rows.append(own.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (part, label, places)] + [pa.array(rows, pa.list_(pa.int32()))], names=["part", "toxic", "places", "features"])

    return run


def document_features(shared):
    """Label and aggregated marginals of each text of the sample."""

    def run(batches):
        known, *state = shared.value
        model = ChainModel.of(state)
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            rows = [(int(toxic[row]), *aggregated(model.marginals(n, positions, found))[1:].tolist()) for row, n, positions, found in live_tokens(batch.column(0), known)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.float64()) for c in columns[1:]], names=["toxic", "most", "total", "several"])

    return run


def aggregated(marginals: np.ndarray) -> np.ndarray:
    """What the score of a document is made of: 1, the largest marginal, their sum as a
    logarithm, and whether several tokens are toxic."""
    return np.array([1.0, marginals.max(initial=0.0), np.log1p(marginals.sum()), float((marginals > 0.5).sum() > 1)])


class ChainModel:
    """Two tags (0 clean, 1 toxic); scores in logarithms.

    ``weights`` per feature and ``bias`` add to tag 1; ``trans[a, b]`` scores tag b after a."""

    def __init__(self, n_features: int):
        self.weights, self.bias, self.trans = np.zeros(n_features), 0.0, np.zeros((2, 2))
        self.calibration = np.zeros(4)

    def state(self) -> tuple:
        """The model as plain arrays and numbers."""
        return self.weights, float(self.bias), self.trans, self.calibration

    @classmethod
    def of(cls, state) -> ChainModel:
        model = cls(0)
        model.weights, model.bias, model.trans, model.calibration = state
        return model

    def emission(self, features: np.ndarray) -> np.ndarray:
        padded = np.r_[self.weights, 0.0]
        return self.bias + padded[features].sum(axis=-1)

    def fit(self, features: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = 60, rate: float = 0.25, decay: float = 1e-3) -> None:
        """Gradient ascent (Adam) on the likelihood of the tag sequences; arrays are
        (sequence, place[, feature])."""
        n, size = tags.shape
        if not n:
            return
        state = [np.zeros(len(self.weights) + 5) for _ in range(2)]
        tokens = mask.sum()
        used = features >= 0
        flat, owner = features[used], np.nonzero(used)[:2]
        both = mask[:, 1:] & mask[:, :-1]
        seen = np.bincount(tags[:, :-1][both] * 2 + tags[:, 1:][both], minlength=4).reshape(2, 2)
        for step in range(1, steps + 1):
            gamma, pairs = self.posteriors(self.emission(features), mask)
            gap = np.where(mask, tags - gamma, 0.0)
            grad = np.zeros(len(self.weights) + 5)
            grad[:-5] = np.bincount(flat, weights=gap[owner], minlength=len(self.weights))
            grad[-5] = gap.sum()
            grad[-4:] = (seen - pairs).ravel()
            theta = np.r_[self.weights, self.bias, self.trans.ravel()]
            grad = grad / tokens - decay * theta * (len(tags) / tokens)
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            theta = theta + rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights, self.bias, self.trans = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)

    def posteriors(self, emission: np.ndarray, mask: np.ndarray):
        """Marginals of tag 1 and the expected number of each transition, over padded rows."""
        n, size = emission.shape
        move = np.exp(self.trans)
        emit = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], -1)
        alpha, beta = np.zeros((n, size, 2)), np.ones((n, size, 2))
        alpha[:, 0] = emit[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, size):
            a = (alpha[:, t - 1] @ move) * emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(size - 2, -1, -1):
            b = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
            beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        gamma = alpha * beta
        gamma /= gamma.sum(-1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(1, size):
            p = alpha[:, t - 1, :, None] * move * (emit[:, t] * beta[:, t])[:, None, :]
            p /= p.sum((1, 2), keepdims=True)
            pairs += p[mask[:, t]].sum(0)
        return gamma[..., 1], pairs

    def marginals(self, n: int, positions: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Marginals of tag 1 at the given positions of a document of n tokens. All other tokens
        have the same factor, so a run of them is a power of one 2 x 2 matrix."""
        if not len(positions):
            return np.zeros(0)
        move = np.exp(self.trans)
        plain = move * np.array([1.0, np.exp(np.clip(self.bias, -30, 30))])
        values, vectors = np.linalg.eig(plain)
        back = np.linalg.inv(vectors)
        scale = np.abs(values).max()

        def power(k: int) -> np.ndarray:
            return ((vectors * (values / scale) ** k) @ back).real

        emit = np.exp(np.clip(self.emission(features), -30, 30))
        gaps = np.diff(positions) - 1
        alpha = np.zeros((len(positions), 2))
        start = np.array([1.0, np.exp(np.clip(self.bias, -30, 30))]) @ power(int(positions[0]) - 1) @ move if positions[0] > 0 else np.ones(2)
        alpha[0] = start * (1.0, emit[0])
        for i in range(1, len(positions)):
            alpha[i - 1] /= alpha[i - 1].sum()
            alpha[i] = (alpha[i - 1] @ power(int(gaps[i - 1])) @ move) * (1.0, emit[i])
        beta = np.ones((len(positions), 2))
        beta[-1] = power(int(n - 1 - positions[-1])) @ np.ones(2)
        for i in range(len(positions) - 2, -1, -1):
            beta[i] = power(int(gaps[i])) @ move @ ((1.0, emit[i + 1]) * beta[i + 1])
            beta[i] /= beta[i].sum()
        both = np.maximum(alpha * beta, 0)
        return both[:, 1] / both.sum(1)

    def score(self, marginals: np.ndarray) -> float:
        """Calibrated probability of a document from its token marginals."""
        return float(1 / (1 + np.exp(-aggregated(marginals) @ self.calibration)))


def evidence(rows: pd.DataFrame, share: float) -> np.ndarray:
    """Log-likelihood ratio (G) of each feature's labels against the share of toxic rows."""
    a, b = rows["toxic"].to_numpy(float), rows["clean"].to_numpy(float)
    n = a + b
    return 2 * (a * np.log(a / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled ids outside the held-out quarter, one row
    each; of rows that share an id the smallest text."""
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    label = label.where(~held_out(F.col("doc_id")))
    total = label.count()
    if total > sample:  # only about as many as needed are sorted
        share = 1 << 20
        label = label.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < int(share * min(1.0, 1.2 * sample / total) + 64))
    picked = label.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    return materialise(rows.select("text", "toxic"), "labelled")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, ChainModel]:
    """(sorted feature hashes, model). Without toxic or without clean rows the model has no
    features and scores every document by the smoothed share of toxic rows."""
    rows = training_rows(docs, labels, sample)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    known, strong = np.zeros(0, np.uint64), np.zeros(0, bool)
    if toxic and clean:
        counts = rows.mapInArrow(tidied(feature_counts), "feature bigint, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # far more often in toxic rows than by chance; the strongest MAX_FEATURES of them
        share = toxic / (toxic + clean)
        kept = counts.where((F.col("toxic") >= 3) & (F.col("toxic") > 2 * share * (F.col("toxic") + F.col("clean"))))
        kept = kept.orderBy(F.desc(F.col("toxic") - share * (F.col("toxic") + F.col("clean"))), "feature").limit(MAX_FEATURES)
        found = kept.toPandas()
        found = found.assign(g=evidence(found, share))
        found = found[found["g"] > FEATURE_EVIDENCE].sort_values("feature", key=lambda s: s.to_numpy().view(np.uint64))
        known = found["feature"].to_numpy(np.int64).view(np.uint64)
        strong = ((found["g"] > CUE_EVIDENCE) & (found["toxic"] > 0.6 * (found["toxic"] + found["clean"]))).to_numpy()
    model = ChainModel(len(known))
    windows = materialise(rows.mapInArrow(tidied(training_windows(known)), WINDOW_SCHEMA), "windows")
    total = windows.count()
    seen = windows.where(F.col("part") < int((1 << 20) * min(1.0, MAX_WINDOWS / max(total, 1)))).toPandas()
    if len(seen):
        features = np.stack(seen["features"].to_numpy()).reshape(len(seen), SPAN, 1 + len(STARTS))
        mask = np.arange(SPAN) < seen["places"].to_numpy()[:, None]
        cue = np.r_[strong, False][features].any(axis=2)
        model.fit(features, (cue & (seen["toxic"].to_numpy() == 1)[:, None]).astype(np.int64), mask)
    shared = docs.sparkSession.sparkContext.broadcast((known, *model.state()))
    calibrate(model, rows.mapInArrow(tidied(document_features(shared)), "toxic int, most double, total double, several double").toPandas())
    shared.destroy()
    discard(rows, windows)
    return known, model


def calibrate(model: ChainModel, seen: pd.DataFrame) -> None:
    """Logistic regression of the labels on the aggregated marginals (Newton steps)."""
    if not len(seen):
        model.calibration = np.array([-3.0, 0, 0, 0])
        return
    x, y = np.c_[np.ones(len(seen)), seen[["most", "total", "several"]].to_numpy()], np.clip(seen["toxic"].to_numpy(float), 0, 1)
    theta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - p) - 0.5 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        theta = theta + np.linalg.solve(hess, grad)
    model.calibration = theta


TAG_SCHEMA = "score double, spans array<struct<start:int,end:int,probability:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def tagger(shared, with_spans: bool):
    def tag(batches):
        known, *state = shared.value
        model = ChainModel.of(state)
        clean = model.score(np.zeros(0))
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            scores, spans = np.full(batch.num_rows, clean), [[] for _ in range(batch.num_rows)]
            for i, j, data, offsets in chunks_of(texts):
                docs, starts, ends, features = token_features(data, offsets)
                at = active_tokens(features, known)
                live = np.flatnonzero((at >= 0).any(axis=1))
                if not len(live):
                    continue
                first = np.searchsorted(docs, np.arange(j - i + 1))
                for d in np.unique(docs[live]):
                    own = live[np.searchsorted(live, first[d]) : np.searchsorted(live, first[d + 1])]
                    m = model.marginals(int(first[d + 1] - first[d]), own - first[d], at[own])
                    scores[i + d] = model.score(m)
                    if with_spans:
                        raw = data[offsets[d] : offsets[d + 1]]
                        points = np.cumsum((raw & 0xC0) != 0x80)  # code points up to each byte
                        for t, p in zip(own, m, strict=True):
                            if p > 0.5:
                                s, e = int(starts[t] - offsets[d]), int(ends[t] - offsets[d])
                                spans[i + d].append({"start": int(points[s]) - 1, "end": int(points[e - 1]), "probability": float(p)})
            extra = [pa.array(scores), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "score", "spans"])

    return tag


def tag_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, with_spans: bool = True) -> DataFrame:
    """``docs`` with score and spans (code points of the lower-cased text, end exclusive, with
    their marginal). Null and empty texts have no tokens and get the score of a text without
    cues; all rows and columns stay, score and spans are replaced; without usable labels every
    text gets the same score. The model is a few hundred kilobytes whatever the input."""
    rows = small_batches(docs).drop("score", "spans")
    known, model = fit(rows, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((known, *model.state()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidied(tagger(shared, with_spans)), f"{fields}, {TAG_SCHEMA}")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = tag_toxic(rows, labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").cast("bigint").alias("n_spans"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; all columns stay as they are,
    also ones named score or spans."""
    apart = {c: c if c in ("doc_id", "text") else f"extra_{i}" for i, c in enumerate(docs.columns)}
    out = tag_toxic(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in apart.items()]), labels, with_spans=False)
    return out.where(F.col("score") < THRESHOLD).select(*[F.col(n).alias(c) for c, n in apart.items()])
