"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of two views, a hashed word vector and the mean of its hashed character trigrams; both are
projected once per distinct word. Windows of 16 words, each overlapping the next by half, are read in both
directions, pooled by attention and scored; a document's score is that of its worst window, calibrated.

Only documents carry labels, so training is by multiple instances: a toxic document stands for its window with
the strongest evidence (first by word counts, then by the network itself), a clean one for all sorts of its
windows and its worst one. Learning takes a bounded sample of labelled rows (``ROWS`` of each label, texts up to
``MOST_BYTES``); scoring reads every window of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.llm.decontaminate import WORD

STEPS, STRIDE = 16, 8
WORDS, GRAMS = 1 << 15, 1 << 12
VECTOR, HIDDEN = 8, 8
ROWS, MOST_BYTES = 1_500, 20_000
EPOCHS, BATCH, RATE = 8, 256, 0.04
CHUNK = 2048


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_model(seed: int = 5, kind=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = {"word": (WORDS, VECTOR), "gram": (GRAMS, VECTOR), "att_w": (2 * HIDDEN, HIDDEN), "att_v": (HIDDEN,), "out": (2 * HIDDEN,)}
    for d in ("f", "b"):
        size |= {f"w_{d}": (VECTOR, 3 * HIDDEN), f"u_{d}": (HIDDEN, 3 * HIDDEN), f"c_{d}": (3 * HIDDEN,)}
    model = {k: (rng.normal(0, 0.3, s)).astype(kind) for k, s in size.items()}
    return model | {"bias": np.zeros(1, kind), "scale": np.array([1, 0], kind)}


def features(batch: pa.RecordBatch):
    """Word rows, trigram rows and owners of the trigrams for every word; the first word of every text."""
    data, at = c.buffer(batch.column("text"))
    data = c.FOLD[data]
    start, stop, first = c.words(data, at, WORD)
    word = c.span_hash(c.prefix_hash(data), start, stop)
    distinct, head, inverse = np.unique(word, return_index=True, return_inverse=True)
    # Trigrams of a word with a border sign on both sides, as hashes of bytes.
    size = stop[head] - start[head] + 2
    owner = np.repeat(np.arange(len(distinct)), size - 2)
    place = c.expand(np.zeros(len(size), np.int64), size - 2)
    where = start[head][owner] + place
    n = (size - 2)[owner]
    before = np.where(place > 0, data[np.maximum(0, where - 1)], 2).astype(np.uint64)
    after = np.where(place < n - 1, data[np.minimum(len(data) - 1, where + 1)], 3).astype(np.uint64) if len(data) else before
    key = c.mix((before << np.uint64(16)) | (data[where].astype(np.uint64) << np.uint64(8)) | after)
    return (distinct & np.uint64(WORDS - 1)).astype(np.int64), (key & np.uint64(GRAMS - 1)).astype(np.int64), owner, inverse, first


def windows(first: np.ndarray, steps: int = STEPS, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window, and the text it belongs to; a text without words has one empty window."""
    n = np.diff(first)
    count = np.where(n <= steps, 1, -(-(n - steps) // stride) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = c.expand(np.zeros(len(n), np.int64), count)
    begin = first[:-1][doc] + k * stride
    return begin, np.minimum(steps, first[1:][doc] - begin), doc


def inputs(model: dict, word: np.ndarray, gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of distinct words, and how many trigrams each has."""
    n = np.maximum(1, np.bincount(owner, minlength=len(word))).astype(model["word"].dtype)
    total = np.zeros((len(word), VECTOR), model["word"].dtype)
    if len(owner):
        ends = np.searchsorted(owner, np.arange(len(word)))
        total = np.add.reduceat(model["gram"][gram], np.minimum(ends, len(owner) - 1), axis=0)
    return model["word"][word] + total / n[:, None], n


def forward(model: dict, projected: dict, index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of every window. index: (windows, steps) rows of the projected words; mask: which steps hold a word."""
    m, steps = index.shape
    kind = model["out"].dtype
    states = np.zeros((steps, m, 2 * HIDDEN), kind)
    tape: dict = {"f": [], "b": []}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((m, HIDDEN), kind)
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        u, x = model[f"u_{d}"], projected[d]
        for t in order:
            hu = h @ u
            xt = x[index[:, t]]
            gate = sigmoid(xt[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            cand = np.tanh(xt[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            on = mask[:, t, None]
            new = h + on * (1 - z) * (cand - h)
            if keep:
                tape[d].append((t, h, z, r, cand, hu[:, 2 * HIDDEN :], on))
            h = new
            states[t][:, side] = h
    inner = np.tanh(states @ model["att_w"])
    weight = inner @ model["att_v"]
    weight = np.where(mask.T > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(axis=0)) * (mask.T > 0)
    weight = weight / np.maximum(1e-9, weight.sum(axis=0))
    pooled = (weight[:, :, None] * states).sum(axis=0)
    logit = pooled @ model["out"] + model["bias"][0]
    return (logit, states, inner, weight, pooled, tape) if keep else logit


def project(model: dict, vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {d: vectors @ model[f"w_{d}"] + model[f"c_{d}"] for d in ("f", "b")}


def gradients(model: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight_: np.ndarray):
    """Loss, gradients of the shared parameters, and of the word vectors."""
    projected = project(model, vectors)
    logit, states, inner, weight, pooled, tape = forward(model, projected, index, mask, True)
    p = sigmoid(logit)
    loss = -(weight_ * np.where(label == 1, np.log(np.maximum(1e-9, p)), np.log(np.maximum(1e-9, 1 - p)))).sum()
    error = (weight_ * (p - label)).astype(model["out"].dtype)
    g = {"out": pooled.T @ error, "bias": np.array([error.sum()])}
    d_pooled = error[:, None] * model["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["att_v"] = np.einsum("tmk,tm->k", inner, d_score)
    d_inner = d_score[:, :, None] * model["att_v"] * (1 - inner**2)
    g["att_w"] = np.einsum("tmi,tmk->ik", states, d_inner)
    d_states = d_states + d_inner @ model["att_w"].T
    d_vectors = np.zeros_like(vectors)
    for d in ("f", "b"):
        u = model[f"u_{d}"]
        d_projected = np.zeros_like(projected[d])
        g[f"u_{d}"] = np.zeros_like(u)
        dh = np.zeros((len(index), HIDDEN), u.dtype)
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        for t, h, z, r, cand, hn, on in reversed(tape[d]):
            dh = dh + d_states[t][:, side]
            d_cand = dh * on * (1 - z) * (1 - cand**2)
            d_z = -dh * on * (cand - h) * z * (1 - z)
            d_r = d_cand * hn * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_cand], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_cand * r], axis=1)
            g[f"u_{d}"] += h.T @ d_hu
            np.add.at(d_projected, index[:, t], d_x)
            dh = dh * (1 - on * (1 - z)) + d_hu @ u.T
        g[f"w_{d}"] = vectors.T @ d_projected
        g[f"c_{d}"] = d_projected.sum(axis=0)
        d_vectors += d_projected @ model[f"w_{d}"].T
    return loss, g, d_vectors


class Sample:
    """The labelled texts as windows over distinct words."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
        self.word, self.gram, self.owner, self.inverse, self.first = features(batch)
        self.begin, self.size, self.doc = windows(self.first)
        self.labels = labels

    def rows(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_rows(self.inverse, self.begin[picked], self.size[picked])


def window_rows(inverse: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(STEPS)
    mask = (step < size[:, None]).astype(np.float32)
    if not len(inverse):
        return np.zeros((len(begin), STEPS), np.int64), mask
    return inverse[np.minimum(begin[:, None] + step, len(inverse) - 1)], mask


def logits(model: dict, word, gram, owner, inverse, begin, size) -> np.ndarray:
    vectors, _ = inputs(model, word, gram, owner)
    if not len(vectors):
        vectors = np.zeros((1, VECTOR), model["word"].dtype)
    projected = project(model, vectors)
    out = np.zeros(len(begin), model["out"].dtype)
    for k in range(0, len(begin), CHUNK):
        index, mask = window_rows(inverse, begin[k : k + CHUNK], size[k : k + CHUNK])
        out[k : k + CHUNK] = forward(model, projected, index, mask)
    return out


def worst(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its highest window and that window's place."""
    order = np.lexsort((value, doc))
    last = np.searchsorted(doc[order], np.arange(n), "right") - 1
    return value[order[last]], order[last]


def train(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """A model from labelled texts; without both labels, or any word, it gives the share of label 1 for every text."""
    model = new_model(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.01
    s = Sample(texts, labels) if len(set(labels.tolist())) == 2 else None
    if s is None or not len(s.word):
        return model | {"out": np.zeros_like(model["out"]), "scale": np.array([0, np.log(share / (1 - share))], np.float32)}
    n = len(texts)
    text_of = np.repeat(np.arange(n), np.diff(s.first))
    pairs = np.unique(np.stack([s.inverse, text_of]), axis=1)
    toxic = labels[pairs[1]] == 1
    with_, without = (np.bincount(pairs[0][x], minlength=len(s.word)) for x in (toxic, ~toxic))
    evidence = np.log((with_ + 0.5) / (labels.sum() + 1)) - np.log((without + 0.5) / ((1 - labels).sum() + 1))
    evidence *= (with_ + without) / (with_ + without + 5)
    model["word"][:, 0] = 0
    np.add.at(model["word"][:, 0], s.word, np.clip(evidence, -2, 4).astype(np.float32))
    index, mask = s.rows(np.arange(len(s.begin)))
    value = np.where(mask > 0, evidence[index], -9).max(axis=1)
    rng = np.random.default_rng(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            value = logits(model, s.word, s.gram, s.owner, s.inverse, s.begin, s.size)
        top = worst(s.doc, value, n)[1]
        clean = np.flatnonzero(labels[s.doc] == 0)
        picked = np.concatenate([top, rng.choice(clean, min(len(clean), 2 * n))])
        rng.shuffle(picked)
        for k in range(0, len(picked), BATCH):
            some = picked[k : k + BATCH]
            index, mask = s.rows(some)
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(len(some), STEPS)
            low, high = np.searchsorted(s.owner, used), np.searchsorted(s.owner, used, "right")
            gram = s.gram[c.expand(low, high - low)]
            owner = np.repeat(np.arange(len(used)), high - low)
            vectors, count = inputs(model, s.word[used], gram, owner)
            y = labels[s.doc[some]].astype(np.float32)
            _, g, dv = gradients(model, vectors, index, mask, y, np.full(len(some), 1 / len(some), np.float32))
            for name, rows, grad in (("word", s.word[used], dv), ("gram", gram, (dv / count[:, None])[owner])):
                g[name] = np.zeros_like(model[name])
                np.add.at(g[name], rows, grad)
            step += 1
            for name, grad in g.items():  # Adam
                m, v = state[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                model[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    value = worst(s.doc, logits(model, s.word, s.gram, s.owner, s.inverse, s.begin, s.size), n)[0].astype(float)
    model["scale"] = calibrate(value, labels)
    return model


def calibrate(value: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve over the documents' highest logits, by Newton steps."""
    x = np.stack([value, np.ones_like(value)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.1])
        w = w - np.linalg.solve(hess, x.T @ (p - labels) + 0.1 * (w - [1, 0]))
    return np.array([max(0.05, w[0]), w[1]], np.float32)


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` whole texts of either label, picked by a hash of the id."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = [known.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most 2 * rows ids
    texts = c.documents(docs).where(F.octet_length("text") <= MOST_BYTES).join(picked, "doc_id").dropDuplicates(["doc_id"])
    got = texts.orderBy("doc_id").select("text", "toxic").toPandas()
    return got["text"].tolist(), got["toxic"].to_numpy(np.int64)


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 from 0.7).

    A null text counts as empty, and a text without words has the score of an empty window. Repeated rows
    stay repeated, other columns are ignored.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m = shared.value
        word, gram, owner, inverse, first = features(batch)
        begin, size, doc = windows(first)
        value = worst(doc, logits(m, word, gram, owner, inverse, begin, size), batch.num_rows)[0]
        got = sigmoid(value.astype(float) * m["scale"][0] + m["scale"][1])
        yield {"doc_id": batch.column("doc_id"), "score": got, "predicted": (got >= 0.7).astype(np.int32)}

    return c.map_batches(c.documents(docs), run, "doc_id long, score double, predicted int")
