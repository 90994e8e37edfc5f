"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text is
encoded as a vector of rates and hashed words; a gated attention network learns from document
labels alone how much each passage counts, and scores the weighted passage representation.
The network is small and is fitted on the driver on a bounded sample of labelled documents;
scoring covers every passage of every document inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, text_of
from tidemark.llm.wordhash import hashed_words, word_bounds

PASSAGE = 48
#: Words of a longer text are kept in whole passages; a rest shorter than this joins the one before it.
REST = 16
HASHED = 16
HIDDEN, GATE = 16, 8
#: Bound on the labelled documents that the network is fitted on.
SAMPLE = 2000
#: Bound on the passages of one of them in the fit; longer documents give so many at equal distances. All are scored.
FIT_PASSAGES = 512
EPOCHS, RATE, DECAY = 120, 0.03, 1e-3

#: Characters that count as symbols, and others that end sentences or clauses.
SYMBOLS, STOPS = b"#*$%&|<>=_{}[]\\/^~@", b".,;:?"

_CLASSES = np.zeros((256, 6), np.float64)
_CLASSES[ord("A") : ord("Z") + 1, 0] = 1
_CLASSES[ord("0") : ord("9") + 1, 1] = 1
_CLASSES[list(SYMBOLS), 2] = 1
_CLASSES[ord("!"), 3] = 1
_CLASSES[list(STOPS), 4] = 1
_CLASSES[128:, 5] = 1

WIDTH = 6 + 7 + HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of some texts, and per text the number of its first passage (one more than texts).

    A text without words is one passage of zeros.
    """
    words, first = hashed_words(texts)
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_bounds(raw)
    count = np.diff(first)
    each = np.maximum(1, np.where(count % PASSAGE >= REST, -(-count // PASSAGE), count // PASSAGE))
    bag = np.concatenate([[0], np.cumsum(each)])
    total = int(bag[-1])
    out = np.zeros((total, WIDTH))
    if not len(words):
        return out, bag
    owner = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(words)) - first[:-1][owner]
    passage = bag[:-1][owner] + np.minimum(within // PASSAGE, each[owner] - 1)
    size = np.bincount(passage, minlength=total).astype(float)
    some = np.maximum(size, 1)
    length = (ends - starts).astype(float)
    bytes_of = np.maximum(np.bincount(passage, length, total), 1)
    for k in range(6):
        sums = np.concatenate([[0], np.cumsum(_CLASSES[raw, k])])
        out[:, k] = np.bincount(passage, sums[ends] - sums[starts], total) / bytes_of
    mean = np.bincount(passage, length, total) / some
    out[:, 6] = mean / 10
    out[:, 7] = np.sqrt(np.maximum(0, np.bincount(passage, length**2, total) / some - mean**2)) / 10
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
    out[:, 8] = np.bincount(passage, same, total) / some
    order = np.lexsort((words, passage))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    out[:, 9] = np.bincount(passage[order][new], minlength=total) / some
    letter = raw[starts]
    out[:, 10] = np.bincount(passage, (letter >= 65) & (letter <= 90), total) / some
    tail = raw[ends - 1]
    out[:, 11] = np.bincount(passage, ~((tail >= 97) & (tail <= 122)) & (tail < 128), total) / some
    out[:, 12] = np.minimum(1, size / PASSAGE)
    sign = np.where(words >> np.uint64(63), 1.0, -1.0)
    cell = passage * HASHED + ((words >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64)
    hashed = np.bincount(cell, sign, total * HASHED).reshape(total, HASHED)
    out[:, 13:] = hashed / np.sqrt(some)[:, None] / 4
    out[size == 0] = 0
    return out, bag


@dataclass
class Model:
    """Weights: encoder, attention (tanh branch, gate branch, their scorer) and classifier."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["look"]), 1 / (1 + np.exp(-(h @ w["gate"] + w["gate_bias"])))
        logit = (t * g) @ w["attend"]
        at = bag[:-1]
        peak = np.repeat(np.maximum.reduceat(logit, at), np.diff(bag))
        e = np.exp(logit - peak)
        a = e / np.repeat(np.add.reduceat(e, at), np.diff(bag))
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ w["judge"] + w["judge_bias"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward(x, bag)["score"]


def gradient(model: Model, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss in every weight."""
    sizes, at = np.diff(bag), bag[:-1]
    f = model.forward(x, bag)
    w = model.weights
    error = (f["score"] - y) / len(y)
    grad = {"judge": f["z"].T @ error, "judge_bias": np.array([error.sum()])}
    dz = error[:, None] * w["judge"]
    dz_each = np.repeat(dz, sizes, axis=0)
    da = (dz_each * f["h"]).sum(axis=1)
    mean_da = np.repeat(np.add.reduceat(f["a"] * da, at), sizes)
    dlogit = f["a"] * (da - mean_da)
    grad["attend"] = (f["t"] * f["g"]).T @ dlogit
    dt = dlogit[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
    dg = dlogit[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
    grad["look"], grad["gate"], grad["gate_bias"] = f["h"].T @ dt, f["h"].T @ dg, dg.sum(axis=0)
    dh = f["a"][:, None] * dz_each + dt @ w["look"].T + dg @ w["gate"].T
    dh *= 1 - f["h"] ** 2
    grad["encode"], grad["encode_bias"] = f["x"].T @ dh, dh.sum(axis=0)
    return grad


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit by gradient descent (Adam) on the log loss of document labels; the same data gives the same model.

    Without both labels in ``y`` there is nothing to learn: the model scores the share of
    label 1 everywhere, one half without any labels.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    weights = {
        "encode": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)),
        "encode_bias": np.zeros(HIDDEN),
        "look": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
        "gate": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
        "gate_bias": np.zeros(GATE),
        "attend": rng.normal(0, 1 / np.sqrt(GATE), GATE),
        "judge": np.zeros(HIDDEN),
        "judge_bias": np.zeros(1),
    }
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    x, y = x.astype(np.float32), y.astype(np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights["judge_bias"][0] = np.log(share / (1 - share))
    if len(x):
        model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)
    else:
        model = Model(np.zeros(d), np.ones(d), weights)
    if not len(y) or y.min() == y.max():
        return model
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, epochs + 1):
        w, grad = model.weights, gradient(model, x, bag, y)
        for k, g in grad.items():
            if not k.endswith("bias"):
                g = g + DECAY * w[k] / 10
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def spaced(x: np.ndarray, limit: int = FIT_PASSAGES) -> np.ndarray:
    """At most ``limit`` rows of a document's passages, at equal distances over the whole of it."""
    return x if len(x) <= limit else x[np.arange(limit) * len(x) // limit]


def _sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages and labels of at most ``sample`` labelled documents, picked by a hash of the key among those in ``docs``."""
    doc = F.col(key).cast("bigint")
    known = labels.select(doc.alias("doc"), F.col(label).cast("int").alias("label")).filter("doc IS NOT NULL AND label IS NOT NULL")
    known = known.filter(F.crc32(F.col("doc").cast("string").cast("binary")) % 5 != 0).groupBy("doc").agg(F.min("label").alias("label"))
    plain = docs.select(doc.alias("doc"), text_of(docs, text).alias("text"))
    picked = known.join(plain.select("doc"), "doc", "left_semi").orderBy(F.xxhash64("doc"), "doc").limit(sample)
    # Rows that repeat a key are one document, of the first of its texts, so the bound holds for rows too.
    chosen = plain.join(picked, "doc").groupBy("doc", "label").agg(F.min("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                x, bag = passages(texts)
                x = x.astype("<f4")
                rows = [spaced(x[a:b]).tobytes() for a, b in zip(bag[:-1].tolist(), bag[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("label"), pa.array(rows, pa.binary())], names=["doc", "label", "x"])

    rows = chosen.mapInArrow(encode, "doc bigint, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc"], bytes(r["x"])))
    made = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in rows]
    x = np.concatenate(made).astype(float) if made else np.zeros((0, WIDTH))
    return x, np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int64), np.array([float(r["label"] > 0) for r in rows])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Model fitted on labelled documents outside the held-out fold (crc32 of the key as text, modulo 5, is 0)."""
    return fit(*_sampled(docs, labels, key, text, label, sample))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; NULL and empty texts are one passage of zeros and get a score too.

    The score depends on the text alone, so equal texts score alike; repeated rows and keys
    keep their rows, all other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for part, texts in pieces(batch, limit=1 << 18):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(held.score(*passages(texts)), 9))], names=[key, "score"])

    plain = docs.select(F.col(key).alias(key), text_of(docs, text).alias("text"))
    return plain.mapInArrow(score, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for part, texts in pieces(batch, text, 1 << 18):
                yield part.filter(pa.array(np.round(held.score(*passages(texts)), 9) >= least))

    return docs.mapInArrow(keep, docs.schema)
