"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; each passage becomes a vector (shares of character
kinds, word lengths, repetition, hashed words), a hidden layer encodes it, gated attention
(tanh times sigmoid) gives its weight, and the weighted sum of a document's passages gives the
probability of label 1. Only document labels are needed. All passages of a text are read.

The network is fitted with Adam on at most MOST_LABELLED labelled documents, those whose ids hash
lowest, or fewer when their passage vectors come to MOST_BYTES; these vectors are made by Spark and
are all that the driver sees. Scoring is one
pass without a shuffle.

Defined cases: null and empty texts are one passage of zeros and get the score that gives; a
label that is null is not learned from; a document with several labels has the largest; with
labels of one kind only, or none, every score is that share (0.5 if none); rows are independent.
Other columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.arrow_text import SPACED_LOWER, slices, tokenize

PASSAGE = 64
#: Documents with a label to fit on, at most, and bytes of their passage vectors (the last document may go over it).
MOST_LABELLED, MOST_BYTES = 4000, 64 << 20
HASHED = 64
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 24, 12, 200, 0.02, 1e-4, 7
#: Kinds of characters whose share of a passage's bytes is a feature.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&", b"|", b"<>/\\", b"\n", b"()[]{}", b"@_=+~^", bytes(range(0x80, 0x100))]
WIDTH = len(KINDS) + 6 + HASHED


def encode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each passage, and each text's first one (with the count at the end)."""
    tok = tokenize(col, SPACED_LOWER)
    counts = np.diff(tok.rows)
    per_text = np.maximum(-(-counts // PASSAGE), 1)
    rows = np.concatenate([[0], np.cumsum(per_text)])
    x = np.zeros((rows[-1], WIDTH), np.float32)
    n = len(tok.hash)
    if not n:
        return x, rows
    text = tok.row_of()
    passage = rows[text] + (np.arange(n) - tok.rows[text]) // PASSAGE
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    own = passage[first]
    last = np.concatenate([first[1:], [n]]) - 1
    size = np.diff(np.concatenate([first, [n]])).astype(np.float32)
    begin, end = tok.begin[first], tok.end[last]
    span = np.maximum(end - begin, 1).astype(np.float32)
    for k, kind in enumerate(KINDS):
        table = np.zeros(256, bool)
        table[list(kind)] = True
        sums = np.concatenate([[0], np.cumsum(table[tok.data], dtype=np.int32)])
        x[own, k] = (sums[end] - sums[begin]) / span
    length = (tok.end - tok.begin).astype(np.float32)
    mean = np.add.reduceat(length, first) / size
    at = len(KINDS)
    x[own, at] = mean / 10
    x[own, at + 1] = np.sqrt(np.maximum(np.add.reduceat(length**2, first) / size - mean**2, 0)) / 10
    x[own, at + 2] = size / PASSAGE
    order = np.lexsort((tok.hash, text))
    new = np.concatenate([[True], (np.diff(tok.hash[order]) != 0) | (np.diff(text[order]) != 0)])
    group = np.cumsum(new) - 1
    times = np.empty(n, np.float32)
    times[order] = np.bincount(group)[group]
    x[own, at + 3] = np.add.reduceat(np.log(times), first) / size
    x[own, at + 4] = np.add.reduceat((length == 1).astype(np.float32), first) / size
    x[own, at + 5] = np.log1p(counts[text[first]]) / 10
    key = passage * HASHED + (tok.hash % np.uint64(HASHED)).astype(np.int64)
    x[:, at + 6 :] = np.bincount(key, minlength=rows[-1] * HASHED).reshape(-1, HASHED)
    x[own, at + 6 :] /= size[:, None]
    return x, rows


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    share: float | None = None  #: the score of everything, where there was nothing to learn

    def score(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(rows) - 1, self.share)
        return _sigmoid(_forward(self.weights, (x - self.mean) / self.scale, rows)["logit"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    first, size = rows[:-1], np.diff(rows)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    p = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    p /= np.repeat(np.add.reduceat(p, first), size)
    z = np.add.reduceat(p[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "p": p, "z": z, "logit": z @ w["c"] + w["d"]}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    first, size = rows[:-1], np.diff(rows)
    f = _forward(w, x, rows)
    d = (_sigmoid(f["logit"]) - y) / len(y)
    out = {"c": f["z"].T @ d, "d": d.sum(keepdims=True)}
    dz = np.repeat(d[:, None] * w["c"], size, axis=0)
    dp = (dz * f["h"]).sum(axis=1)
    de = f["p"] * (dp - np.repeat(np.add.reduceat(dp * f["p"], first), size))
    dh = f["p"][:, None] * dz
    out["a"] = (f["t"] * f["g"]).T @ de
    dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (dh + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    out["W"], out["b"] = x.T @ dh, dh.sum(axis=0)
    return out


def fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> Model:
    """Fit to bags x[rows[i]:rows[i + 1]] with labels y of 0 and 1."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), {}, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(SEED)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        for k, d in _gradient(w, x, rows, y).items():
            d = d + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> Model:
    """Learn from labelled documents for whose label rows `where` holds, `most` of them and most_bytes of vectors at most."""
    marks = labels.filter(where) if where is not None else labels
    marks = marks.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "y", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, first = encode(b.column("text"))
            made = [x[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("y"), pa.array(made, pa.binary())], names=["_id", "y", "x"])

    schema = T.StructType([rows.schema["_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    got, held = [], 0
    for r in rows.mapInArrow(vectors, schema).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").toLocalIterator():
        got.append((r["_id"], r["y"], bytes(r["x"])))
        held += len(got[-1][2])
        if held >= most_bytes:
            break
    got.sort(key=lambda r: r[0])
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in got]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), first, np.array([r[1] for r in got], np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns with score (probability of label 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            s = sent.value.score(*encode(b.column(text_col))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(np.clip(s, 0, 1))], names=schema.names)

    return docs.select(*[f.name for f in kept]).mapInArrow(score, schema)
