"""Quality classifier: supervised subword embeddings.

Features of a text are its words (runs between white space), pairs of neighbouring words, and its character n-grams of ``NGRAMS`` lengths
(code points, white space included), hashed into 2**BITS rows. Each row has a learned vector; a text is the average of its features' vectors; a softmax layer gives the
probability of each label. Vectors and layer are trained by stochastic gradient descent in NumPy, on a bounded sample of
labelled rows (``sample``, taken by the hash of the id), which is the only part that does not read all rows.

Because the layer is linear, a feature's part in the score is one number; scoring adds these numbers up over the whole
text, in NumPy, and divides by their count.

Defined results: null is the empty text, which has no features and the score of the layer's bias; repeated rows score
alike; a text of any length is scored whole; without labelled rows each score is 0.5; null labels are left out; other columns stay, also if one is
named like the score (which then gets an underscore); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import fresh
from tidemark.llm.bytesops import SPACE, U64, mix, runs, slices, span_hashes, utf8

BITS, DIM, NGRAMS = 18, 8, (3, 4)
SAMPLE, EPOCHS, RATE = 3000, 12, 0.5
GOLD = U64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray):
    """(feature, text) arrays, a pair for each kind of feature; texts ascend in each."""
    starts, ends = runs(~SPACE[data], offsets)
    shift = U64(64 - BITS)
    words, of = span_hashes(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1
    yield (words >> shift).astype(np.int32), of
    same = np.flatnonzero(of[1:] == of[:-1])
    yield ((mix(words[same] * U64(3)) + words[same + 1]) * GOLD >> shift).astype(np.int32), of[same]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(U64)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # of each text, in code points
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    for size in NGRAMS:
        if len(points) < size:
            continue
        key = np.full(len(points) - size + 1, size, U64)
        for k in range(size):
            key = key * U64(0x100000001B3) + points[k : k + len(key)]
        own = text[: len(key)]
        inside = np.arange(len(key)) + size <= begins[own + 1]
        yield ((mix(key) >> shift).astype(np.int32))[inside], own[inside]


class Model:
    """``weight``: of each feature in the logit of label 1; ``bias``."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for h, text in features(data, offsets):
            total += np.bincount(text, weights=self.weight[h], minlength=n)
            count += np.bincount(text, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Gradient descent on the softmax loss, a text at a time within batches of 16."""
    rng = np.random.default_rng(seed)
    rows, weights = [], []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        parts = [h for h, _ in features(raw, np.array([0, len(raw)]))]
        f, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
        rows.append(f)
        weights.append((c / max(1, c.sum())).astype(np.float32))
    embed = (rng.random((1 << BITS, DIM), dtype=np.float32) - 0.5) / DIM
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[np.asarray(labels, dtype=int)] if len(labels) else np.zeros((0, 2), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for b in range(0, len(order), 16):
            ids = order[b : b + 16]
            f = np.concatenate([rows[i] for i in ids])
            w = np.concatenate([weights[i] for i in ids])[:, None]
            sizes = np.array([len(rows[i]) for i in ids])
            of = np.repeat(np.arange(len(ids)), sizes)
            hidden, some = np.zeros((len(ids), DIM), np.float32), np.flatnonzero(sizes)
            if len(f):
                hidden[some] = np.add.reduceat(embed[f] * w, (np.cumsum(sizes) - sizes)[some], axis=0)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p - y[ids]
            back = g @ layer.T
            layer -= rate * hidden.T @ g
            bias -= 0.1 * rate * g.mean(axis=0)
            if len(f):  # averages are small: features get a larger step; those of one feature are added up first
                by = np.argsort(f, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], f[by][1:] != f[by][:-1]]))
                embed[f[by[first]]] -= np.add.reduceat((rate * 20 * w * back[of])[by], first, axis=0)
    return Model(embed @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows: those of the smallest hashes of their ids."""
    chosen = labels.where(f"{label_col} in (0, 1)").select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i", F.lit(2)), "i", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")
    rows = sorted(((r.i, r.t or "", r.y) for r in texts.orderBy(F.xxhash64("i", F.lit(2)), "i", "t").limit(sample).toLocalIterator()))
    return train([r[1] for r in rows], [r[2] for r in rows])


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``into``."""
    name = fresh(into, docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            parts = [shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
