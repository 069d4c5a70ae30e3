"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import LOWER, NOT_WHITE, Words, held_out, labelled_sample, map_texts

#: Classes of bytes: other, lower, upper, digit, blank, line end, comma or stop, bar, shout, symbol, quote, bracket.
_CLASSES = 12
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\f",
                             b"\n", b".,;:", b"|", b"!?", b"#*$%&<>~^=+_/\\@", b"'\"`", b"()[]{}-"), start=1):
    _CLASS[list(_bytes)] = _i
_CLASS[0xA0:0xC0] = 1  # second bytes of small letters of the Latin-1 block
_CLASS[0x80:0x9F] = 2  # and of its capitals
_CLASS[0xC2:0xF5] = -1  # lead bytes are passed over
_SHAPES = _CLASSES ** 3
_RATIOS, _BINS = 8, 12
FEATURES = _SHAPES + _RATIOS * _BINS
#: A ratio is worth as much as a shape seen so often.
_RATIO_WEIGHT = 60.0


def surface_counts(texts: list[str]) -> np.ndarray:
    """Counts of shape trigrams and of binned ratios per text; the empty text has the lowest bin of each ratio."""
    raw = [t.encode() for t in texts]
    words = Words(raw, NOT_WHITE, LOWER)
    n = len(texts)
    kinds = _CLASS[words.raw]
    text_of = np.repeat(np.arange(n), np.diff(words.ends_of_texts, prepend=0))
    seen = kinds >= 0
    kinds, text_of = kinds[seen], text_of[seen]
    out = np.zeros((n, FEATURES), np.float32)
    if len(kinds) > 2:
        gram = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:]
        same = text_of[:-2] == text_of[2:]
        flat = np.bincount(text_of[:-2][same] * _SHAPES + gram[same], minlength=n * _SHAPES)
        out[:, :_SHAPES] = flat.reshape(n, _SHAPES)
    by_class = np.bincount(text_of * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    chars = np.maximum(by_class.sum(1) - 1, 1)
    count = np.maximum(words.count, 1)
    twice = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    stutter = np.bincount(words.text[1:][twice], minlength=n)
    order = np.lexsort((words.hash, words.text))
    h, t = words.hash[order], words.text[order]
    again = np.bincount(t[1:][(h[1:] == h[:-1]) & (t[1:] == t[:-1])], minlength=n)
    mean_length = np.bincount(words.text, words.length, minlength=n) / count
    ratios = np.stack([
        stutter / count, again / count, by_class[:, 9] / chars * 4, by_class[:, 8] / chars * 4, by_class[:, 7] / chars * 4,
        by_class[:, 2] / np.maximum(by_class[:, 1] + by_class[:, 2], 1), np.log2(words.count + 1) / 16, mean_length / 24,
    ], axis=1)
    bins = np.minimum((np.sqrt(np.clip(ratios, 0, 1)) * _BINS).astype(np.int64), _BINS - 1)
    rows = np.repeat(np.arange(n), _RATIOS)
    out[rows, _SHAPES + np.tile(np.arange(_RATIOS) * _BINS, n) + bins.ravel()] = _RATIO_WEIGHT
    return out


@dataclass
class QualityModel:
    """Term weights, the projection to the latent space, and the labelled vectors in it."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        tf = np.log1p(counts) * self.idf
        tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
        vec = tf @ self.projection
        return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str], block: int = 512) -> np.ndarray:
        """The vote of the nearest labelled texts, weighted by similarity; exact, in blocks of products."""
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for start in range(0, len(texts), block):
            part = texts[start:start + block]
            cosine = self.latent(surface_counts(part)) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(cosine, near, axis=1)
            weight = np.exp((best - best.max(axis=1, keepdims=True)) * self.sharpness)
            votes = (weight * self.labels[near]).sum(1) + 0.25 * self.prior
            out[start:start + block] = votes / (weight.sum(1) + 0.25)
        return np.clip(out, 0.0, 1.0)


def fit_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, rest: int = 2,
                bound: int = 6000, dims: int = 48, neighbours: int = 15, sharpness: float = 20.0) -> QualityModel:
    """Learn from at most ``bound`` labelled rows whose id is not held out.

    The features of the sample are computed in Spark tasks; the driver receives at most ``bound`` rows of FEATURES
    small numbers. Without labelled rows the model answers 1.0, that is, it rejects nothing.
    """
    sample = labelled_sample(documents, labels, label, ~held_out(modulus, rest), bound)

    def make():
        def run(texts):
            counts = np.minimum(surface_counts(texts), 65535).astype(np.uint16)
            return {"counts": [row.tobytes() for row in counts]}
        return run

    rows = map_texts(sample, "counts binary", make, keep=["doc_id", "label"]).toPandas().sort_values("doc_id")
    if not len(rows):
        empty = np.zeros((0, dims), np.float32)
        return QualityModel(np.ones(FEATURES, np.float32), np.zeros((FEATURES, dims), np.float32), empty,
                            np.zeros(0), 1.0, neighbours, sharpness)
    counts = np.stack([np.frombuffer(b, np.uint16) for b in rows["counts"]]).astype(np.float32)
    y = rows["label"].to_numpy(np.float64)
    df = (counts > 0).sum(0)
    idf = (np.log((len(y) + 1) / (df + 1)) + 1).astype(np.float32)
    model = QualityModel(idf, np.eye(1), np.zeros(0), y, float(y.mean()), neighbours, sharpness)
    tf = np.log1p(counts) * idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
    values, axes = np.linalg.eigh((tf.T @ tf).astype(np.float64))
    model.projection = np.ascontiguousarray(axes[:, ::-1][:, :dims]).astype(np.float32)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Every document with ``score`` and ``predicted``; a null text counts as empty, columns of these names give way."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bound rows x dims, FEATURES x dims

    def make():
        def run(texts):
            score = sent.value.score(texts)
            return {"score": score, "predicted": (score >= threshold).astype(np.int32)}
        return run

    return map_texts(documents, "score double, predicted int", make, keep)
