"""Quality scores by Bradley-Terry ranking of documents.

A document's strength is linear in features of its text. It is learned from
preference pairs (a document labelled 1 preferred to one labelled 0) by logistic
loss on feature differences. A quantile of the learned scores is the threshold;
scores are mapped to 0..1 so that it lies at ``cut``.

Defined results: a null text counts as empty, and an empty text is scored like
any other; rows are scored one by one, so repeated rows and ids are no matter;
labels that are null or other than 0 and 1 teach nothing, and neither do null ids; an
id that several documents or labels share counts once, with its smallest text and label;
if either label is missing, every score is the cut itself. Very long texts are scored
whole. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

FEATURES = [
    "log_chars", "log_words", "mean_word", "upper", "digit", "symbol", "distinct_words", "same_as_before",
    "top_word", "repeated_lines", "short_words", "words_with_symbol", "compression", "few_words",
]
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
#: ASCII punctuation but for the marks of ordinary prose.
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?")


def features(text: str | None, zip_: zstd.ZstdCompressor) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = raw.split(b"\n")
    marked = sum(1 for w in words if w[-1] in _SYMBOL)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - len(words)) / m / 10,
        (len(raw) - len(raw.translate(None, _UPPER))) / n, (len(raw) - len(raw.translate(None, _DIGIT))) / n, (len(raw) - len(raw.translate(None, _SYMBOL))) / n,
        len(counts) / m, sum(map(bytes.__eq__, words, words[1:])) / m, (max(counts.values()) if counts else 0) / m,
        1 - len(set(lines)) / len(lines), sum(1 for w in words if len(w) < 4) / m, marked / m,
        len(zip_.compress(raw)) / n, float(len(words) < 8),
    ]


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        at = np.log(self.cut / (1 - self.cut)) + (z - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(at, -60, 60)))


def fit(x: np.ndarray, label: np.ndarray, cut: float = 0.7, pairs: int = 100_000, l2: float = 1e-3, steps: int = 60, seed: int = 7) -> Ranking:
    """Bradley-Terry weights from ``pairs`` drawn preference pairs, by Newton's method, and the threshold's quantile."""
    mean, scale = x.mean(0) if len(x) else np.zeros(len(FEATURES)), x.std(0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale < 1e-9, 1.0, scale)
    good, bad = np.nonzero(label == 1)[0], np.nonzero(label == 0)[0]
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(len(mean)), 0.0, 1.0, cut)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # how far the model doubts each preference
        grad = d.T @ p / pairs - l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the quantile of all scores that parts the labels best; the middle one where several do equally well
    levels = np.unique(np.quantile(s, np.linspace(0, 1, 2001)))
    sg, sb = np.sort(s[good]), np.sort(s[bad])
    right = (1 - np.searchsorted(sg, levels) / len(sg)) + np.searchsorted(sb, levels) / len(sb)
    best = np.nonzero(right >= right.max() - 1e-12)[0]
    threshold = float((levels[best[0] - 1 if best[0] else 0] + levels[best[-1]]) / 2)
    return Ranking(mean, scale, w, threshold, max(1e-6, float(np.median(np.abs(s - threshold))) / 2), cut)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, cut: float = 0.7) -> Ranking:
    """A ranking from labelled documents.

    The sample is bounded: about ``max_rows`` rows of ``labels``, by a hash of
    the id. Its texts become features on the executors; the driver gets only those.
    """
    usable = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    n = usable.count()
    part = usable.filter(F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53)) < min(1.0, max_rows / max(1, n)))
    # broadcast: about max_rows pairs of numbers; an id counts once, so that the driver gets no more rows than that
    once = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(part), "id").groupBy("id").agg(F.min("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = once.select("y", "text")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstd.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py(), zip_) for t in b.column(1)], pa.list_(pa.float64()))], names=["y", "x"])

    got = map_arrow(rows, run, schema).orderBy("y", "x").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(), cut)


def score(docs: DataFrame, ranking: Ranking, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``, from the text alone; a kept column of that name gives way."""
    inputs = docs.select(*[k for k in keep if k.lower() != "score"], F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*inputs.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstd.ZstdCompressor(level=1)
        for b in batches:
            x = np.array([features(t.as_py(), zip_) for t in b.column(b.num_columns - 1)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ranking.scores(x), pa.float64())], names=[*b.schema.names[:-1], "score"])

    return map_arrow(inputs, run, schema)
