"""Small models fitted by aggregation: the sums that a model needs are added up where the rows are, and only they reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that may not be features of a ranker, since they tell of its target.
FORBIDDEN = {"label", "balanced_gain", "balanced_relative_gain", "gain", "target_gain", "oracle_rank", "after_distance"}


def check_features(rows: DataFrame, features: list[str]) -> None:
    """An error for forbidden, missing, null or non-finite features."""
    if bad := sorted(set(features) & FORBIDDEN):
        raise ValueError(f"features that leak the target: {bad}")
    if missing := [f for f in features if f not in rows.columns]:
        raise ValueError(f"missing features: {missing}")
    wrong = [F.sum((F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f)) == float("inf"))).cast("long")).alias(f) for f in features]
    found = rows.agg(*wrong).first().asDict()
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(f"features that aren't finite: {bad}")


@dataclass
class Linear:
    """score = bias + sum(weight * (x - mean) / scale)."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self) -> Column:
        parts = [float(w) * (F.col(f) - float(m)) / float(s) for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights)]
        return sum(parts, F.lit(float(self.bias)))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.score()))


def scaler(rows: DataFrame, features: list[str], floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    r = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean, std = (np.array([r[f"{k}{i}"] or 0.0 for i in range(len(features))], float) for k in "ms")
    return mean, np.where(std < floor, 1.0, std)


def fit_centroid_ranker(rows: DataFrame, features: list[str], label: str) -> Linear:
    """Weights from the negatives' to the positives' mean, with the score 0 half-way, on scaled features."""
    check_features(rows, features)
    mean, scale = scaler(rows, features)
    got = {r[label]: np.array([r[f] for f in features], float) for r in rows.groupBy(label).agg(*[F.avg(f).alias(f) for f in features]).collect()}
    if set(got) != {0, 1}:
        raise ValueError("both labels are needed")
    pos, neg = (got[1] - mean) / scale, (got[0] - mean) / scale
    weights = pos - neg
    return Linear(features, mean, scale, weights, -float((pos + neg) / 2 @ weights))


def gram(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products of every two columns, their sums and the number of rows, in one aggregation."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    r = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    g = np.zeros((n, n))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"p{i}_{j}"] or 0.0
    return g, np.array([r[f"s{i}"] or 0.0 for i in range(n)]), r["n"]


def fit_ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> Linear:
    """Ridge regression on scaled features; the intercept, the target's mean, isn't penalised."""
    check_features(rows, [*features])
    mean, scale = scaler(rows, features)
    middle, k = float(rows.agg(F.avg(target)).first()[0] or 0.0), len(features)
    # products of scaled columns: those of raw ones lose all digits where a mean is far above its deviation
    scaled = rows.select(*[((F.col(f) - float(m)) / float(s)).alias(f"x{i}") for i, (f, m, s) in enumerate(zip(features, mean, scale))], (F.col(target) - middle).alias("y"))
    g = gram(scaled, [*[f"x{i}" for i in range(k)], "y"])[0]
    return Linear(features, mean, scale, np.linalg.solve(g[:k, :k] + penalty * np.eye(k), g[:k, k]), middle)


def nearest_centroid_metrics(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """One row: accuracy, balanced accuracy and the share of test rows of a known label, by the nearest mean of ``(label, v)`` in cosine."""
    from ..functions.numeric import dot, unit
    from .representations import centroids

    means = centroids(train, label).select(label, unit(F.col("v")).alias("c"))
    book = means.agg(F.array_sort(F.collect_list(F.struct(label, "c"))).alias("book"))
    near = F.array_min(F.transform("book", lambda c: F.struct((1 - dot(F.col("u"), c["c"])).alias("d"), c[label].alias("l"))))
    got = test.withColumn("u", unit(F.col("v"))).join(F.broadcast(book)).withColumn("guess", near["l"]).withColumn("known", F.exists("book", lambda c: c[label] == F.col(label)))
    right = (F.col("guess") == F.col(label)).cast("double")
    each = got.groupBy(label).agg(F.avg(right).alias("r"), F.count("*").alias("n"), F.sum(right).alias("hit"), F.sum(F.col("known").cast("int")).alias("known"))
    return each.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg("r").alias("balanced_accuracy"), (F.sum("known") / F.sum("n")).alias("known_fraction"))


def ridge_classes(train: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> dict[object, Linear]:
    """One ridge regression for each class's indicator; the largest score names the class."""
    kinds = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    return {k: fit_ridge(train.withColumn("__y", (F.col(label) == k).cast("double")), features, "__y", penalty) for k in kinds}


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Covariance, mean and number of ``rows(v)``: each batch gives its products less its mean, which are joined pairwise, so no digits go where the mean is large."""
    import pyarrow as pa

    def run(batches):
        n, mean, m2 = 0, None, None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
            if not len(x):
                continue
            own = x.mean(0)
            part = (x - own).T @ (x - own)
            if mean is None:
                n, mean, m2 = len(x), own, part
            else:
                n, mean, m2 = _joined((n, mean, m2), (len(x), own, part))
        if mean is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "mean", "m2"])

    total = None
    for r in rows.select("v").mapInArrow(run, "n long, mean array<double>, m2 array<double>").toLocalIterator():
        d = len(r["mean"])
        one = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(d, d))
        total = one if total is None else _joined(total, one)
    if total is None:
        return np.zeros((0, 0)), np.zeros(0), 0
    return total[2] / total[0], total[1], total[0]


def _joined(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def pca_error(support: DataFrame, targets: DataFrame, components: int = 8) -> float:
    """The targets' mean squared error after projection on the support's first components; rows are ``(v)``."""
    size = F.size("v")
    cov, mean, n = moments(support)
    if not n:
        return float("nan")
    values, vectors = np.linalg.eigh(cov)
    basis = vectors[:, np.argsort(-values)[: min(components, len(mean), n)]].T
    centred = F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    parts = [F.aggregate(F.zip_with("c", F.array(*map(F.lit, b.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for b in basis]
    kept = sum((q * q for q in parts), F.lit(0.0))
    return float(targets.withColumn("c", centred).select((F.greatest(energy("c") - kept, F.lit(0.0)) / size).alias("e")).agg(F.avg("e")).first()[0])


def forecast_examples(series: DataFrame, value: str, history: int = 8, most: int = 128) -> DataFrame:
    """clip, idx, x1 .. xh (the values before, nearest first) and y; of each clip at most ``most`` evenly spaced examples, which is the feature's own limit."""
    w = Window.partitionBy("clip").orderBy("idx")
    rows = series.select("clip", "idx", F.col(value).alias("y"), *[F.lag(value, k).over(w).alias(f"x{k}") for k in range(1, history + 1)]).filter(F.col(f"x{history}").isNotNull())
    at, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("clip"))
    rows = rows.withColumn("__at", at).withColumn("__n", n)
    step = F.greatest(F.lit(1.0), F.col("__n") / most)
    return rows.filter(F.floor((F.col("__at") - 1) / step) > F.floor((F.col("__at") - 2) / step)).drop("__at", "__n")


def forecast_mse(train: DataFrame, test: DataFrame, history: int = 8, penalty: float = 0.01) -> float:
    """Mean squared error on ``test`` examples of a ridge autoregression fitted on ``train`` examples."""
    model = fit_ridge(train, [f"x{k}" for k in range(1, history + 1)], "y", penalty)
    return float(test.agg(F.avg(F.pow(F.col("y") - model.score(), 2))).first()[0])


def effective_rank(rows: DataFrame) -> float:
    """exp of the entropy of the covariance's eigenvalues of ``rows(v)``."""
    p = np.clip(np.linalg.eigvalsh(moments(rows)[0]), 0, None)
    p = p / p.sum() if p.sum() > 0 else p
    return float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
