"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives a row of statistics. cos(x W + b) with Gaussian W approximates a Gaussian kernel over them. Ridge
regression is solved from normal equations that are summed by partition. Scores are then made probabilities by
isotonic regression on scores of the half of the sample that a model was not fitted on.

The model is fitted on a sample of at most ``bound`` labelled rows; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, remainder, table, training_sample, written

MODULUS, HELD_OUT, THRESHOLD, BOUND = 5, 0, 0.3, 20_000
FEATURES, SCALE, RIDGE, BINS = 160, 3.0, 1e-3, 400
#: Partitions of the sample; its normal equations are as many matrices on the driver.
SAMPLE_PARTS = 8

_CLASS = np.full(256, 7, np.int64)
_CLASS[128:] = 6
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[44, 46, 59, 58, 39, 34, 40, 41, 45, 63]] = 5


def statistics(text: str | None) -> np.ndarray:
    """16 statistics of a whole text, in about [0, 4]; a null text counts as empty."""
    raw = (text or "").encode()
    out = np.zeros(16)
    n = len(raw)
    out[0] = np.log1p(n) / 4
    if not n:
        return out
    out[1:9] = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = raw.split()
    if words:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out[9] = lengths.mean() / 8
        out[10] = lengths.std() / 8
        out[11] = len(set(words)) / len(words)
        pairs = set(zip(words, words[1:], words[2:]))
        out[12] = len(pairs) / max(1, len(words) - 2)
    lines = [x for x in raw.split(b"\n") if x]
    out[13] = len(set(lines)) / max(1, len(lines))
    out[14] = np.log1p(n / max(1, len(lines))) / 4
    out[15] = np.log1p(len(words)) / 4
    return out


def matrix(texts) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, 16))


@dataclass
class Model:
    center: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.center) / self.spread @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, weights=None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(knots: np.ndarray, good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing rates nearest to good / n, weighted by n."""
    blocks: list[list[float]] = []
    for g, c in zip(good, n):
        blocks.append([g, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / c) for g, c, k in blocks]) if blocks else np.zeros(0)


def fit(documents: DataFrame, labels: DataFrame, seed: int = 5, bound: int = BOUND) -> Model:
    """Fit on the training fold. Without any labelled row, every score is 0.5; with one class, that class's rate."""
    sample = F.broadcast(training_sample(labels, "quality", MODULUS, HELD_OUT, bound, seed))
    texts = documents.join(sample, "doc_id").select("doc_id", "text", "y")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b.text)
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "x": list(x)})

    rows = texts.mapInPandas(measure, "doc_id long, y int, x array<double>")
    rows = written(rows.withColumn("half", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)).cast("int")), "quality-sample")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(16)], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(16)]).first()
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(16, FEATURES)) / SCALE, rng.uniform(0, 2 * np.pi, FEATURES)
    if not got.n:
        return Model(np.zeros(16), np.ones(16), turn, shift, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    center = np.array([got[f"m{i}"] for i in range(16)])
    spread = np.maximum([got[f"s{i}"] for i in range(16)], 1e-3)
    model = Model(center, spread, turn, shift, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, got.rate))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for b in batches:
            for half in (0, 1):
                own = b[b.half == half]
                if len(own):
                    z = model.features(np.stack(own.x))
                    total[half] += z.T @ np.column_stack([z, own.y])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.coalesce(SAMPLE_PARTS).mapInPandas(sums, "sums binary").collect()
    total = sum(np.frombuffer(r.sums).reshape(2, FEATURES + 1, FEATURES + 2) for r in parts)

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :-1] + RIDGE * max(1.0, a[-1, -2]) * np.eye(FEATURES + 1), a[:, -1])

    crossed = [solve(total[1]), solve(total[0])]
    model.weights = solve(total[0] + total[1])

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b.x)
            s = np.where(b.half == 0, model.raw(x, crossed[0]), model.raw(x, crossed[1]))
            yield pd.DataFrame({"bin": np.clip(np.round(s * BINS), -BINS, 2 * BINS).astype(np.int64), "y": b.y})

    bins = rows.mapInPandas(held, "bin long, y int").groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.knots = np.array([r.bin / BINS for r in bins])
    good, n = np.array([r.good for r in bins], float), np.array([r.n for r in bins], float)
    model.values = isotonic(model.knots, good, n)
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """documents with ``score`` (double); a column of that name is replaced. The score depends on the text alone."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(model.scores(matrix(texts)))
        release()
        return out

    return documents.withColumn("score", score("text"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without those that the classifier rejects."""
    return scored(documents, fit(documents, labels)).where(F.col("score") >= threshold).select(*documents.columns)


def op10_quality_rff(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = scored(documents.select("doc_id", "text"), fit(documents, labels))
    return rows.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
