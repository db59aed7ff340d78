"""Quality classifier on document statistics (operator 5).

1. Every whole text gives a vector of statistics: lengths, shares of kinds of bytes, words, lines and
   sentences, repetition. Neither labels nor language, source or identifier enter it.
2. Random Fourier features (a fixed draw) approximate a Gaussian kernel on the standardised statistics.
3. Ridge regression by normal equations: each partition sums its own, for four
   folds apart; the partial sums meet in a tree of small groups. All labelled rows take part; what the driver gets
   has a size that depends on the number of features alone.
4. Isotonic calibration: each fold is scored by the model of the other three, the scores are counted in
   bins, and pooled adjacent violators make the calibration curve.

Rows are held out from all of this if the CRC-32 of their identifier as text is divisible by five; the
remainders 1 to 4 are the folds.

Defined results: null and empty texts are scored like others, by statistics of zero; repeated labels of a
document count by their mean, null labels not at all; without usable labels every score is 0.5, with
labels of one kind the score is their mean; rows without identifier are scored and not learnt from;
an empty table gives no rows. The columns of the table stay, and an output column that exists already is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from formloom.llm.arrow import fresh
from formloom.session import load, written

FOURIER, RIDGE, BINS, SEED = 192, 1e-3, 2000, 5
#: Rows of the normal equations that travel together, and partial sums that meet at once.
BLOCK_ROWS, MEET = 16, 32
FEATURES = 26
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b"!?", b":;'\"", b"()[]{}", b"|", b"#$%&*@^~", b"-_/\\<>=+"]
_SENTENCE = re.compile(rb"[.!?]+(?=\s|$)")


def statistics(text: bytes) -> list[float]:
    """The statistics of a text's bytes."""
    n = len(text)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = [float(counts[list(kind)].sum()) / n for kind in _KINDS]
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    each, each_line = Counter(words), Counter(lines)
    w = max(1, len(words))
    letters = max(1e-9, shares[0] + shares[1])
    return [
        math.log1p(n),
        math.log1p(len(words)),
        sum(map(len, words)) / w,
        max(map(len, words), default=0) ** 0.5,
        *shares,
        float(counts[128:].sum()) / n,
        entropy,
        len(each) / w,
        len(each) / math.sqrt(w),
        max(each.values(), default=0) / w,
        sum(len(x) * k for x, k in each_line.items() if k > 1) / n,
        math.log1p(n / max(1, len(lines))),
        math.log1p(w / (1 + len(_SENTENCE.findall(text)))),
        sum(k for x, k in each.items() if x.isupper()) / w,
        shares[1] / letters,
    ]


@arrow_udf(T.ArrayType(T.FloatType()))
def statistics_of(values: pa.Array) -> pa.Array:
    """:func:`statistics` of a binary column."""
    seen: dict[bytes, list[float]] = {}
    made = []
    for value in values:
        value = value.as_py() or b""
        found = seen.get(value)
        if found is None:
            found = seen[value] = statistics(value)
        made.append(found)
    return pa.array(made, type=pa.list_(pa.float32()))


def fold(doc_id: Column) -> Column:
    """0: held out; 1 to 4: the folds; null without identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class Fourier:
    """Standardises statistics and maps them to cosines of random projections, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int = FOURIER, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.standard_normal((d, size)) / math.sqrt(d)
        self.shift = rng.uniform(0, 2 * math.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        return np.column_stack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), z, np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _summed(train: DataFrame, features: Fourier) -> dict[int, np.ndarray]:
    """The normal equations of each fold: features times (features, label, squared label)."""
    width = len(features.shift) + len(features.mean) + 1

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, folds = features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False)
            for f in np.unique(folds):
                own = z[folds == f]
                total[int(f)] = total.get(int(f), 0) + own.T @ np.column_stack([own, y[folds == f]])
        part = TaskContext.get().partitionId()
        for f, a in total.items():
            cut = [(f, at, part, a[at : at + BLOCK_ROWS].tobytes()) for at in range(0, width, BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*cut, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["fold", "at", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
        first = lambda c: table[c][0].as_py()
        return pa.table([[first("fold")], [first("at")], [first("up")], [total.tobytes()]], schema=pa.schema([("fold", pa.int32()), ("at", pa.int32()), ("part", pa.int64()), ("sums", pa.binary())]))

    schema = "fold int, at int, part long, sums binary"
    parts = train.select("features", "label", "fold").mapInArrow(sums, schema)
    for up in (F.floor(F.col("part") / MEET).cast("long"), F.lit(0).cast("long")):
        parts = parts.withColumn("up", up).groupBy("fold", "at", "up").applyInArrow(add, schema)
    found: dict[int, np.ndarray] = {}
    for row in parts.collect():  # folds x features x features
        found.setdefault(row.fold, np.zeros((width, width + 1)))[row["at"] : row["at"] + BLOCK_ROWS] = np.frombuffer(row.sums).reshape(-1, width + 1)
    return found


def _solve(sums: list[np.ndarray], ridge: float) -> np.ndarray:
    a = sum(sums)
    n = max(1.0, a[-1, -2])
    penalty = ridge * n * np.eye(len(a))
    penalty[-1, -1] = 1e-9 * n
    return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])


def pooled(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means ``total / weight`` at ascending ``x``: the knots of a curve that never falls."""
    blocks: list[list[float]] = []
    for a, w, t in zip(x, weight, total, strict=True):
        blocks.append([a * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


class QualityModel:
    """Scores statistics between 0 and 1; higher: label 1 is likelier."""

    def __init__(self, features: Fourier | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray]):
        self.features, self.weights, self.knots = features, weights, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at, value = self.knots
        if self.features is None or not len(at):
            return np.full(len(x), value[0] if len(value) else 0.5)
        return np.clip(np.interp(self.raw(x), at, value), 0, 1)


def fit_quality(table: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Learns from the rows of ``table`` (doc_id, features) that have a label and are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    train = written(table.select("doc_id", "features").join(known, "doc_id").withColumn("fold", fold(F.col("doc_id")).cast("int")).where("fold != 0"), "train")
    sums = [x for i in range(FEATURES) for x in (F.sum(F.col("features")[i].cast("double")), F.sum(F.col("features")[i].cast("double") * F.col("features")[i]))]
    n, low, high, mean_label, *moments = train.agg(F.count("*"), F.min("label"), F.max("label"), F.avg("label"), *sums).first()
    if not n or low == high:
        return QualityModel(None, None, (np.array([]), np.array([mean_label] if n else [])))
    first, second = np.array(moments[::2]) / n, np.array(moments[1::2]) / n
    features = Fourier(first, np.sqrt(np.maximum(0, second - first * first)))
    equations = _summed(train, features)
    models = {f: _solve([a for g, a in equations.items() if g != f] or [equations[f]], RIDGE) for f in equations}

    def bins(batches):
        for batch in batches:
            z, folds = features(_matrix(batch.column(0))), batch.column(2).to_numpy(zero_copy_only=False)
            raw = np.empty(len(z))
            for f, w in models.items():
                raw[folds == f] = z[folds == f] @ w
            place = np.floor((np.clip(raw, -1, 2) + 1) / 3 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.clip(raw, -1, 2)), batch.column(1)], names=["bin", "raw", "label"])

    curve = train.select("features", "label", "fold").mapInArrow(bins, "bin long, raw double, label double").groupBy("bin").agg(F.avg("raw"), F.count("*"), F.sum("label")).orderBy("bin").collect()  # at most BINS + 1 rows
    at, weight, total = (np.array([row[i] for row in curve], dtype=float) for i in (1, 2, 3))
    return QualityModel(features, _solve(list(equations.values()), RIDGE), pooled(at, weight, total))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    table = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), statistics_of(F.col(text).cast("binary")).alias("features")), "statistics")
    model = fit_quality(table, labels)
    score = _scorer(model)
    return table.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score("features").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scorer(model: QualityModel):
    @arrow_udf(T.DoubleType())
    def score(values: pa.Array) -> pa.Array:
        return pa.array(np.round(model.score(_matrix(values)), 9)) if len(values) else pa.array([], type=pa.float64())

    return score


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were.

    Statistics are computed twice, for the fit and for the filter, so that texts need not be shuffled or written.
    """
    fresh(docs, "__score__")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    learnt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), statistics_of(F.col(text).cast("binary")).alias("features"))
    model = fit_quality(written(learnt.join(known, "doc_id", "left_semi"), "statistics"), labels)
    return docs.withColumn("__score__", _scorer(model)(statistics_of(F.col(text).cast("binary")))).where(F.col("__score__") >= threshold).drop("__score__")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return quality_scores(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
