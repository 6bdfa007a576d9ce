"""Operator 7, quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the log ratio of their class counts; a linear model with
hinge loss is fitted on them by dual coordinate descent and mixed with its mean weight, as naive
Bayes would have it. N-grams are over words, over kinds of characters (upper, lower, digit, other
letter, each punctuation mark) and over whether a word repeats the one before it, so that forms as
well as words count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm import hashing as H
from deskloom.llm.common import col, documents, labels, text_of

BUCKETS = 1 << 18
#: Bound on the labelled rows whose n-grams are counted: those of the least hashed ids.
COUNTED = 1 << 18
#: Bound on the labelled rows of each class that the linear model is fitted on.
FITTED = 2048
SMOOTHING = 1.0
#: Share of the fitted weights; the rest is their mean size, which leaves the log ratios alone.
MIXED = 0.25
COST = 1.0
ROUNDS = 20

_KINDS = np.full(256, 1, np.uint64)  # other letters
_KINDS[: 0x80] = np.arange(0x80) + 8  # punctuation as itself
_KINDS[ord("a") : ord("z") + 1] = 2
_KINDS[ord("A") : ord("Z") + 1] = 3
_KINDS[ord("0") : ord("9") + 1] = 4


def _runs(symbols: np.ndarray, n: int, kind: int) -> np.ndarray:
    """A hash of every run of ``n`` symbols."""
    factor = H.weights(n, 10 + kind)
    size = max(0, len(symbols) - n + 1)
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total += symbols[i : i + size] * factor[i]
    return H.mix(total + np.uint64(kind))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of the n-grams of each document of a slice."""
    hashes, _, first = H.words(data, offsets, fold=False)
    kinds = _KINDS[data]
    mask = np.uint64(BUCKETS - 1)
    for d in range(len(offsets) - 1):
        own = hashes[first[d] : first[d + 1]]
        marks = kinds[offsets[d] : offsets[d + 1]]
        again = np.zeros(len(own), np.uint64)
        again[1:] = own[1:] == own[:-1]
        found = [_runs(own, 1, 1), _runs(own, 2, 2), _runs(marks, 3, 3), _runs(marks, 5, 4), _runs(again + np.uint64(1), 3, 5)]
        yield np.unique(np.concatenate(found) & mask).astype(np.int32)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, how many documents of each class have a bucket."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy()
        for row, _, data, offsets in H.slices(batch, "text"):
            for i, own in enumerate(features(data, offsets)):
                counts[label[row + i]][own] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "n0", "n1"])


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in H.slices(batch, "text"):
            yield pa.record_batch([
                batch.column("label").slice(row, end - row), pa.array(list(features(data, offsets)), pa.list_(pa.int32())),
            ], names=["label", "buckets"])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared norm plus ``cost`` times hinge loss, by dual coordinate descent.

    A row is its buckets' ratios at unit length, with a constant 1 beside them. A row's dual
    variable stays between 0 and ``cost``; each step solves for one of them exactly.
    """
    weight, bias, rng = np.zeros(len(ratio)), 0.0, np.random.default_rng(0)
    values = []
    for own in rows:
        x = ratio[own]
        values.append(x / (np.sqrt((x * x).sum()) or 1.0))
    dual = np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            own, x = rows[i], values[i]
            slope = y[i] * (x @ weight[own] + bias) - 1
            new = min(max(dual[i] - slope / (x @ x + 1), 0.0), cost)
            step = (new - dual[i]) * y[i]
            if step:
                weight[own] += step * x
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


def fit(
    df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    counted: int = COUNTED, fitted: int = FITTED,
) -> Callable[[Column], Column]:
    """A scorer: a column of texts to the odds, 0 to 1, that label 1 fits.

    Labels come from ``labelled`` rows whose id's crc32 mod 3 is not 1. Rows with a null id or
    label are ignored; of several labels of an id the largest counts; ids on several documents
    count each of them. At most ``counted`` rows are counted and ``2 * fitted`` fitted, in the
    order of their hashed ids. Without labels of both classes the scorer gives 0.5 throughout.
    """
    known = labelled.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("place", F.xxhash64("id"))
    docs = df.select(col(id_col).alias("id"), text_of(text_col).alias("text"))

    def texts(ids: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(ids.select("id", "label")), "id").select("text", "label")

    sums = (
        texts(known.orderBy("place", "id").limit(counted))  # broadcast: at most ``counted`` ids
        .mapInArrow(_class_counts, "bucket long, n0 long, n1 long")
        .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    )  # at most BUCKETS rows
    counts = np.full((2, BUCKETS), SMOOTHING)
    counts[0, sums["bucket"]] += sums["n0"]
    counts[1, sums["bucket"]] += sums["n1"]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    some = [known.where(F.col("label") == k).orderBy("place", "id").limit(fitted) for k in (0, 1)]
    rows = texts(some[0].union(some[1])).mapInArrow(_with_features, "label int, buckets array<int>").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return lambda text: F.lit(0.5)
    y = np.where(label == 1, 1.0, -1.0)
    buckets = [x.values.to_numpy() for x in rows.column("buckets")]
    # A fixed order, as rows arrive in any.
    order = sorted(range(len(buckets)), key=lambda i: (label[i], len(buckets[i]), buckets[i].tobytes()))
    weight, bias = descend([buckets[i] for i in order], y[order], ratio)
    weight = (1 - MIXED) * np.abs(weight[weight != 0]).mean() + MIXED * weight
    margins = np.array([_margin(own, ratio, weight) for own in buckets])
    bias, slope = _calibrated(margins, y)
    model = df.sparkSession.sparkContext.broadcast((ratio, weight, bias, slope))  # two numbers a bucket

    @F.arrow_udf("double")
    def scorer(text: pa.Array) -> pa.Array:
        return _scores(text, *model.value)

    return scorer


def _margin(own: np.ndarray, ratio: np.ndarray, weight: np.ndarray) -> float:
    x = ratio[own]
    return float(x @ weight[own] / (np.sqrt((x * x).sum()) or 1.0))


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope: the cut with the least mistakes, in the middle of its gap, and a spread."""
    order = np.argsort(margins)
    m, up = margins[order], y[order] > 0
    wrong = np.concatenate(([0], np.cumsum(up))) + np.concatenate((np.cumsum(~up[::-1])[::-1], [0]))
    edges = np.concatenate(([m[0]], (m[1:] + m[:-1]) / 2, [m[-1]]))
    best = np.flatnonzero(wrong == wrong.min())
    cut = float(edges[best[len(best) // 2]])
    return cut, 4 / max(float(m[up].mean() - m[~up].mean()) / 2, 1e-9)


def _scores(text: pa.Array, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float) -> pa.Array:
    out = []
    for _, _, data, offsets in H.slices(pa.record_batch([text], names=["text"]), "text"):
        out += [_margin(own, ratio, weight) for own in features(data, offsets)]
    return pa.array(1 / (1 + np.exp(-np.clip(slope * (np.array(out, float) - bias), -500, 500))), pa.float64())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null text counts as empty; empty texts have the score of a text without any n-gram. A null
    id is not held out. Repeated rows are scored alike. An empty table gives an empty result.
    Only the text is scored; other columns are ignored.
    """
    scorer = fit(df, labelled, id_col, text_col, **options)
    scored = df.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), scorer(text_of(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality(spark, sf_dir):
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))
