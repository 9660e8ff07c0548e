"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.llm.common import map_batches, release_memory, text_chunks
from adlint_spark.llm.grams import distinct_features

#: Hashed features: 2 ** BITS; a text's number in a run of texts takes the other bits of 32.
BITS = 18


@dataclass(frozen=True)
class Model:
    """``weights`` for hashed features (naive Bayes ratios times the fitted weights); the margin's logistic slope and intercept."""

    weights: np.ndarray
    slope: float
    intercept: float


def dual_coordinate_descent(features: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine: each step solves one row's dual variable exactly."""
    w, alpha = np.zeros(1 << BITS), np.zeros(len(y))
    square = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(np.flatnonzero(square > 0)):
            f, v = features[i], values[i]
            step = (y[i] * (w[f] @ v) - 1) / square[i]
            new = min(max(alpha[i] - step, 0.0), cost[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | margin), by Newton steps, with Platt's targets."""
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([margin, np.ones(len(y))], 1), np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * theta)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def fit(features: list[np.ndarray], label: np.ndarray, smoothing: float = 1.0, epochs: int = 15) -> Model:
    """The model of labelled rows (0/1), given by their distinct features. Every fifth row only sets the logistic curve."""
    n = len(label)
    if not n or label.min() == label.max():
        share = (label.sum() + 1) / (n + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(np.log(share / (1 - share))))
    y = np.where(label > 0, 1.0, -1.0)
    learn = np.arange(n) % 5 != 4
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn[:] = True
    counts = {s: np.full(1 << BITS, smoothing) for s in (1.0, -1.0)}
    for i in np.flatnonzero(learn):
        counts[y[i]][features[i]] += 1  # a row's features are distinct
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    values = [(v / max(np.sqrt(float(v @ v)), 1e-6)).astype(np.float32) for v in (ratio[f] for f in features)]
    kept = np.flatnonzero(learn)
    cost = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    w = dual_coordinate_descent([features[i] for i in kept], [values[i] for i in kept], y[kept], cost[kept], epochs)
    check = np.flatnonzero(~learn if not learn.all() else learn)
    slope, intercept = logistic(np.array([w[features[i]] @ values[i] for i in check]), y[check])
    # a score divides by the norm of the scaled indicators, so both parts are kept
    return Model(np.stack([ratio * w, ratio**2]).astype(np.float32), slope, intercept)


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """P(label 1) of each text."""
    out = []
    for at, end, data, offs in text_chunks(column):
        margin = np.zeros(end - at)
        if model.weights.ndim == 2:
            features, cuts = distinct_features(data, offs, BITS)
            full = np.flatnonzero(np.diff(cuts))
            if len(full):
                sums = [np.add.reduceat(w[features].astype(np.float64), cuts[:-1][full]) for w in model.weights]
                margin[full] = sums[0] / np.sqrt(np.maximum(sums[1], 1e-12))
        out.append(1 / (1 + np.exp(-np.clip(model.slope * margin + model.intercept, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = 8000, max_bytes: int = 128 << 20) -> Model:
    """The model for ``labels`` (doc_id, ``label`` 0 or 1) of ``docs`` (doc_id, text).

    It is fitted on the driver to at most ``max_rows`` labelled rows with ``max_bytes`` of text, those with the least hash of doc_id. Their
    ids, so bounded, are broadcast to the documents. Other labels, null ids and ids that ``docs`` lacks don't count.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # max_rows lengths at most, so one window holds them
    upto = F.sum("size").over(W.partitionBy().orderBy(F.xxhash64("doc_id"), "doc_id", "label"))
    within = rows.select("doc_id", "label", F.octet_length("text").alias("size")).withColumn("upto", upto).filter(F.col("upto") <= max_bytes)
    rows = rows.join(F.broadcast(within.select("doc_id", "label")), ["doc_id", "label"]).repartition(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offs in text_chunks(batch.column("text")):
                features, cuts = distinct_features(data, offs, BITS)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(features.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), batch.column("label").slice(at, end - at), lists], names=["doc_id", "label", "features"])

    # of rows that repeat a document the least text counts, so no more than max_rows of them reach the driver
    got = map_batches(rows, run, "doc_id long, label int, features array<int>").toArrow()
    ids, label = got.column("doc_id").to_numpy(), got.column("label").to_numpy()
    parts = [x for c in got.column("features").chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) if len(c)]
    order = np.lexsort((label, ids, ids * np.int64(0x9E3779B1) % 1_000_003))  # any fixed order that mixes the ids
    model = fit([parts[i] for i in order], label[order])
    del got, parts, ids
    release_memory()  # what the fit has taken would stay with the driver else
    return model


def with_score(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with the column ``score``, P(label 1) of each whole text; a null text counts as empty. A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(sent.value, batch.column("text")))], names=[*batch.schema.names, score])

    rows = docs.drop(score)
    return map_batches(rows, run, docs.drop(score).schema.add(score, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, may_learn, label: str = "quality", threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``may_learn`` (a function of the doc_id column) marks the rows whose labels may be used; the others are held out. A score
    depends on the text alone. Null, empty and blank texts get the score of a text without features. Without labels,
    or with one kind alone, every score is the smoothed share of label 1. Very long texts are scored whole, in memory in
    proportion to the longest. Repeated rows score alike; no rows give no rows; other columns are ignored.
    """
    model = train(docs, labels.filter(may_learn(F.col("doc_id"))), label, max_rows)
    rows = with_score(docs.select("doc_id", "text"), model).drop("text")
    return rows.select("doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
