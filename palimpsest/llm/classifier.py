"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import text_stats
from .words import Words, mix64, slices

#: Rows the model is fitted on, at most: trusted positives, unlabelled texts, labelled rows for the class prior.
POSITIVES, UNLABELLED, PRIOR_ROWS = 6_000, 12_000, 100_000
#: Places for hashed words, and for a word's last byte and length; steps over the sample; step size; weight decay,
#: chosen by held-back folds among the training rows.
HASHED, SHAPES, STEPS, STEP, DECAY = 512, 128, 300, 0.02, 1e-2
SEED = 7
FOLDS, HELD_OUT = 4, 2


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares and lengths of what the text is made of; its words hashed to HASHED places; their last
    bytes and lengths hashed to SHAPES places."""
    w = Words(texts)
    stats = text_stats(w, texts)
    n = np.maximum(1, stats["n_words"]).astype(np.float64)
    chars = np.maximum(1, stats["word_chars"]).astype(np.float64)
    data = w.data
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offsets])
    kind = lambda lo, hi: per_row((data >= lo) & (data <= hi))
    punct = np.isin(data, np.frombuffer(b"!?\"'()[]{}=+_@/\\^~`;:-", np.uint8))
    alone = np.zeros(w.rows)
    once = w.hash ^ (w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if len(once):
        _, at = np.unique(once, return_index=True)
        alone = np.bincount(w.row[at], minlength=w.rows)
    lines = per_row(data == 10) + 1
    dense = np.stack(
        [
            np.log1p(stats["n_words"]) / 8,
            chars / n / 8,
            stats["n_symbols"] / n,
            stats["n_symbols"] / chars * 4,
            stats["n_dup_lines"] / lines,
            stats["n_repeat_words"] / n,
            alone / n,
            kind(65, 90) / chars * 2,
            kind(48, 57) / chars * 4,
            per_row(punct) / chars * 4,
            per_row(data == 46) / n * 2,
            per_row(data == 124) / n * 2,
            (stats["n_words"] < 10).astype(float),
            lines / n * 4,
        ],
        axis=1,
    )
    tail = w.data[np.maximum(w.end - 1, 0)].astype(np.uint64)
    shape = mix64(tail * np.uint64(16) + np.minimum(w.end - w.start, 15).astype(np.uint64)) % np.uint64(SHAPES)
    word = w.hash % np.uint64(HASHED)
    parts = [dense]
    for at, size in ((word, HASHED), (shape, SHAPES)):
        counts = np.bincount(w.row * size + at.astype(np.int64), minlength=w.rows * size).reshape(w.rows, size)
        parts.append(np.sqrt(counts / n[:, None]))
    return np.concatenate(parts, axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss, and the direction to leave.

    ``weights`` ends with the bias. The direction is the gradient; where the
    second part is below zero, it is that part's negative gradient instead,
    so a flexible model can't gain by calling the positives in the unlabelled
    sample negative.
    """
    zp, zu = (x @ weights[:-1] + weights[-1] for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    negative = loss(-zu).mean() - prior * loss(-zp).mean()
    # derivatives by z: of loss(z) it is sigmoid(z) - 1, of loss(-z) sigmoid(z)
    gu, gp_minus, gp_plus = sigmoid(zu) / len(zu), prior * sigmoid(zp) / len(zp), prior * (sigmoid(zp) - 1) / len(zp)
    on_p, on_u = (gp_plus - gp_minus, gu) if negative >= 0 else (gp_minus, -gu)
    grad = np.append(positive.T @ on_p + unlabelled.T @ on_u, on_p.sum() + on_u.sum())
    return float(prior * loss(zp).mean() + max(0.0, negative)), grad


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = DECAY) -> Model:
    """Minimise the non-negative risk with a weight decay. Full batches and fixed order: reruns agree."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    spread = np.sqrt(sum(((x - mean) ** 2).sum(0) for x in (positive, unlabelled)) / n) + 1e-3
    p, u = (np.clip((x - mean) / spread, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        grad = risk(w.astype(np.float32), p, u, prior)[1] + np.append(decay * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, w[:-1], float(w[-1]))


def in_training(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT


def _features_of(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(part.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), flat], ["doc_id", "positive", "x"])


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on bounded samples: rows with the smallest hash of doc_id, so the choice depends on neither order nor partitioning.

    Positives are training rows of ``labels`` with quality 1; the unlabelled
    sample comes from all training documents; the class prior is the share
    of quality 1 among at most PRIOR_ROWS training labels, held between 0.05
    and 0.95. Without positives there is no model.
    """
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))
    usable = labels.where("doc_id is not null and quality is not null").where(in_training(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = usable.where("quality = 1").orderBy(order, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    some = documents.where("doc_id is not null").where(in_training(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"))
    free = some.orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(UNLABELLED).distinct().select("doc_id", F.lit(False).alias("positive"))
    chosen = good.unionByName(free)  # bounded by the two limits
    # of rows that share an id, the smallest text: no more rows than ids
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    x = texts.mapInArrow(_features_of, "doc_id long, positive boolean, x array<float>")
    share = usable.orderBy(order, "doc_id").limit(PRIOR_ROWS).agg(F.avg((F.col("quality") == 1).cast("double")).alias("p")).first()["p"]
    got = x.toArrow()
    if not share or got.num_rows == 0:
        return None
    matrix = np.concatenate([np.asarray(c.flatten()) for c in got.column("x").chunks if len(c)]).reshape(got.num_rows, -1)
    positive, ids = np.asarray(got.column("positive")).astype(bool), np.asarray(got.column("doc_id"))
    rank = np.lexsort((positive, ids))
    matrix, positive = matrix[rank], positive[rank]
    if not positive.any() or positive.all():
        return None
    return fit(matrix[positive], matrix[~positive], float(np.clip(share, 0.05, 0.95)))


def _scores(model: Model | None, threshold: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                score = np.round(model.score(features(part.column("text"))), 9) if model else np.full(part.num_rows, 0.5)
                held = [i is not None and crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return run


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Score every row (doc_id, text) for quality as ``labels`` (doc_id, quality) marks it.

    Labels are learnt from rows with crc32(doc_id as text) mod 4 other than
    2 only. A score depends on the text alone.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >=
    ``threshold``). Null text scores as the empty text; null doc_id: not held
    out. Repeated rows: each scored. Empty table: empty; no usable labels:
    0.5 for all. Other columns are ignored.
    """
    model = train(documents, labels)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
