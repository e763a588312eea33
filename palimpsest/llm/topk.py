"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Bytes of one block of queries, which is what a broadcast holds; vectors of a candidate block; dimensions of a step.
QUERY_BYTES, CANDIDATES, DIMENSIONS = 16 << 20, 8192, 16
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x as double. Rows with a null or non-finite part are left out."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    small = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-9.0e18), F.least(F.lit(9.0e18), c * scale))).cast("long"))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), small.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of different lengths, padded with zeros: missing components add nothing to an inner product."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    width = max(width, int(n.max(initial=0)))
    if len(n) and (n == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    for i, (a, k) in enumerate(zip(offsets[:-1], n, strict=True)):
        out[i, :k] = flat[a : a + k]
    return out


class _Block:
    """Candidates in vertical layout: one contiguous row per dimension, and the length of what is left after each step."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(rows.T.astype(np.float64))
        self.left = _tails(self.columns)


def _tails(columns: np.ndarray) -> np.ndarray:
    """Euclidean norm of the dimensions from each step on, slightly enlarged against rounding; the last is 0."""
    steps = range(0, columns.shape[0], DIMENSIONS)
    parts = [np.einsum("ij,ij->j", columns[s : s + DIMENSIONS], columns[s : s + DIMENSIONS]) for s in steps]
    tails = np.zeros((len(parts) + 1, columns.shape[1]))
    for i in range(len(parts) - 1, -1, -1):
        tails[i] = tails[i + 1] + parts[i]
    return np.sqrt(tails) * (1 + 1e-9)


def _search(block: _Block, query: np.ndarray, tails: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``block`` that can be among the ``k`` best at or above ``floor``, and their scores.

    Scores grow step by step; after each, what a candidate can still gain or
    lose is at most the product of both remaining norms. Candidates whose
    upper bound is below the k-th best lower bound go, and the survivors'
    columns are gathered closely again once half are gone.
    """
    columns, left, place = block.columns, block.left, np.arange(len(block.ids))
    score = np.zeros(len(place))
    last = len(tails) - 1
    for s in range(last):
        span = slice(s * DIMENSIONS, (s + 1) * DIMENSIONS)
        score += query[span] @ columns[span]
        rest = tails[s + 1] * left[s + 1] + 1e-6 * (s + 1 < last)
        if len(score) > k:
            floor = max(floor, float(np.partition(score - rest, len(score) - k)[len(score) - k]))
        alive = score + rest >= floor
        if s + 1 == last or alive.mean() < 0.5:
            keep = np.flatnonzero(alive)
            score, place = score[keep], place[keep]
            if s + 1 < last:
                columns, left = columns[:, keep], left[:, keep]
    return place, score


def _local(number: np.ndarray, q: np.ndarray, k: int):
    """The k best of each task's candidates for each query; a query's own row, known by its number, is none."""

    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(number)
        place_of = {int(x): i for i, x in enumerate(number)}
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                rows = _matrix(part.column("v"), q.shape[1])
                wide = np.pad(q, ((0, 0), (0, rows.shape[1] - q.shape[1])))
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                numbers = part.column("number").to_numpy(zero_copy_only=False)
                own = {place_of[int(x)]: i for i, x in enumerate(numbers) if int(x) in place_of}
                most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(wide.astype(np.float64)).max(initial=0)) * max(1, rows.shape[1])
                exact = most < _EXACT
                block = _Block(ids, rows) if exact else None
                tails = _tails(np.ascontiguousarray(wide.T.astype(np.float64))) if exact else None
                for i, one in enumerate(wide):
                    have_ids, have = best[i]
                    if exact and rows.shape[1]:
                        floor = float(have.min()) if len(have) >= k else -np.inf
                        # one more than wanted where the query's own row is among them
                        place, score = _search(block, one.astype(np.float64), tails[:, i : i + 1].ravel(), floor, k + (i in own))
                        score = score.astype(np.int64)
                    else:  # numbers too large for exact floats: whole numbers of any size, held to 64 bits at the end
                        place = np.arange(len(ids))
                        score = np.array([min(_MOST, max(_LEAST, sum(int(a) * int(b) for a, b in zip(r, one, strict=True)))) for r in rows], np.int64)
                    if i in own:
                        other = place != own[i]
                        place, score = place[other], score[other]
                    all_ids, all_scores = np.concatenate([have_ids, ids[place]]), np.concatenate([have, score])
                    top = np.lexsort((all_ids, -all_scores))[:k]
                    best[i] = all_ids[top], all_scores[top]
        for i in range(0, len(number), 1024):
            some = best[i : i + 1024]
            n = [len(x[0]) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number[i : i + 1024], n), pa.int64()), *(pa.array(np.concatenate([x[c] for x in some])) for c in range(2))], ["number", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row whose vec_id is divisible by ``every``.

    Queries go in blocks of at most QUERY_BYTES, one after the other: a block
    is sent to all tasks, each searches its candidates and keeps k per query,
    a ranking with a limit merges the tasks, and the block's result is
    written before the next is read, so that the driver holds one block. All
    candidates are compared; what the bounds leave out can't be in the result.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. A query's own row is no candidate; a repeated row is. Vectors that
    are null or hold null or non-finite parts take no part; of different
    lengths, the shorter counts as ending in zeros; empty ones score 0. Null
    vec_id: no query, a candidate ranked after its ties. Scores beyond 64
    bits are held there. Empty table: empty. Other columns are ignored.
    """
    ready = stash(quantised(vectors, scale).withColumn("number", F.monotonically_increasing_id()), "topk-vectors")
    queries = ready.where(F.pmod("vec_id", F.lit(every)) == 0)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    candidates = ready.select(F.coalesce("vec_id", F.lit(_MOST)).alias("vec_id"), "number", "v")
    schema = "number long, vec_id long, score long"
    found = [ready.sparkSession.createDataFrame([], schema + ", rank int")]
    rows = max(1, QUERY_BYTES // (8 * max(1, size["d"] or 0)))
    blocks = -(-size["n"] // rows)
    dealt = queries.select("number", "v", F.pmod(F.xxhash64("number"), F.lit(max(1, blocks * 2 if blocks > 1 else 1))).alias("block"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc("vec_id"))
    for b in range(blocks * 2 if blocks > 1 else blocks):  # twice as many as needed: one rarely holds more than fits
        got = dealt.where(F.col("block") == b).toArrow().combine_chunks()
        for at in range(0, got.num_rows, rows):
            part = got.slice(at, rows).combine_chunks()
            vs = part.column("v").combine_chunks()
            best = candidates.mapInArrow(_local(part.column("number").to_numpy(), _matrix(vs, 0), k), schema)
            best = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            found.append(stash(best, "topk-block"))
    few = reduce(DataFrame.unionByName, found)
    ids = queries.select("number", F.col("vec_id").alias("query_id"))
    return few.join(ids, "number").select("query_id", "rank", F.when(F.col("vec_id") != _MOST, F.col("vec_id")).alias("vec_id"), "score")
