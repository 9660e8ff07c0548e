"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.llm.common import map_batches

_BLOCK = "n long, dim long, ids binary, low binary, step binary, cells binary, vectors binary"
_QUERY = "n long, dim long, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of each component, for vectors without null and non-finite components."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of runs of at most ``most`` rows of a partition; shorter vectors are filled up with zeros."""
    ids, parts, held = [], [], 0
    for batch in batches:
        v, lengths = batch.column("v"), batch.column("v").value_lengths().to_numpy()
        dim = int(lengths.max()) if len(lengths) else 0
        rows = np.zeros((len(lengths), dim), np.int64)
        rows[np.arange(dim) < lengths[:, None]] = v.flatten().to_numpy()
        own = batch.column("vec_id").to_numpy()
        for a in range(0, len(own), most):
            x = own[a : a + most]
            if held + len(x) > most:
                yield _stacked(ids, parts)
                ids, parts, held = [], [], 0
            ids.append(x)
            parts.append(rows[a : a + most])
            held += len(x)
    if held:
        yield _stacked(ids, parts)


def _stacked(ids: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    dim = max(p.shape[1] for p in parts)
    return np.concatenate(ids), np.concatenate([np.pad(p, ((0, 0), (0, dim - p.shape[1]))) for p in parts])


def va_file(vectors: DataFrame, bits: int = 6, block_rows: int = 4096) -> DataFrame:
    """The vector-approximation file of (vec_id, v): blocks of ids, exact vectors and, beside them, quantised cells.

    Each component is cut into ``2 ** bits`` cells (8 bits at most) of one width between its least and largest value in
    the block. A block has at most ``block_rows`` vectors, all from one input partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _matrices(batches, block_rows):
            low = v.min(axis=0).astype(np.float64) if v.size else np.zeros(v.shape[1])
            step = np.maximum((v.max(axis=0) - low) / 2**bits, 1e-9) if v.size else np.ones(v.shape[1])
            cells = np.minimum((v - low) / step, 2**bits - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(ids), v.shape[1], ids.tobytes(), low.tobytes(), step.tobytes(), cells.tobytes(), v.tobytes())], schema=pa.schema([("n", pa.int64()), ("dim", pa.int64()), *((c, pa.binary()) for c in ("ids", "low", "step", "cells", "vectors"))]))

    return map_batches(vectors, run, _BLOCK)


def query_blocks(queries: DataFrame, block_rows: int = 512) -> DataFrame:
    """(n, dim, ids, vectors): the queries (vec_id, v) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _matrices(batches, block_rows):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(ids), v.shape[1], ids.tobytes(), v.tobytes())], schema=pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return map_batches(queries, run, _QUERY)


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k best in one block.

    The cells give every vector a lower and an upper bound of its score. Vectors whose upper bound is under the
    kth highest lower bound are out; the rest are read in the order of their upper bounds, until the next bound can't
    reach the kth score found.
    """
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
    fill = dim - len(low)
    middle = np.pad(low + (cells + 0.5) * step, ((0, 0), (0, fill)))
    half = np.pad(0.5 * step, (0, fill))
    qf = q.astype(np.float64)
    centre, spread = qf @ middle.T, np.abs(qf) @ half
    # rounding of the sums is far below this
    slack = 1 + 1e-9 * (np.abs(qf) @ np.abs(middle).max(axis=0))
    spread = (spread + slack)[:, None]
    exact = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * dim < 1 << 53
    vf = v.astype(np.float64) if exact else v
    first = np.unique(ids, return_index=True)[1]
    repeated = len(first) < len(ids)
    for i, own in enumerate(q_ids):
        other = np.flatnonzero(ids != own)
        upper, lower = centre[i, other] + spread[i], centre[i, other] - spread[i]
        if repeated:  # the bound of an id is that of its best row
            group = np.unique(ids[other], return_inverse=True)[1]
            lower_by_id = np.full(group.max(initial=-1) + 1, -np.inf)
            np.maximum.at(lower_by_id, group, lower)
            lower = lower_by_id
        if len(lower) > k:
            keep = upper >= np.partition(lower, -k)[-k]
            other, upper = other[keep], upper[keep]
        turn = np.lexsort((ids[other], -upper))
        other, upper = other[turn], upper[turn]
        best: dict[int, int] = {}
        at, size = 0, 4 * k
        while at < len(other):
            if len(best) >= k and upper[at] < sorted(best.values())[-k]:
                break
            part = other[at : at + size]
            scores = (vf[part] @ qf[i]).astype(np.int64) if exact else v[part] @ q[i]
            for c, s in zip(ids[part].tolist(), scores.tolist(), strict=True):
                if s > best.get(c, s - 1):
                    best[c] = s
            if len(best) > 4 * k:
                best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
            at, size = at + size, 2 * size
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        if top:
            yield int(own), np.array([c for c, _ in top], np.int64), np.array([s for _, s in top], np.int64)


def search(index: DataFrame, queries: DataFrame, k: int, lanes: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest scores in ``index``, ties to the smaller id.

    Blocks of the index are dealt to ``lanes`` (the session's shuffle partitions unless given); each block of queries
    goes to every lane once, so it meets every block of the index once, as one row with it.
    """
    spark = index.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of its partition
    left = index.withColumn("lane", F.pmod(F.spark_partition_id() + nth * 7919, F.lit(lanes)).cast("int"))
    right = queries.withColumnsRenamed({"n": "q_n", "dim": "q_dim", "ids": "q_ids", "vectors": "q_vectors"}).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                dim = b["dim"]
                found = scan(
                    np.frombuffer(b["q_ids"], np.int64),
                    np.frombuffer(b["q_vectors"], np.int64).reshape(b["q_n"], b["q_dim"]),
                    np.frombuffer(b["ids"], np.int64),
                    np.frombuffer(b["low"]),
                    np.frombuffer(b["step"]),
                    np.frombuffer(b["cells"], np.uint8).reshape(b["n"], dim),
                    np.frombuffer(b["vectors"], np.int64).reshape(b["n"], dim),
                    k,
                )
                for own, ids, scores in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), own)), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    met = map_batches(left.join(right, "lane").drop("lane"), run, _FOUND)
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank: Column = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose vec_id is divisible by ``every``.

    A component counts as ``floor(scale * x)``, the score is the inner product. Vectors that are null, or hold null or
    non-finite components, and rows without vec_id take no part. Shorter vectors are filled up with zeros. Rows that
    repeat a vec_id are one item with the best score of its rows, and never their own partners. Scores must fit 64 bits;
    sums that may pass 2 ** 53 are made in whole numbers. Fewer than k partners give fewer rows, no rows none.
    """
    rows = whole_vectors(vectors, scale)
    return search(va_file(rows), query_blocks(rows.filter(F.col("vec_id") % every == 0)), k)
