"""Embedding whitening by a covariance over distinct vectors, each weighted by how often it occurs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlint_spark.llm.common import cut_lineage, hot_join, map_batches

#: Whole components lie within these bounds; what is beyond is set to the nearer one, so that sums stay exact.
LEAST, MOST = -(1 << 42), 1 << 42
#: Components whose variance is below this share of the largest are none.
RANK_TOLERANCE = 1e-12
_LONG = (1 << 63) - 1


def whole_rows(column: pa.Array, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, x, offsets): ``floor(scale * c) + shift`` of each component of the rows that are whole.

    Rows that are null or empty, or hold null or non-finite components, are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.zeros(len(lengths), bool)
    bad[owner[~np.isfinite(values)]] = True
    rows = np.flatnonzero(~bad & (lengths > 0))
    kept = values[~bad[owner]]
    x = np.clip(np.floor(kept * scale), LEAST, MOST).astype(np.int64) + shift
    return rows, x, np.concatenate([[0], np.cumsum(lengths[rows])])


def keyed(vectors: DataFrame, scale: int, shift: int, with_x: bool) -> DataFrame:
    """(vec_id, dims, key[, x]) of each vector that takes part; ``key`` is a 128-bit digest of x."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows, x, offs = whole_rows(part.column("embedding"), scale, shift)
                data = x.astype("<i8").tobytes()
                keys = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                out = [part.column("vec_id").take(pa.array(rows)), pa.array(np.diff(offs), pa.int32()), pa.array(keys, pa.binary())]
                if with_x:
                    out.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(x)))
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "dims", "key", "x"][: len(out)])

    schema = f"vec_id {id_type}, dims int, key binary" + (", x array<bigint>" if with_x else "")
    return map_batches(vectors.select("vec_id", "embedding"), run, schema)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dims)


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted sums by column, as Python integers."""
    top = max(int(np.abs(x).max(initial=0)), 1)
    if top * int(weight.sum()) < 1 << 62:
        return (weight @ x).tolist()
    return [int(s) for s in weight.astype(object) @ x.astype(object)]


def deviations(parts: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n * part - rest)^2 of each row, exact; None beyond 64 bits. ``n * part - rest`` is n * x - S."""
    top = n * int(np.abs(parts).max(initial=0)) + n
    if top * top * max(parts.shape[1], 1) < 1 << 63:
        d = n * parts - rest
        return (d * d).sum(1).tolist()
    d = n * parts.astype(object) - rest.astype(object)
    return [int(s) if s <= _LONG else None for s in (d * d).sum(1)]


def _summed(partials: DataFrame) -> dict[int, float | int]:
    """The sums of (cell, value) rows by cell: one row for each cell of a matrix or vector, whatever the number of rows."""
    return {r["cell"]: r["value"] for r in partials.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def _products(rows: DataFrame, dims: int, centred, column: str) -> np.ndarray:
    """Weighted products Y'WY, as a full matrix: one block GEMM a batch, one matrix a partition, added up by cell."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((dims, dims)), False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                y, w = centred(_matrix(part.column(column), dims)), part.column("weight").to_numpy().astype(np.float64)
                total += (y * w[:, None]).T @ y
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["cell", "value"])

    cells = _summed(map_batches(rows.select(column, "weight"), run, "cell long, value double"))
    out = np.zeros((dims, dims))
    out[upper] = [cells[k] for k in range(len(upper[0]))]
    return out + np.triu(out, 1).T


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, shift: int = 1_000_000, weights: str = "counts") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error): a row for each row of ``vectors`` (vec_id, embedding) that takes part.

    Components become whole numbers, x = floor(scale * c) + shift. Equal x vectors are grouped by a 128-bit digest; each distinct
    vector counts ``weights`` times in the fit: ``counts``, as often as it occurs, or ``one``, once. ``n`` is the sum of the
    weights, S that of the x vectors, and the covariance (divisor n) adds up products of centred vectors, one matrix for each
    partition, whose cells are added by Spark; the driver sees dims^2 numbers. ``whitened`` has the projections of x - S/n on the
    unit eigenvectors of the ``most`` largest eigenvalues, each over the eigenvalue's root; ``explained`` the eigenvalues' shares of the
    trace. Each distinct vector is whitened once and joined back to its rows; keys with more than their share of rows are broadcast.
    ``deviation`` is the exact sum over dimensions of (n * x - S)^2, null beyond 64 bits; ``identity_error`` the largest entry of
    the whitened vectors' covariance minus the identity.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do those of another length than the most
    frequent (of several the longest). Scaled components beyond 2^42 count as 2^42. Components without variance (below 1e-12 of the largest
    eigenvalue) are left out; if all vectors are equal there are none, and the lists are empty. Null and repeated vec_ids are rows like
    others. No rows give no rows; further columns are ignored. A task holds a few thousand vectors at a time.
    """
    spark = vectors.sparkSession
    found = keyed(vectors, scale, shift, True)
    groups = cut_lineage(found.groupBy("dims", "key").agg(F.count("*").alias("rows"), F.first("x").alias("x")))
    lengths = groups.groupBy("dims").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    empty = "array<double>"
    columns = ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    if lengths is None:
        none = vectors.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.lit(None).cast(empty).alias("whitened"), F.lit(None).cast(empty).alias("explained"), F.lit(None).cast("double").alias("identity_error"))
        return none.filter(F.lit(False))
    dims = lengths["dims"]
    weight = F.col("rows") if weights == "counts" else F.lit(1).cast("long")
    groups = groups.filter(F.col("dims") == dims).withColumn("weight", weight)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for batch in batches:
            x, w = _matrix(batch.column("x"), dims), batch.column("weight").to_numpy()
            total = [a + b for a, b in zip(total, [*exact_sums(x, w), int(w.sum())], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array([str(v) for v in total])], names=["cell", "value"])

    partials = map_batches(groups.select("x", "weight"), sums, "cell long, value string")
    exact = _summed(partials.withColumn("value", F.col("value").cast("decimal(28,0)")))
    n = int(exact[dims])
    mean = [divmod(int(exact[k]), n) for k in range(dims)]  # S = n * whole + rest
    whole, rest = np.array([q for q, _ in mean], np.int64), np.array([r for _, r in mean], np.int64)
    share = rest.astype(np.float64) / n

    covariance = _products(groups, dims, lambda x: (x - whole).astype(np.float64) - share, "x") / n
    values, unit = np.linalg.eigh(covariance)
    values, unit = values[::-1], unit[:, ::-1]
    kept = min(most, int((values > max(values[0], 0) * RANK_TOLERANCE).sum()))
    trace = float(np.trace(covariance))
    axes = unit[:, :kept] / np.sqrt(values[:kept])
    sent = spark.sparkContext.broadcast((whole, rest, share, axes))  # dims * most numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest, share, axes = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                moved = _matrix(part.column("x"), dims) - whole
                z = (moved.astype(np.float64) - share) @ axes
                cuts = pa.array(np.arange(len(moved) + 1) * kept, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("rows"), part.column("weight"), pa.array(deviations(moved, rest, n), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(z.ravel()))],
                    names=["key", "rows", "weight", "deviation", "whitened"],
                )

    white = cut_lineage(map_batches(groups.select("key", "rows", "weight", "x"), project, "key binary, rows long, weight long, deviation long, whitened array<double>"))
    # the whitened vectors' mean is zero but for rounding, as they are made of centred ones; it is taken off all the same
    error = None
    if kept:
        joined = white.select(F.concat("whitened", F.array(F.lit(1.0))).alias("z"), "weight")
        moments = _products(joined, kept + 1, lambda z: z, "z") / n
        found_covariance = moments[:kept, :kept] - np.outer(moments[:kept, kept], moments[:kept, kept])
        error = float(np.abs(found_covariance - np.eye(kept)).max())
    rows = keyed(vectors, scale, shift, False).filter(F.col("dims") == dims).select("vec_id", "key")
    rows = hot_join(rows, white.select("key", "rows", "deviation", "whitened"), ["key"], "rows")
    told = F.array(*(F.lit(float(v / trace)) for v in values[:kept])).cast(empty)
    return rows.withColumns({"n": F.lit(n).cast("long"), "explained": told, "identity_error": F.lit(error).cast("double")}).select(columns)


def whitened_components(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): the lists of ``whiten``, a row for each component from 1."""
    rows = whiten(vectors, most)
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
