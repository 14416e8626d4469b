"""Embedding whitening from bit-sliced scatter sums.

Every entry becomes a whole number, ``floor(1024 * entry) + 100000``. A task takes its vectors in blocks, shifts each
dimension by its least value in the block and packs every bit plane of every dimension, rows side by side, into 64-bit
words. The sum of the products of two dimensions is then the sum over pairs of planes of 2^(i+j) times the set bits of
their AND, a whole number without rounding. Blocks are moved back to a common origin by whole numbers, Spark sums them,
and the driver gets one number per pair of dimensions, centres them as whole numbers (``n * C - S * S'``) and divides
once before ``eigh``. So the covariance does not depend on the order or the number of tasks.

Two passes read the vectors: the sums, then the projection, which is written with each row's exact deviation. The
covariance of the written values gives the identity error.

Defined cases: vectors that are null or hold null or non-finite entries go; of vectors of several lengths those of the
most frequent one (of equals the longest) remain, empty ones never do; the conversion to a whole number saturates like
a cast to long, at 2^62; components without variance (below 1e-12 of the trace) have null ``whitened``, and
``identity_error`` covers the others, null if there are none; a deviation beyond a long is null in ``deviation`` and
exact in ``deviation_exact`` up to 38 digits; fewer dimensions than components give fewer components; null ids,
repeated rows and further columns stay; columns with the names of the result are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.session import stored

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 62
COMPONENTS = 8
#: rows of a block; its planes are 1/64 of that in words
BLOCK = 1 << 15
#: least share of the trace a component needs to have variance
LEAST_SHARE = 1e-12
MADE = ("component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error")


def usable(vector: Column) -> Column:
    """Whether a vector exists, is not empty and has finite entries only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def whole(entries: np.ndarray) -> np.ndarray:
    """Entries as whole numbers; floats of 2^62 and more saturate."""
    grown = np.floor(entries.astype(np.float64) * SCALE)
    return np.clip(grown, -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (planes x words) of non-negative numbers (rows x dimensions), and each plane's dimension and weight."""
    bits = [int(top).bit_length() for top in shifted.max(0)]
    rows, width = shifted.shape
    words = -(-rows // 64)
    packed = np.zeros((sum(bits), words * 8), np.uint8)
    at = 0
    for d in range(width):
        column = shifted[:, d]
        for b in range(bits[d]):
            line = np.packbits((column >> np.uint64(b)).astype(np.uint8) & 1)
            packed[at, : len(line)] = line
            at += 1
    owner = np.repeat(np.arange(width), bits)
    weight = np.concatenate([np.arange(b) for b in bits]) if at else np.zeros(0, int)
    return packed.view(np.uint64), owner, weight


def scatter(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums per dimension and of products per pair of dimensions (first at most second), exact, for a block of rows."""
    rows, width = x.shape
    low = x.min(0)
    # shifted entries fit 64 bits without a sign, as entries lie within 2^62 of 0
    packed, owner, weight = planes((x - low).astype(np.uint64))
    sums = [0] * width
    for p, (d, b) in enumerate(zip(owner.tolist(), weight.tolist())):
        sums[d] += int(np.bitwise_count(packed[p]).sum()) << b
    # beyond 62 bits a dimension's products are summed as Python numbers
    narrow = 2 * int(weight.max(initial=0)) + 2 + rows.bit_length() < 62
    products = np.zeros((width, width), np.int64 if narrow else object)
    first = np.searchsorted(owner, np.arange(width + 1))
    for p, d in enumerate(owner.tolist()):
        # a plane meets all planes of its own dimension and of later ones
        at = first[d]
        both = np.bitwise_count(packed[p] & packed[at:]).sum(1, dtype=np.int64)
        weighted = both.astype(products.dtype) << (weight[at:] + weight[p]).astype(products.dtype)
        starts = np.flatnonzero(np.diff(owner[at:], prepend=-1))
        products[d, owner[at:][starts]] += np.add.reduceat(weighted, starts)
    base = [int(v) for v in low]
    moved = [s + rows * m for s, m in zip(sums, base)]
    out = []
    for d in range(width):
        for e in range(d, width):
            out.append(int(products[d, e]) + base[e] * sums[d] + base[d] * sums[e] + rows * base[d] * base[e])
    return moved, out


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of an array."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


@dataclass
class Fit:
    n: int
    sums: list[int]
    #: eigenvectors as columns, their eigenvalues and shares of the trace, by falling eigenvalue
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Fit:
    """Components of the vectors ``_v``, all of one length; the driver gets one number per pair of dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, [0] * length, [0] * (length * (length + 1) // 2)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = whole(matrix(batch.column(0).slice(at, BLOCK)))
                s, p = scatter(x)
                n += len(x)
                total = [a + b for a, b in zip(total, s)]
                products = [a + b for a, b in zip(products, p)]
        if n:
            parts = [n, *total, *products]
            # limbs of 60 bits, so that sums of many tasks stay within decimals of 38 digits
            low, middle, high = [v & (1 << 60) - 1 for v in parts], [v >> 60 & (1 << 60) - 1 for v in parts], [v >> 120 for v in parts]
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(parts)), pa.int32()), "a": pa.array(low), "b": pa.array(middle), "c": pa.array(high)})

    parts = rows.select("_v").mapInArrow(sums, "k int, a long, b long, c long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "abc"]
    got = {r["k"]: int(r["a"]) + (int(r["b"]) << 60) + (int(r["c"]) << 120) for r in parts.groupBy("k").agg(*wide).collect()}
    n = got.get(0, 0)
    if not n:
        return Fit(0, [], np.zeros((length, 0)), np.zeros(0), np.zeros(0))
    total = [got[1 + d] for d in range(length)]
    covariance = np.zeros((length, length))
    k = 1 + length
    for d in range(length):
        for e in range(d, length):
            covariance[d, e] = covariance[e, d] = (n * got[k] - total[d] * total[e]) / (n * n)
            k += 1
    values, vectors = np.linalg.eigh(covariance)
    keep = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    shares = np.maximum(values[keep], 0) / trace if trace > 0 else np.zeros(len(keep))
    return Fit(n, total, vectors[:, keep], values[keep], shares)


def projected(fitted: Fit, entries: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Exact deviations and whitened values (NaN without variance) of a block of vectors."""
    x, n = whole(entries), fitted.n
    middle = [s // n for s in fitted.sums]
    rest = [s - n * m for s, m in zip(fitted.sums, middle)]
    spread = [int(a) - m for a, m in zip(x.min(0), middle)] + [int(a) - m for a, m in zip(x.max(0), middle)]
    most, width = max(map(abs, spread)), len(middle)
    fixed = sum(r * r for r in rest)
    if most < 1 << 62:
        y = x - np.array(middle, np.int64)
    else:
        y = x.astype(object) - np.array(middle, object)
    exact = y if most * most * width < 1 << 62 else y.astype(object)
    crossed = y if most * n * width < 1 << 62 else y.astype(object)
    squares = (exact * exact).sum(1).tolist()
    crosses = (crossed * np.array(rest, crossed.dtype)).sum(1).tolist()
    deviations = [str(n * n * int(s) - 2 * n * int(c) + fixed) for s, c in zip(squares, crosses)]
    centred = y.astype(np.float64) - np.array([r / n for r in rest])
    live = fitted.shares > LEAST_SHARE
    white = np.full((len(x), len(live)), np.nan)
    white[:, live] = centred @ fitted.vectors[:, live] / np.sqrt(fitted.values[live])
    return deviations, white


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component; the input's columns but the vector come first."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c.lower() not in {*MADE, vector.lower()}]
    clean = rows.where(usable(F.col(vector))).select(*rest, F.col(vector).cast("array<double>").alias("_v"))
    lengths = clean.groupBy(F.size("_v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    length = lengths[0]["length"] if lengths else 1
    clean = clean.where(F.size("_v") == length)
    fitted = fit(clean, length, components)
    shown = len(fitted.values)
    sent = Fit(fitted.n, fitted.sums, fitted.vectors, fitted.values, fitted.shares)  # dimensions times components

    @F.pandas_udf("deviation string, w array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            deviations, lines = [], []
            for at in range(0, len(batch), BLOCK):
                part, white = projected(sent, np.array(batch.iloc[at : at + BLOCK].tolist(), float).reshape(-1, length))
                deviations += part
                lines += list(white)
            yield pd.DataFrame({"deviation": pd.Series(deviations, dtype=object), "w": pd.Series(lines, dtype=object)})

    row = clean.withColumn("_p", project("_v")).select(*rest, F.col("_p.deviation").alias("_d"), F.col("_p.w").alias("_w"))
    row = stored(row, "whitened")
    error = identity_error(row, fitted)
    shares = F.array(*[F.lit(float(s)) for s in fitted.shares]) if shown else F.array().cast("array<double>")
    table = row.select("*", F.posexplode("_w").alias("_k", "_value"))
    return table.select(
        *rest,
        (F.col("_k") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        F.try_to_number("_d", F.lit("9" * 38)).cast("decimal(38,0)").alias("deviation_exact"),
        F.when(F.isnan("_value"), None).otherwise(F.col("_value")).alias("whitened"),
        F.get(shares, F.col("_k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    ).withColumn("deviation", F.col("deviation_exact").try_cast("long"))


def identity_error(row: DataFrame, fitted: Fit) -> float | None:
    """Largest absolute entry of the covariance of the written values minus the identity, centred before multiplying."""
    live = np.flatnonzero(fitted.shares > LEAST_SHARE).tolist()
    if not live:
        return None
    means = row.agg(*[F.avg(F.col("_w")[k]).alias(f"m{k}") for k in live]).first()
    centred = {k: F.col("_w")[k] - F.lit(means[f"m{k}"]) for k in live}
    pairs = [(a, b) for a in live for b in live if a <= b]
    got = row.agg(*[F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
