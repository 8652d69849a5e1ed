"""Whitening of embeddings with exact statistics.

Entries c become integers x = floor(1024 c) + 100000, so the matrix A = n sum(x x') - S S' (n squared times
the covariance) is one of exact integers: tasks add up products of their rows, in doubles or longs while these
hold them exactly, else in Python integers, and the sums are added in a second stage. Its characteristic
polynomial, roots and null vectors are exact or of many digits (see ``charpoly``):

1. the polynomial modulo some hundred primes, a task each few primes, put together by Chinese remainders;
2. a task per component isolates its root by exact counts and refines it to 50 digits;
3. the same task finds the unit vector of the null space by inverse iteration.

So eigenvalues that nearly agree, or agree, are told apart or known to be equal, and the rank is known
exactly: it is the degree less the power of x that divides the polynomial. The driver sees sums and residues,
whose number depends on the dimension alone.

A row's whitened value is its exact deviation from the mean, as a double, projected on the unit vector and
divided by the root of the eigenvalue. ``identity_error`` is measured on the whitened rows: their means and
centred products are merged pairwise, so they are centred before they are multiplied.

Edge cases: a null vector, one with a null or non-finite entry, or one with an entry whose 1024-fold does not
fit 62 bits takes no part. All vectors have the commonest length of the rest (of equally common ones the
largest); others, and empty ones, take no part either. Null ids are ids like others; repeated rows count
each. Components with eigenvalue zero cannot be whitened and are left out; so one vector, equal vectors, or
an empty table give no rows. Components of equal eigenvalues are a fixed basis of their space. A deviation that
does not fit 38 digits is null. Further columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm import charpoly
from ticklake.session import cut

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Tasks that add up the sums of all others.
ADDERS = 8
_EXACT, _LONG = 1 << 53, 1 << 62


@dataclass(frozen=True)
class Model:
    """Exact sums, and unit vectors (a row each) with their eigenvalues of n^2 V as low / 2^bits."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    deviations: list[float]
    explained: list[float]


def valid(vector: Column) -> Column:
    """Vectors that can take part: every entry there, finite, and not too large for an exact long."""
    limit = F.lit(float(_LONG // SCALE))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False))), F.lit(False))


def _entries(column: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 c) of each entry, as doubles (they hold it exactly)."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).reshape(len(column), dim)


def _products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the rows and of their products."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < _EXACT:
        one, two = y.sum(axis=0).astype(np.int64), (y.T @ y).astype(np.int64)
    elif most * most * len(y) < _LONG:
        z = y.astype(np.int64)
        one, two = z.sum(axis=0), z.T @ z
    else:
        z = np.array([[int(v) for v in row] for row in y], dtype=object)
        one, two = z.sum(axis=0), z.T @ z
    return one.astype(object), two.astype(object)


def _written(n: int, numbers: np.ndarray) -> pa.RecordBatch:
    text = ",".join(map(str, numbers.ravel().tolist()))
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([text.encode()], pa.binary())], ["n", "sums"])


_SUMS = "n long, sums binary"


def _scatter(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((dim + 1, dim), dtype=object)
        for batch in batches:
            if batch.num_rows:
                one, two = _products(_entries(batch.column(0), dim))
                total[0] += one
                total[1:] += two
                n += batch.num_rows
        if n:
            yield _written(n, total)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            here = np.array([int(x) for x in batch.column(1)[i].as_py().split(b",")], dtype=object)
            total = here if total is None else total + here
            n += batch.column(0)[i].as_py()
    if total is not None:
        yield _written(n, total)


def scatter(vectors: DataFrame, column: str, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, A) of vectors of this length: exact sums of x, and n sum(x x') - S S'."""
    parts = vectors.select(column).mapInArrow(_scatter(dim), _SUMS)
    rows = parts.repartition(ADDERS).mapInArrow(_add, _SUMS).collect()  # at most ADDERS rows
    n = sum(r["n"] for r in rows)
    total = np.zeros((dim + 1) * dim, dtype=object)
    for r in rows:
        total = total + np.array([int(x) for x in r["sums"].split(b",")], dtype=object)
    total = total.reshape(dim + 1, dim)
    one, two = total[0], total[1:]
    matrix = [[n * int(two[i, j]) - int(one[i]) * int(one[j]) for j in range(dim)] for i in range(dim)]
    return n, [int(t) + OFFSET * n for t in one], matrix


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial, constant first; its residues are computed by tasks."""
    primes = charpoly.primes_for(charpoly.coefficient_bound(matrix))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                reduced = np.array([[v % primes[i] for v in row] for row in matrix], dtype=np.int64)
                found = charpoly.polynomial_mod(reduced, primes[i]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["i", "c"])

    tasks = spark.range(0, len(primes), 1, -(-len(primes) // 4))
    rows = sorted(tasks.mapInArrow(residues, "i long, c array<long>").collect())  # primes times dimension
    return charpoly.remaindered([r["c"] for r in rows], primes)


def _components(spark: SparkSession, matrix: list[list[int]], poly: list[int], k: int) -> list[tuple[int, int, list[float]]]:
    """(low, bits, unit vector) of the k largest roots, a task each."""
    top = sum(matrix[i][i] for i in range(len(matrix)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, bits, first, count = charpoly.root(poly, i, top)
                vector = charpoly.null_vector(matrix, low, bits, nth=i - first, count=count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([str(low)]), pa.array([bits]), pa.array([[float(v) for v in vector]])],
                    ["i", "low", "bits", "vector"],
                )

    tasks = spark.range(1, k + 1, 1, k)
    rows = tasks.mapInArrow(find, "i long, low string, bits long, vector array<double>").collect()  # k rows
    return [(int(r["low"]), r["bits"], r["vector"]) for r in sorted(rows)]


def dimension(vectors: DataFrame, column: str) -> int | None:
    """The commonest length of the valid vectors."""
    sizes = vectors.where(valid(F.col(column))).groupBy(F.size(column).alias("dim")).count().where("dim > 0")
    found = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return None if found is None else found["dim"]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all valid vectors; None where there are none."""
    dim = dimension(vectors, column)
    if dim is None:
        return None
    n, sums, matrix = scatter(taking_part(vectors, column, dim), column, dim)
    spark = vectors.sparkSession
    poly = polynomial(spark, matrix)
    k = min(components, dim - charpoly.zero_roots(poly))
    found = _components(spark, matrix, poly, k) if k else []
    trace = sum(matrix[i][i] for i in range(dim))
    with decimal.localcontext() as context:
        context.prec, context.Emax, context.Emin = 60, decimal.MAX_EMAX, decimal.MIN_EMIN
        eigen = [Decimal(2 * low + 1) / 2 / Decimal(2) ** bits for low, bits, _ in found]
        return Model(
            n,
            sums,
            np.array([v for _, _, v in found]).reshape(k, dim),
            [float(e.sqrt() / n) for e in eigen],
            [float(e / trace) for e in eigen],
        )


def taking_part(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    return vectors.where(valid(F.col(column)) & (F.size(column) == dim))


def _whitened(model: Model):
    n, dim = model.n, len(model.sums)
    n_offset = [n * OFFSET - s for s in model.sums]  # n x - S = n floor(1024 c) + n OFFSET - S
    turn = (model.vectors / np.array(model.deviations)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _entries(batch.column(1), dim)
            most = int(np.abs(y).max(initial=0)) * n + max(map(abs, n_offset))
            if most < _LONG:
                away = y.astype(np.int64) * n + np.array(n_offset, dtype=np.int64)
            else:
                away = np.array([[int(v) * n + o for v, o in zip(row, n_offset)] for row in y], dtype=object)
            if most * most * dim < _LONG:
                far = pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                far = [sum(int(v) ** 2 for v in row) for row in away]
                far = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            w = (away.astype(np.float64) / n) @ turn
            k = w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], ["vec_id", "deviation", "w"])

    return run


def _merged(a: tuple, b: tuple) -> tuple:
    """Number, means and centred products of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    away = b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


_MOMENTS = "n long, mean binary, products binary"


def _moment_row(held: tuple) -> pa.RecordBatch:
    n, mean, products = held
    return pa.RecordBatch.from_arrays(
        [pa.array([n]), pa.array([mean.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], ["n", "mean", "products"]
    )


def _moment(n: int, mean: bytes, products: bytes) -> tuple:
    one = np.frombuffer(mean, "<f8")
    return n, one, np.frombuffer(products, "<f8").reshape(len(one), len(one))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if batch.num_rows:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            mean = w.mean(axis=0)
            held = _merged(held, (len(w), mean, (w - mean).T @ (w - mean)))
    if held is not None:
        yield _moment_row(held)


def _add_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for n, mean, products in zip(*[c.to_pylist() for c in batch.columns]):
            held = _merged(held, _moment(n, mean, products))
    if held is not None:
        yield _moment_row(held)


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity."""
    parts = whitened.select("w").mapInArrow(_moments, _MOMENTS)
    held = None
    for r in parts.repartition(ADDERS).mapInArrow(_add_moments, _MOMENTS).collect():  # at most ADDERS rows
        held = _merged(held, _moment(r["n"], r["mean"], r["products"]))
    return float(np.abs(held[2] / held[0] - np.eye(len(held[1]))).max())


def transform(vectors: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """vec_id, deviation decimal, w array<double> of every vector that takes part."""
    held = taking_part(vectors, column, len(model.sums)).select("vec_id", column)
    return held.mapInArrow(_whitened(model), "vec_id long, deviation decimal(38,0), w array<double>")


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, vector) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    model = fit(vectors, column, components)
    if model is None or not len(model.vectors):
        schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    rows = cut(transform(vectors, model, column), "whitened")
    error = identity_error(rows)
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    explained = F.element_at(F.array(*[F.lit(e) for e in model.explained]), F.col("place") + 1)
    return each.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
