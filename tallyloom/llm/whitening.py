"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Entries become whole numbers, so sums and deviations are exact. The distinct vectors are centred
and reduced by QR, block by block inside a task and task by task in rounds, to one triangle of
dimension x dimension. The driver takes that triangle to bidiagonal form, finds its singular values
by dqds and the directions by twisted factorisations (`bidiagonal.leading`). Every row is then
projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from tallyloom.llm import bidiagonal
from tallyloom.llm.common import Scratch, free_name

# Triangles that one task joins; numbers held at once by a block of rows.
FAN_IN = 16
BLOCK_NUMBERS = 2_000_000
LONG_MOST = 2**63 - 1

PROJECTED = StructType().add("deviation", LongType()).add("whitened", ArrayType(DoubleType()))


@dataclass(frozen=True)
class Whitening:
    """Fitted on `n` distinct vectors with sums `sums`; directions are columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    total: float

    @property
    def components(self) -> int:
        return len(self.values)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of every entry; NULL for a vector that is null or holds an entry that
    is null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    # an entry minus itself is 0 for finite entries only
    usable = F.forall(entries, lambda c: F.coalesce((c - c) == 0, F.lit(False)))
    return F.when(
        vector.isNotNull() & usable, F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))))
    )


def _blocks(column: pa.ListArray, dims: int) -> Iterator[np.ndarray]:
    """Rows of whole numbers, shorter ones with zeros behind them, in blocks of bounded size."""
    step = max(1, BLOCK_NUMBERS // max(dims, 1))
    for start in range(0, len(column), step):
        part = column.slice(start, step)
        lengths = part.value_lengths().to_numpy(zero_copy_only=False)
        numbers = part.flatten().to_numpy(zero_copy_only=False)
        if (lengths == dims).all():
            yield numbers.reshape(len(part), dims)
        else:
            block = np.zeros((len(part), dims), dtype=np.int64)
            block[np.arange(dims) < lengths[:, None]] = numbers
            yield block


def _safe(block: np.ndarray, factor: int) -> bool:
    """Whether `factor` times any entry stays far inside a long."""
    largest = max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0))))
    return largest * factor < 2**62


def _sums(dims: int):
    def of(batches):
        n, sums = 0, [0] * dims
        for batch in batches:
            for block in _blocks(batch.column(0), dims):
                exact = block if _safe(block, len(block)) else block.astype(object)
                sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0), strict=True)]
                n += len(block)
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]})

    return of


def _triangle_rows(triangle: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"triangle": pa.array([triangle.ravel().tolist()], pa.list_(pa.float64()))})


def _centred(block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return block.astype(float) - mean


def _reduce(dims: int, mean: np.ndarray):
    """Vectors of a task to one triangle."""

    def of(batches):
        triangle = np.zeros((0, dims))
        for batch in batches:
            for block in _blocks(batch.column(0), dims):
                triangle = np.linalg.qr(np.vstack([triangle, _centred(block, mean)]), mode="r")
        yield _triangle_rows(triangle)

    return of


def _join(dims: int):
    """Triangles of a task to one."""

    def of(batches):
        triangle = np.zeros((0, dims))
        for batch in batches:
            for row in batch.column(0):
                other = row.values.to_numpy(zero_copy_only=False).reshape(-1, dims)
                triangle = np.linalg.qr(np.vstack([triangle, other]), mode="r")
        yield _triangle_rows(triangle)

    return of


def _triangle(vectors: DataFrame, dims: int, mean: np.ndarray, scratch: Scratch) -> np.ndarray:
    shape = "triangle array<double>"
    left = scratch.keep(vectors.mapInArrow(_reduce(dims, mean), shape))
    rows = left.count()
    while rows > 1:
        parts = -(-rows // FAN_IN)
        left = scratch.keep(left.repartition(parts).mapInArrow(_join(dims), shape))
        rows = left.count()
    found = np.zeros((dims, dims))
    for (triangle,) in left.collect():
        part = np.array(triangle).reshape(-1, dims)
        found[: len(part)] = part
    return found


def _distinct(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """Every vector once, all of one length."""
    found = scratch.keep(vectors.distinct())
    size = F.size("x")
    shortest, longest = found.agg(F.min(size), F.max(size)).first()
    if shortest == longest:
        return found
    missing = F.array_repeat(F.lit(0).cast("bigint"), F.lit(longest) - size)
    return scratch.keep(found.select(F.concat("x", missing).alias("x")).distinct())


def fit(vectors: DataFrame, scratch: Scratch, components: int) -> Whitening:
    """Whitening of the distinct vectors in the column `x`, a stored table of whole numbers.

    At most `components` of them, fewer where the vectors span fewer dimensions: those whose
    variance is zero within rounding have no scale and are left out. No vectors, or only empty
    ones, give none.
    """
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if dims == 0:
        return Whitening(vectors.count(), (), np.zeros(0), np.zeros((0, 0)), 0.0)
    parts = vectors.mapInArrow(_sums(dims), "n bigint, sums array<string>")
    totals = (
        parts.select("n", F.posexplode("sums").alias("dim", "part"))
        .groupBy("dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    n = int(totals[0].n)
    sums = tuple(int(row.total) for row in sorted(totals, key=lambda row: row.dim))
    triangle = _triangle(vectors, dims, _mean(n, sums), scratch)
    squared, directions = bidiagonal.leading(triangle, components)
    return Whitening(n, sums, squared / n, directions, float((triangle**2).sum()) / n)


def _mean(n: int, sums: tuple[int, ...]) -> np.ndarray:
    return np.array([s / n for s in sums])


def _project(block: np.ndarray, model: Whitening) -> np.ndarray:
    """Row by row in the same order of additions, so equal rows get equal numbers in any batch."""
    centred = _centred(block, _mean(model.n, model.sums))
    scaled = (model.directions / np.sqrt(model.values)).T
    return np.stack([(centred * direction).sum(axis=1) for direction in scaled], axis=1)


def _moments(model: Whitening):
    """Number, mean and centred products of the whitened vectors of a task."""

    def of(batches):
        k = model.components
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for block in _blocks(batch.column(0), len(model.sums)):
                n, mean, products = _merged((n, mean, products), _of_block(_project(block, model)))
        yield pa.RecordBatch.from_pydict(
            {"n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]}
        )

    return of


def _of_block(y: np.ndarray) -> tuple:
    mean = y.mean(axis=0)
    return len(y), mean, (y - mean).T @ (y - mean)


def _merged(one: tuple, two: tuple) -> tuple:
    (n, mean, products), (m, other, more) = one, two
    if n + m == 0:
        return one
    step = other - mean
    return (
        n + m,
        mean + step * (m / (n + m)),
        products + more + np.outer(step, step) * (n * m / (n + m)),
    )


def _merge_rows(k: int):
    def of(batches):
        total = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for n, mean, products in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total = _merged(total, (n, np.array(mean), np.array(products).reshape(k, k)))
        n, mean, products = total
        yield pa.RecordBatch.from_pydict(
            {"n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]}
        )

    return of


def identity_error(vectors: DataFrame, model: Whitening, scratch: Scratch) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity,
    measured on the vectors themselves."""
    k, shape = model.components, "n bigint, mean array<double>, products array<double>"
    left = scratch.keep(vectors.mapInArrow(_moments(model), shape))
    rows = left.count()
    while rows > 1:
        left = scratch.keep(left.repartition(-(-rows // FAN_IN)).mapInArrow(_merge_rows(k), shape))
        rows = left.count()
    row = left.first()
    covariance = np.array(row.products).reshape(k, k) / row.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def _deviations(block: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it is no long."""
    most_sum = max(abs(s) for s in model.sums)
    largest = max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0))))
    bound = largest * model.n + most_sum
    if bound * bound * len(model.sums) <= LONG_MOST:
        return (((block * model.n) - np.array(model.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = block.astype(object) * model.n - np.array(model.sums, dtype=object)
    return [int(d) if d <= LONG_MOST else None for d in (exact**2).sum(axis=1)]


def whiten(
    embeddings: DataFrame,
    scratch: Scratch,
    components: int = 4,
    scale: int = 256,
    vector: str = "embedding",
) -> DataFrame:
    """All columns but the vector of every usable row, once per component, with `component` (from
    1), `n`, `deviation`, `whitened`, `explained` and `identity_error`.

    Entries are taken as double, times `scale`, rounded down. Rows whose vector is null or holds an
    entry that is null, infinite or not a number are left out; nothing else is. The fit uses every
    distinct vector once, so repeated rows change nothing and each of them is returned. A vector
    shorter than the longest counts as zero in the dimensions it lacks. Components are numbered by
    falling variance; those without variance (within rounding) do not exist, so a table of one
    distinct vector, of empty vectors, or without rows gives no rows. Components of equal variance
    come in any order and direction, the same for all rows. A deviation beyond a long is NULL.
    Columns of the input with the names of new ones are replaced.

    The distinct vectors are written once; equal ones are combined before they are shuffled. What
    reaches the driver or the tasks is one triangle of dimension x dimension and the components.
    """
    x, found, place, value = (free_name(embeddings, name) for name in ("x", "found", "place", "value"))
    whole = embeddings.withColumn(x, whole_numbers(F.col(f"`{vector}`"), scale)).filter(F.col(x).isNotNull())
    vectors = _distinct(whole.select(F.col(x).alias("x")), scratch)
    model = fit(vectors, scratch, components)
    new = {
        "component": "int",
        "n": "bigint",
        "deviation": "bigint",
        "whitened": "double",
        "explained": "double",
        "identity_error": "double",
    }
    kept = [f"`{c}`" for c in embeddings.columns if c != vector and c.lower() not in new]
    if model.components == 0:
        typed = [F.lit(None).cast(kind).alias(name) for name, kind in new.items()]
        return embeddings.filter(F.lit(False)).select(*kept, *typed)
    error = identity_error(vectors, model, scratch)
    explained = F.array(*[F.lit(share) for share in (model.values / model.total).tolist()])
    rows = whole.select(*kept, x)
    shape = StructType(rows.schema.fields[:-1]).add(found, PROJECTED)
    projected = rows.mapInArrow(_projected(model, found), shape)
    return projected.select(
        *kept, found, F.posexplode(f"{found}.whitened").alias(place, value)
    ).select(
        *kept,
        (F.col(place) + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col(f"{found}.deviation").alias("deviation"),
        F.col(value).alias("whitened"),
        F.element_at(explained, F.col(place) + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _projected(model: Whitening, found: str):
    """The last column of a batch is the vector; the result takes its place."""
    dims = len(model.sums)

    def of(batches):
        for batch in batches:
            deviations, values = [], []
            for block in _blocks(batch.column(batch.num_columns - 1), dims):
                deviations += _deviations(block, model)
                values += _project(block, model).tolist()
            result = pa.StructArray.from_arrays(
                [pa.array(deviations, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                names=["deviation", "whitened"],
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], result], names=[*batch.schema.names[:-1], found]
            )

    return of
