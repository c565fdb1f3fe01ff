"""Embedding whitening by polarisation covariance.

Entries become the integers ``x = floor(scale * c) + shift``. A first pass counts the vectors and sums
each dimension; a second aggregates, for every dimension and every pair of dimensions, the exact sum of
squares of the centred value. For z = n * x - S these are A(i) = sum of z_i^2 and A(i, j) = sum of
(z_i + z_j)^2, so the covariance is (A(i, j) - A(i) - A(j)) / (2 n^3): variances alone give every
cross-covariance. Entries are centred on the nearest integer of their mean before they are multiplied,
and the remainder R = S - n * round(S / n) enters as n^2 * sum of y^2 - n * R^2, all in integers.
The matrix is assembled in exact arithmetic, rounded once and given to ``eigh``.

Every task sends one row for each dimension and pair, summed on the way; the driver receives these sums
only. The width is that of the embeddings and does not grow with the table.

Cases: vectors that are null or hold null or non-finite entries are left out; those of another length than
most (ties: the longer) too, empty ones among them; repeated rows and ids count each; a null id is kept; ties in
the eigenvalues come in the order of ``eigh``; components without variance (within rounding) have a null ``whitened``
and are left out of the identity error; entries beyond ENTRY are refused; a deviation beyond a long is refused; an
empty table gives no rows; extra columns are ignored.
"""

import dataclasses
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ENTRY = 2.0 ** 40  # largest entry, scaled
ROWS = 1 << 10  # vectors taken at once
LONGEST = (1 << 63) - 1


@dataclasses.dataclass(frozen=True)
class Fit:
    """Exact first moments, and what whitening needs: ``axes`` (width, components) over sqrt(e)."""

    n: int
    pivot: np.ndarray
    rest: list[int]
    values: np.ndarray
    share: np.ndarray
    axes: np.ndarray


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    widths = kept.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).head(1)
    return kept.filter(F.size("embedding") == (widths[0]["width"] if widths else 0)).filter(F.size("embedding") > 0)


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * c) of the vectors of a batch, one a row."""
    flat = np.floor(np.asarray(column.flatten()) * scale)
    if len(flat) and np.abs(flat).max() > ENTRY:
        raise ValueError("an entry is too large to be whitened")
    return flat.astype(np.int64).reshape(len(column), -1)


def _blocks(batches, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _integers(part.column("embedding"), scale)


def _exact(values: np.ndarray, rows: int) -> np.ndarray:
    """As integers whose squares summed over ``rows`` stay exact."""
    largest = int(np.abs(values).max()) if values.size else 0
    return values if largest * largest * 4 * rows <= LONGEST else values.astype(object)


def _sums(vectors: DataFrame, measure) -> dict[int, int]:
    """Sums over all vectors of what ``measure(block)`` gives, by place; exact."""
    def add(batches):
        total = None
        for block in batches:
            found = [int(v) for v in measure(block)]
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total])], ["place", "sum"])

    rows = vectors.select("embedding").mapInArrow(add, "place int, sum string")
    # two halves keep any sum exact: the low 15 digits and the rest, each far below a decimal's 38 digits
    unit = F.lit(10 ** 15).cast("decimal(38,0)")
    value = F.col("sum").cast("decimal(38,0)")
    halves = rows.select("place", (value % unit).alias("low"), F.floor((value - value % unit) / unit).cast("decimal(38,0)").alias("high"))
    return {r["place"]: int(r["high"]) * 10 ** 15 + int(r["low"]) for r in
            halves.groupBy("place").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()}


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i + 1, width)]


def covariance(n: int, rest: list[int], single: list[int], paired: dict[tuple[int, int], int]) -> np.ndarray:
    """The matrix, from sums of squares of y_i and of y_i + y_j: polarised in integers, rounded once."""
    own = [n * s - r * r for s, r in zip(single, rest)]
    out = np.zeros((len(own), len(own)))
    for i, square in enumerate(own):
        out[i, i] = Fraction(square, n * n)
    for (i, j), square in paired.items():
        both = n * square - (rest[i] + rest[j]) ** 2
        out[i, j] = out[j, i] = Fraction(both - own[i] - own[j], 2 * n * n)
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Fit | None:
    """Fit on all rows of ``finite``; None without rows."""
    def first(block):
        return [len(block), *block.astype(object).sum(axis=0)] if _exact(block, len(block)).dtype == object else [len(block), *block.sum(axis=0)]

    sums = _sums(vectors, lambda b: first(_integers(b.column("embedding"), scale)))
    if not sums:
        return None
    n, width = sums[0], len(sums) - 1
    pivot = np.array([(2 * sums[d + 1] + n) // (2 * n) for d in range(width)], np.int64)
    rest = [sums[d + 1] - n * int(pivot[d]) for d in range(width)]

    def squares(batch):
        total = [0] * (width + width * (width - 1) // 2)
        for _, block in _blocks([batch], scale):
            y = _exact(block - pivot, len(block))
            found = [int(v) for v in (y * y).sum(axis=0)]
            for i in range(width - 1):
                both = y[:, i:i + 1] + y[:, i + 1:]
                found += [int(v) for v in (both * both).sum(axis=0)]
            total = [a + b for a, b in zip(total, found)]
        return total

    held = _sums(vectors, squares)
    single = [held[d] for d in range(width)]
    paired = {pair: held[width + k] for k, pair in enumerate(_pairs(width))}
    matrix = covariance(n, rest, single, paired)
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    trace = float(np.trace(matrix))
    least = max(values.max(initial=0.0), 0.0) * width * np.finfo(float).eps
    axes = np.where(values > least, axes / np.sqrt(np.where(values > least, values, 1.0)), np.nan)
    return Fit(n, pivot, rest, values, values / trace if trace > 0 else np.full(len(values), np.nan), axes)


def whiten(vectors: DataFrame, found: Fit, scale: int = SCALE) -> DataFrame:
    """vec_id, deviation, whitened (one entry for each component; NaN where it has no variance)."""
    n, pivot, rest, axes = found.n, found.pivot, found.rest, found.axes
    mean = np.array([float(Fraction(r, n)) for r in rest])
    wide = np.array(rest, dtype=object)

    def project(batches):
        for part, block in _blocks(batches, scale):
            y = block - pivot
            largest = (float(np.abs(y).max(initial=0)) + 1) * n
            z = y * n - np.array(rest, np.int64) if largest ** 2 * y.shape[1] < 2 ** 62 else y.astype(object) * n - wide
            deviation = [int(v) for v in (z * z).sum(axis=1)]
            if max(deviation, default=0) > LONGEST:
                raise ValueError("a deviation does not fit a long")
            out = (y - mean) @ axes
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation, pa.int64()), flat], ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, found: Fit) -> float | None:
    """Largest entry of the covariance of ``whitened`` minus the identity, over all rows, from the same
    squares of single components and pair sums; null without a component that has variance."""
    chosen = np.flatnonzero(~np.isnan(found.axes).any(axis=0))
    width = len(chosen)
    if not width:
        return None

    def squares(batches):
        total = None
        for batch in batches:
            w = np.asarray(batch.column("whitened").flatten()).reshape(batch.num_rows, -1)[:, chosen]
            for at in range(0, len(w), ROWS):
                part = w[at:at + ROWS]
                held = [part.sum(axis=0), (part * part).sum(axis=0)]
                held += [((part[:, i:i + 1] + part[:, i + 1:]) ** 2).sum(axis=0) for i in range(width - 1)]
                row = np.concatenate(held)
                total = row if total is None else total + row
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "sum"])

    # decimals add up alike in any order
    rows = whitened.select("whitened").mapInArrow(squares, "place int, sum double").groupBy("place").agg(
        F.sum(F.col("sum").cast("decimal(38,14)")).alias("sum")).collect()
    sums = {r["place"]: float(r["sum"]) / found.n for r in rows}
    mean, own = [sums[d] for d in range(width)], [sums[width + d] for d in range(width)]
    worst = max(abs(own[d] - mean[d] ** 2 - 1) for d in range(width))
    for k, (i, j) in enumerate(_pairs(width)):
        worst = max(worst, abs((sums[2 * width + k] - own[i] - own[j]) / 2 - mean[i] * mean[j]))
    return worst
