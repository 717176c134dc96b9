"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, ``floor(scale * c)``, so sums and means are exact. The fit list holds each distinct vector once; let A be
its rows minus their mean. One pass over the list adds up the Gram matrix of A, and the Cholesky factor of this matrix, shifted
so far that rounding cannot make it indefinite, is a first R. The next pass solves every row against R (forward
substitution, in the task) and adds up the Gram matrix of the result, which is far better conditioned, and so on until it is the
identity but for rounding. The product of all factors is the R of A = QR; its singular values and right
singular vectors are those of A, without the loss of half the digits that the eigenvalues of one Gram matrix suffer.

Every pass reads the list where it is stored; what travels is a triangle of ``width^2`` sums per task. The factors, ``width^2`` numbers each, go to the tasks; widths
beyond ``MOST_WIDTH`` are refused.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.runtime import cut

#: a factor of this width has 128 MB
MOST_WIDTH = 4096
#: the Gram matrix is the identity but for an error that one more factor takes away
NEAR_IDENTITY = 1e-8
PASSES = 5
#: singular values below this share of the largest are rounding errors of dependent dimensions
NO_VARIANCE = 1e-10
ROUNDING = np.finfo(float).eps / 2
SAFE = 1 << 62


@dataclass
class Whitening:
    """Mean and leading components of a fit list of ``n`` vectors."""

    n: int
    sums: list[int]
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers minus the mean; exact up to the last division where 64 bits can hold it."""
        if self._fits(x, self.n):
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return x.astype(float) - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sum)^2`` for every row, exact; null if 64 bits cannot hold it."""
        if self._fits(x, self.n):
            y = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(y).max(initial=0)) ** 2 * max(1, self.width) < SAFE:
                return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row.tolist(), self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)

    def _fits(self, x: np.ndarray, times: int) -> bool:
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        return largest * times < SAFE and max(map(abs, self.sums), default=0) < SAFE


def whole_vector_column(vector: Column | str, scale: int = 256) -> Column:
    """``floor(scale * c)`` of every entry as long; null for a null vector and one with a null or non-finite entry."""
    v = F.col(vector) if isinstance(vector, str) else vector
    number = lambda c: c.cast("double")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda c: F.floor(F.lit(float(scale)) * number(c))))


def block(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows R^-1`` for an upper triangular ``factor`` R, by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _added(rows: DataFrame, run, kind: str) -> dict[int, object]:
    """Sums over the tasks of the ``(place, part)`` that ``run`` gives; at most a triangle of ``width^2`` places."""
    parts = rows.mapInArrow(run, f"place bigint, part {kind}")
    return {r["place"]: r["part"] for r in parts.groupBy("place").agg(F.sum("part").alias("part")).collect()}


def _column_sums(fit: DataFrame, width: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = block(batch, "x", width)
            largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            own = x.sum(axis=0) if largest * len(x) < SAFE else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, own)]
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(width), pa.int64()), "part": pa.array(total, pa.decimal128(28, 0))})

    found = _added(fit, run, "decimal(28,0)")
    return [int(found[j]) for j in range(width)]


def _gram(fit: DataFrame, of: Whitening, used: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows on the ``used`` dimensions, each solved against all ``factors``."""
    width, size = of.width, len(used)
    above = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows = of.centred(block(batch, "x", width))[:, used]
            for factor in factors:
                rows = solved(rows, factor)
            total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(above[0]))), "part": pa.array(total[above])})

    found, out = _added(fit, run, "double"), np.zeros((size, size))
    out[above] = [found[k] for k in range(len(above[0]))]
    return out + np.triu(out, 1).T


def triangle(fit: DataFrame, of: Whitening, used: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """R with ``R'R = A'A``, from ``gram`` = A'A by as many further passes as it takes."""
    size = len(used)
    total, factors = np.eye(size), []
    for number in range(PASSES):
        if np.abs(gram - np.eye(size)).max() < NEAR_IDENTITY:
            return np.linalg.cholesky(gram).T @ total
        shift = 11 * (of.n * size + size * (size + 1)) * ROUNDING * np.linalg.norm(gram, 2)
        try:
            lower = np.linalg.cholesky(gram if number else gram + shift * np.eye(size))
        except np.linalg.LinAlgError:  # dependent dimensions
            lower = np.linalg.cholesky(gram + shift * np.eye(size))
        factors.append(lower.T)
        total = lower.T @ total
        gram = _gram(fit, of, used, factors)
    values, vectors = np.linalg.eigh(gram)  # dependent dimensions: a root that needs no shift
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ total


def fit_whitening(fit: DataFrame, width: int, components: int) -> Whitening:
    """The whitening of stored distinct vectors ``x`` of ``width`` whole numbers.

    It has fewer than ``components`` components if the vectors vary in fewer directions, none for a single vector.
    """
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of {width} entries: at most {MOST_WIDTH}")
    out = Whitening(fit.count(), _column_sums(fit, width))
    gram = _gram(fit, out, np.arange(width), [])
    used = np.flatnonzero(np.diag(gram) > 0)  # a dimension without variance is exactly 0
    if not len(used):
        return out
    out.trace = float(np.trace(gram)) / out.n
    _, roots, right = np.linalg.svd(triangle(fit, out, used, gram[np.ix_(used, used)]))
    count = min(components, int((roots > NO_VARIANCE * roots[0]).sum()))
    out.axes = np.zeros((width, count))
    for k, axis in enumerate(right[:count]):  # the largest entry is positive, so reruns agree
        out.axes[used, k] = axis * np.sign(axis[np.abs(axis).argmax()])
    out.variances = roots[:count] ** 2 / out.n
    out.identity_error = _identity_error(fit, out)
    return out


def _identity_error(fit: DataFrame, of: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    size, width = of.axes.shape[1], of.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for batch in batches:
            rows = of.whitened(block(batch, "x", width))
            total += np.concatenate([rows.sum(axis=0), (rows.T @ rows).ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total))), "part": pa.array(total)})

    found = _added(fit, run, "double")
    means = np.array([found[k] for k in range(size)]) / of.n
    products = np.array([found[size + k] for k in range(size * size)]).reshape(size, size) / of.n
    return float(np.abs(products - np.outer(means, means) - np.eye(size)).max())


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4, scale: int = 256
) -> tuple[DataFrame, Whitening]:
    """``(id, deviation, whitened)`` of every usable row, and the whitening: up to ``components`` numbers a row.

    Vectors that are null, hold a null or non-finite entry, or have fewer entries than the longest usable one are left
    out. Repeated rows stay repeated, but count once in the fit; null ids stay. Without a usable row, or when all vectors are
    equal, ``whitened`` is empty. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).alias("id"), whole_vector_column(vector_column, scale).alias("x")).where("x is not null")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    kind = rows.schema["id"].dataType.simpleString()
    whole = rows.where(F.size("x") == width)
    if width:
        found = fit_whitening(cut(whole.select("x").distinct()), width, components)
    else:
        found, whole = Whitening(0, []), whole.where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch, "x", width)
            out = found.whitened(x) if found.axes.size else np.zeros((len(x), 0))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "deviation": pa.array(found.deviations(x), pa.int64()),
                "whitened": pa.array(list(out), pa.list_(pa.float64())),
            })

    return whole.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>"), found
