"""Whitening of embeddings by an exact scatter matrix in residue numbers.

Entries become whole numbers far from zero, whose products and sums a double cannot hold. Each task therefore multiplies
its vectors modulo several primes under 2**20, in blocks so small that every dot product is exact in a double; residues
are summed on Spark, and the scatter of all rows is put together from them by the Chinese remainder theorem, as whole
numbers of any length. The covariance is then centred exactly before it becomes a matrix of doubles for `eigh`. As many
primes are taken as the counted rows and the greatest entry call for.

Scale: what leaves a task is a triangle of dimension x dimension sums a prime, whatever its rows; Spark adds them, and the
driver gets one triangle a prime. No key is shuffled, so nothing can be skewed.

Odd rows: vectors that are null, or hold a null, a NaN or an infinity, are left out, and so are those of another length
than most have (of lengths equally frequent the greatest counts), and those with an entry that is no long after scaling.
Repeated rows count as often as they stand and keep their own results; null ids stay. Components along which nothing
varies, as when all vectors are equal or there is one, are 0 in each row and are left out of the identity check. A
deviation that no long holds is null. Without a vector the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's scaling: floor(SCALE * c) + SHIFT. Fixed values.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Primes are under 2**20, so that BLOCK products of two residues sum to 2**53 at most.
PRIME_BITS, BLOCK = 20, 1 << 13
#: Share of the greatest eigenvalue under which a component does not vary.
FLAT = 1e-13
LONG = 1 << 63


def primes(bits: int) -> list[int]:
    """The greatest primes under 2**PRIME_BITS whose product has over that many bits."""
    found, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product >> bits == 0:
        if all(n % p for p in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
            product *= n
        n -= 2
    return found


def from_residues(residues: list[int], moduli: list[int]) -> int:
    """The number between -product / 2 and product / 2 of these residues (Garner's form of the Chinese remainder theorem)."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if value > product // 2 else value


@dataclass(frozen=True)
class Fit:
    """n vectors of whole numbers: their sums, unit eigenvectors as columns, eigenvalues, and the trace."""

    n: int
    top: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they hold it."""
        if 2 * self.n * self.top < LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        spread = np.where(self.values > FLAT * self.values.max(initial=0), self.values, np.inf)
        return (centred / self.n).astype(float) @ self.vectors / np.sqrt(spread)


def vectors(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int, int, int]:
    """(vec_id, x) of the vectors that count, x as an array of longs; how many, how long, and their greatest entry."""
    c = F.col(column)
    limit = float(LONG - 2 * SHIFT)
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * SCALE) < limit))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    whole = embeddings.filter(usable & (F.size(c) > 0)).select("vec_id", x.alias("x"))
    sizes = whole.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("top"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return whole, 0, 0, 0
    return whole.filter(F.size("x") == most["size"]), most["n"], most["size"], most["top"]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length from a list column, without copying."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), size)


def residue_sums(x: DataFrame, size: int, moduli: list[int]) -> dict[tuple[int, int, int], int]:
    """Sums of x_i * x_j modulo each prime over all rows (the last row and column have a 1 beside x, so sums and count)."""
    above = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), size + 1, size + 1), np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), size)
            for start in range(0, len(rows), BLOCK):
                part = rows[start : start + BLOCK]
                for k, p in enumerate(moduli):
                    r = np.ones((len(part), size + 1))
                    r[:, :size] = part % p
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(above[0]), k), pa.int32()), "i": pa.array(above[0], pa.int32()), "j": pa.array(above[1], pa.int32()), "s": pa.array(sums[k][above], pa.int64())})

    tasks = x.select("x").mapInArrow(run, "k int, i int, j int, s long")
    return {(r.k, r.i, r.j): r.s for r in tasks.groupBy("k", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator()}


def fit(x: DataFrame, n: int, size: int, top: int, components: int = COMPONENTS) -> Fit:
    """Eigenvectors of the exact covariance. The result is the same however rows are dealt."""
    moduli = primes((n * max(top, 1) ** 2).bit_length() + 2)
    summed = residue_sums(x, size, moduli)
    exact = {(i, j): from_residues([summed[k, i, j] % p for k, p in enumerate(moduli)], moduli) for i in range(size + 1) for j in range(i, size + 1)}
    sums = [exact[i, size] for i in range(size)]
    covariance = np.array([[(n * exact[min(i, j), max(i, j)] - sums[i] * sums[j]) / n**2 for j in range(size)] for i in range(size)])
    values, found = np.linalg.eigh(covariance)
    trace = sum(n * exact[i, i] - sums[i] ** 2 for i in range(size)) / n**2
    kept = slice(None, -components - 1 if components < size else None, -1)
    return Fit(n, top, sums, np.ascontiguousarray(found[:, kept]), np.maximum(values[kept], 0), trace)


def identity_error(x: DataFrame, model: Fit) -> float:
    """Greatest entry of the covariance of all whitened vectors minus the identity. Tasks send their count, their mean and
    their scatter about it, and those are put together pairwise exactly as for one mean."""
    size = model.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, scatter = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                w = model.whitened(model.centred(matrix(batch.column(0).slice(start, BLOCK), model.size)))
                own = w.mean(0)
                step, total = own - mean, count + len(w)
                scatter += (w - own).T @ (w - own) + np.outer(step, step) * count * len(w) / total
                mean += step * len(w) / total
                count = total
        # the mean of all is 0 up to rounding; a task's own mean enters with its count
        moment = scatter + count * np.outer(mean, mean)
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(moment[i, j])})
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "j": pa.array(np.full(size, -1), pa.int32()), "s": pa.array(count * mean)})

    got = {(r.i, r.j): r.s / model.n for r in x.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator()}
    vary = model.values > FLAT * model.values.max(initial=0)
    errors = [abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j)) for i in range(size) for j in range(i, size) if vary[i] and vary[j]]
    return max(errors, default=0.0)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component."""
    kind = dict(embeddings.dtypes)["vec_id"]
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x, n, size, top = vectors(embeddings)
    if not n:
        return embeddings.sparkSession.createDataFrame([], ddl)
    model = fit(x, n, size, top, components)
    error = identity_error(x, model)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(len(model.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(model.values)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                centred = model.centred(matrix(part.column(1), size))
                reach = int(np.abs(centred).max(initial=0))
                exact = centred if reach**2 * size < LONG else centred.astype(object)
                squares = (exact * exact).sum(1).tolist()
                deviation = pa.array([s if s < LONG else None for s in squares], pa.int64())
                each = np.repeat(np.arange(part.num_rows), many)
                columns = {
                    "vec_id": part.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, many + 1), part.num_rows), pa.int32()), "n": pa.array(np.full(len(each), n), pa.int64()), "deviation": deviation.take(pa.array(each)),
                    "whitened": pa.array(model.whitened(centred).ravel()), "explained": pa.array(np.tile(explained, part.num_rows)), "identity_error": pa.array(np.full(len(each), error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return x.select("vec_id", "x").mapInArrow(run, ddl)
