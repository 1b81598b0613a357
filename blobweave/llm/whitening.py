"""Embedding whitening from an exact scatter in residue numbers.

Each entry c becomes the whole number x = floor(1024 * c) + 100000.  Moments of
numbers far from zero cancel in floating point, so they are summed exactly: a
partition takes the residues of its rows, with a leading 1, modulo several primes
and multiplies them block by block in double precision.  Primes and blocks are small
enough for every product sum to be a whole number below 2 ** 53.  The sums modulo each
prime are added over partitions, and Chinese remaindering gives n, the sums S and
the scatter as whole numbers; ``primes_for`` takes as many primes as the largest
entry and the number of rows need.  n * scatter - S S' is the covariance times n * n,
exactly, so centring loses nothing.  Its eigenvectors follow in double precision.

What reaches the driver and is broadcast has the size of the dimension squared, at any
number of rows.  Rows are read three times (bounds, scatter, and once for
the whitened values and their covariance each); nothing is staged or shuffled but sums.

Defined results: a vector that is null, or holds a null or non-finite entry, is
dropped, as is one with an entry whose x no 64-bit integer of at most 2 ** 62 holds;
vectors of each length are a fit list of their own; an empty vector has no components;
repeated rows count each and a null vec_id stays null.  A component without variance
(all of them if there is one row) has null ``whitened``; it is left out of
``identity_error``, which is null if none is left; ``explained`` is null if the trace is zero.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Primes lie below 2 ** PRIME_BITS, so that BLOCK_ROWS products of residues stay below 2 ** 53.
PRIME_BITS, BLOCK_ROWS = 20, 4096
LARGEST = 1 << 62
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2 ** PRIME_BITS whose product exceeds ``bound``."""
    found: list[int] = []
    p = 1 << PRIME_BITS
    while prod(found) <= bound:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
    return found


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The whole number nearest to zero that has these residues."""
    whole, out = prod(primes), 0
    for r, p in zip(residues, primes, strict=True):
        rest = whole // p
        out += r % p * rest * pow(rest, -1, p)
    out %= whole
    return out - whole if 2 * out > whole else out


def whole_vectors(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_id, x) of the rows that are kept, for each length of vectors."""
    column = batch["embedding"]
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are nan
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        c = values[starts[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            floor = np.floor(c * SCALE)
        good = (np.abs(floor) <= LARGEST - 2 * OFFSET).all(axis=1)  # false for nan
        if good.any():
            yield batch["vec_id"].take(pa.array(rows[good])), floor[good].astype(np.int64) + OFFSET


def bounds(vectors: DataFrame) -> dict[int, tuple[int, int]]:
    """For each length of vectors the number of rows that are kept and their largest absolute x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for _, x in whole_vectors(batch):
                n, top = found.get(x.shape[1], (0, 1))
                found[x.shape[1]] = n + len(x), max(top, int(np.abs(x).max(initial=1)))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(found), pa.int64()), "n": pa.array([v[0] for v in found.values()], pa.int64()), "top": pa.array([v[1] for v in found.values()], pa.int64())})

    each = vectors.select("vec_id", "embedding").mapInArrow(run, "dim long, n long, top long")
    return {r["dim"]: (r["n"], r["top"]) for r in each.groupBy("dim").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()}


def residue_scatter(vectors: DataFrame, primes: dict[int, list[int]]) -> DataFrame:
    """(dim, prime, cell, residue): sums of residues of the upper triangle of [1 x]' [1 x] over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in whole_vectors(batch):
                dim = x.shape[1]
                for at in range(0, len(x), BLOCK_ROWS):
                    block = np.column_stack([np.ones(len(x[at : at + BLOCK_ROWS]), np.int64), x[at : at + BLOCK_ROWS]])
                    for p in primes[dim]:
                        rest = np.mod(block, p).astype(np.float64)
                        product = np.mod(rest.T @ rest, p).astype(np.int64)
                        sums[dim, p] = (sums.get((dim, p), 0) + product) % p
        for (dim, p), total in sums.items():
            flat = total[np.triu_indices(dim + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), v)) for v in (dim, p)] + [pa.array(np.arange(len(flat))), pa.array(flat)], ["dim", "prime", "cell", "residue"])

    each = vectors.select("vec_id", "embedding").mapInArrow(run, "dim long, prime long, cell long, residue long")
    return each.groupBy("dim", "prime", "cell").agg(F.sum("residue").alias("residue"))


@dataclass(frozen=True)
class Whitening:
    """The fit of vectors of one length: exact n and S, and of each component direction, eigenvalue and share."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    @classmethod
    def of(cls, dim: int, cells: list[int], components: int = COMPONENTS) -> Whitening:
        """``cells``: the upper triangle of the exact scatter of [1 x]."""
        whole = np.zeros((dim + 1, dim + 1), object)
        whole[np.triu_indices(dim + 1)] = cells
        n, sums = int(whole[0, 0]), [int(s) for s in whole[0, 1:]]
        cov = np.zeros((dim, dim))
        trace = 0
        for i in range(dim):
            trace += n * whole[i + 1, i + 1] - sums[i] * sums[i]
            for j in range(i, dim):
                cov[i, j] = cov[j, i] = (n * whole[i + 1, j + 1] - sums[i] * sums[j]) / (n * n)  # rounded once
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        if dim:
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        # what rounding leaves of no variance is none
        values = np.where(values > dim * np.finfo(float).eps * max(values[:1], default=0.0), values, 0.0)
        return cls(n, sums, vectors, values, [float(v / (trace / (n * n))) if trace else None for v in values])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as 64-bit integers where they hold it, else as Python's."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        return x * self.n - np.array(self.sums, np.int64) if largest < LARGEST else x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, y: np.ndarray) -> list[int]:
        """The exact sum of squares of each row of ``centred``."""
        if y.dtype == object or np.abs(y).max(initial=0) ** 2.0 * y.shape[1] >= LARGEST:
            y = y.astype(object)
        return (y * y).sum(axis=1).tolist()

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """A column a component; nan where it has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y.astype(np.float64) / self.n) @ self.directions / np.sqrt(self.values), np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of ``vectors`` (vec_id, embedding) of each length."""
    primes = {dim: primes_for(2 * n * top * top) for dim, (n, top) in bounds(vectors).items()}
    residues: dict[int, dict[int, dict[int, int]]] = {}
    for r in residue_scatter(vectors, primes).toLocalIterator() if primes else ():
        residues.setdefault(r["dim"], {}).setdefault(r["cell"], {})[r["prime"]] = r["residue"]
    return {dim: Whitening.of(dim, [remaindered([cells[k][p] for p in primes[dim]], primes[dim]) for k in range(len(cells))], components) for dim, cells in residues.items()}


def identity_errors(vectors: DataFrame, told: dict[int, Whitening]) -> dict[int, float]:
    """The largest absolute entry of the covariance of the whitened vectors less the identity, for each length.

    The values are centred already, so their sums are near zero and take nothing from the products' precision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_vectors(batch):
                w = told[x.shape[1]]
                z = np.column_stack([np.ones(len(x)), w.whitened(w.centred(x))[:, w.values > 0]])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + z.T @ z
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, dim)), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["dim", "cell", "sum"])

    each = vectors.select("vec_id", "embedding").mapInArrow(run, "dim long, cell long, sum double")
    cells: dict[int, dict[int, float]] = {}
    for r in each.groupBy("dim", "cell").agg(F.sum("sum").alias("sum")).collect():
        cells.setdefault(r["dim"], {})[r["cell"]] = r["sum"]
    out = {}
    for dim, found in cells.items():
        k = int(len(found) ** 0.5)
        s = np.array([found[i] for i in range(k * k)]).reshape(k, k) / told[dim].n
        if k > 1:
            out[dim] = float(np.abs(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) - np.eye(k - 1)).max())
    return out


def whiten(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """A row for each kept vector of ``vectors`` (vec_id, embedding) and component (OUT); ``deviation`` is null beyond 38 digits."""
    told = fit(vectors, components)
    errors = identity_errors(vectors, told) if told else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in whole_vectors(batch):
                w = told[x.shape[1]]
                k = len(w.values)
                y = w.centred(x)
                z = w.whitened(y)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array([d if d < 10**38 else None for d in w.deviation(y)], pa.decimal128(38, 0))
                flat = z.ravel()
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), w.n)), deviation.take(each),
                    pa.array(flat, mask=np.isnan(flat)), pa.array(w.explained * len(x), pa.float64()), pa.array([errors.get(x.shape[1])] * len(flat), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, OUT)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """``deviation`` is null where a long does not hold it."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
