"""Whitening of embeddings from an exact scatter matrix in residue numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.vector_search import matrix

#: Entries are counted in steps of 1/SCALE.
SCALE = 256
#: Primes are the largest below this. A block of ROWS products of two centred residues sums below 2**53: exact in doubles.
BELOW, ROWS = 1 << 21, 4096
#: The scatter matrix, and nothing else of this size, comes to the driver.
MOST_DIMS = 4096
COMPONENTS = 4


def primes(product_above: int) -> list[int]:
    """The largest primes below BELOW whose product is above this."""
    out, total, p = [], 1, BELOW - 1
    while total <= product_above:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            total *= p
        p -= 2
    return out


def reconstructed(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues (Chinese remainders)."""
    total = math.prod(moduli)
    x = sum(r * (total // p) * pow(total // p, -1, p) for r, p in zip(residues, moduli)) % total
    return x - total if 2 * x > total else x


@dataclass(frozen=True)
class Fit:
    """What the fit list says: n vectors, their sums, and the components of their covariance, largest first."""

    n: int
    sums: list[int]
    largest: int
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def steps_of(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x): floor(SCALE * entry) of the rows that can take part, as longs; beyond a long it stays at the end of the range."""
    v = F.col("vector")
    bare = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(v, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    return bare.filter(v.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("x"))


def longs(column: pa.Array) -> np.ndarray:
    """(n, d) longs of a column of equally long lists without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scatters(moduli: list[int]):
    """One modular product of [1, x] with itself for each prime, over all rows of a partition: each cell once."""

    def run(batches):
        sums = None
        for b in batches:
            for at in range(0, len(b), ROWS):
                x = longs(b.column(0).slice(at, ROWS))
                with_one = np.concatenate([np.ones((len(x), 1), dtype=np.int64), x], axis=1)
                if sums is None:
                    sums = np.zeros((len(moduli), with_one.shape[1], with_one.shape[1]), dtype=np.int64)
                for i, p in enumerate(moduli):
                    r = ((with_one % p + p // 2) % p - p // 2).astype(np.float64)  # within p / 2 of 0
                    sums[i] = (sums[i] + (r.T @ r).astype(np.int64)) % p
        if sums is not None:
            i, j = np.triu_indices(sums.shape[1])
            cell = pa.array(i.astype(np.int64) * sums.shape[1] + j)
            yield pa.RecordBatch.from_arrays([cell, *(pa.array(s[i, j]) for s in sums)], names=["cell", *(f"r{k}" for k in range(len(moduli)))])

    return run


def fit(listed: DataFrame, dim: int) -> Fit:
    """Fit over a stored table (x) of vectors of one length.

    Each partition multiplies residues, in doubles that stay exact; Spark sums the cells; the driver puts each cell
    together by Chinese remainders, as whole numbers. So n * sum(x x') - S S' is exact whatever the order of the
    partitions, and the covariance is what centring before multiplying gives without any rounding, then rounded once.
    """
    if dim > MOST_DIMS:
        raise ValueError(f"{dim} dimensions; the scatter matrix is decomposed on the driver up to {MOST_DIMS}")
    size = F.greatest(F.abs(F.array_max("x").cast("decimal(20)")), F.abs(F.array_min("x").cast("decimal(20)")))
    n, largest = listed.agg(F.count("*"), F.max(size)).first()
    largest = int(largest)
    moduli = primes(2 * n * max(1, largest) ** 2)
    names = [f"r{k}" for k in range(len(moduli))]
    cells = listed.select("x").mapInArrow(_scatters(moduli), ", ".join(f"{c} long" for c in ["cell", *names]))
    sums = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).orderBy("cell").toArrow()  # (dim + 1) * (dim + 2) / 2 rows
    exact = {c: reconstructed([int(r) % p for r, p in zip(rs, moduli)], moduli) for c, *rs in zip(*(sums[c].to_pylist() for c in ["cell", *names]))}
    of = lambda i, j: exact[min(i, j) * (dim + 1) + max(i, j)]
    s = [of(0, j + 1) for j in range(dim)]
    scatter = {(i, j): n * of(i + 1, j + 1) - s[i] * s[j] for i in range(dim) for j in range(i, dim)}
    covariance = np.array([[scatter[min(i, j), max(i, j)] / n**2 for j in range(dim)] for i in range(dim)])  # whole numbers: rounded once
    values, columns = np.linalg.eigh(covariance)
    return Fit(n, s, largest, sum(scatter[i, i] for i in range(dim)) / n**2, values[::-1].copy(), columns[:, ::-1].copy())


def usable_components(f: Fit, most: int) -> int:
    """How many of the first components vary by more than the decomposition's own rounding."""
    least = len(f.values) * np.finfo(np.float64).eps * max(float(f.values[0]), 0.0)
    return int(np.sum(f.values[:most] > least)) if f.trace > 0 else 0


def _whitened(f: Fit, most: int):
    """Of each row, its deviation and the first `most` components, null for those that do not vary."""
    n, s, dim = f.n, np.array(f.sums, dtype=object), len(f.sums)
    good = usable_components(f, most)
    turned = np.ascontiguousarray(f.vectors[:, :good])
    scale = 1 / np.sqrt(f.values[:good])
    furthest = n * f.largest + max((abs(v) for v in f.sums), default=0)
    plain = furthest < 1 << 62  # n * x - S in longs
    squares = plain and dim * furthest**2 < 1 << 63
    sums = s.astype(np.int64) if plain else s

    def run(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                x = longs(b.column(1).slice(at, ROWS))
                off = n * x - sums if plain else n * x.astype(object) - sums
                if squares:
                    deviation = pa.array((off * off).sum(axis=1))
                else:
                    each = (off.astype(object) ** 2).sum(axis=1).tolist()
                    deviation = pa.array([v if v < 1 << 63 else None for v in each], pa.int64())
                flat = np.einsum("ij,jk->ik", (off / n).astype(np.float64), turned) * scale  # a matrix product's last digits vary with the batch
                whole = [pa.array(flat[:, k]) if k < good else pa.nulls(len(x), pa.float64()) for k in range(min(most, dim))]
                names = ["vec_id", "deviation", *(f"w{k + 1}" for k in range(len(whole)))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), deviation, *whole], names=names)

    return run


def _project(rows: DataFrame, f: Fit, most: int) -> DataFrame:
    names = [f"w{k + 1}" for k in range(min(most, len(f.sums)))]
    return rows.mapInArrow(_whitened(f, most), ", ".join(["vec_id long", "deviation long", *(f"{c} double" for c in names)]))


def identity_error(listed: DataFrame, f: Fit, most: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over the components that vary.

    covar_pop takes the mean off before it multiplies.
    """
    good = usable_components(f, most)
    if not good:
        return None
    flat = _project(listed.select(F.lit(None).cast("long").alias("vec_id"), "x"), f, most)
    off = [F.abs(F.covar_pop(f"w{i + 1}", f"w{j + 1}") - F.lit(float(i == j))) for i in range(good) for j in range(i, good)]
    return flat.agg(F.array_max(F.array(*off))).first()[0]


def whiten(vectors: DataFrame, components: int = COMPONENTS, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and its first components.

    Entries become whole steps of 1/SCALE. The fit list holds each distinct vector of steps once, so copies, however many,
    weigh as one; Spark drops them in each task before they move. One pass multiplies it with itself in residues (fit), a
    second measures how white it has become, a third projects all rows; vectors move only
    to find the copies.

    Rows whose vector is null or holds null or non-finite entries take no part. Vectors of each length are whitened by
    themselves, and an empty vector has no components. A component along which nothing varies (one distinct vector, more
    dimensions than vectors) has a null `whitened`; identity_error leaves it out, and is null if there is no other. A
    deviation beyond a long is null, as is `explained` where the trace is 0. Null and repeated vec_ids stay as they are; an
    empty table gives no rows; extra columns are ignored.
    """
    rows = steps_of(vectors, id_column, vector_column).filter(F.size("x") > 0)
    lengths = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    found = [_of_length(rows.filter(F.size("x") == d), d, components) for d in lengths]
    if found:
        return reduce(DataFrame.unionByName, found)
    zero = F.lit(0).cast("long")
    return rows.select("vec_id", F.lit(1).alias("component"), zero.alias("n"), zero.alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])


def _of_length(rows: DataFrame, dim: int, components: int) -> DataFrame:
    listed = materialize(rows.select("x").distinct(), "whitening-list")
    f = fit(listed, dim)
    error = F.lit(identity_error(listed, f, components)).cast("double")
    share = [F.lit(float(v) / f.trace if f.trace > 0 else None).cast("double") for v in f.values[:components]]
    each = [F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), share[k].alias("explained")) for k in range(min(components, dim))]
    flat = _project(rows, f, components).select("vec_id", "deviation", F.explode(F.array(*each)).alias("c"))
    return flat.select("vec_id", "c.component", F.lit(f.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", error.alias("identity_error"))
