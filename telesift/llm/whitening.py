"""Whitening of embeddings by an exact scatter matrix in residues."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.llm.common import bounded_batches, pick, written

SCALE, SHIFT = 1024, 100_000
# a long holds x; components past this are taken as the nearest that fits
FARTHEST = 1 << 61
PRIME_BITS = 21
# residues are at most 2^20 in size, so a double adds up 2^13 products exactly; half of that leaves room
ROWS = 4096
COMPONENTS = 8


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>): x = floor(1024 * c) + 100000 for every component; rows without a vector or with a null or non-finite entry go."""
    rows = pick(embeddings, {"vec_id": "long", "embedding": "array<double>"})
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = lambda c: F.floor(F.greatest(F.lit(float(-FARTHEST)), F.least(F.lit(float(FARTHEST)), c * SCALE))).cast("long") + SHIFT
    return rows.filter(F.col("embedding").isNotNull()).filter(~F.exists("embedding", odd)).select("vec_id", F.transform("embedding", whole).alias("x"))


def matrix(x: pa.Array, width: int | None = None) -> np.ndarray:
    """A row a vector, shorter ones filled up with the x of a component 0."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
    width = int(ends.max(initial=0)) if width is None else width
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.full((len(ends), width), SHIFT, np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends]) if len(ends) else []] = flat
    return out


def totals(vectors: DataFrame) -> tuple[int, np.ndarray, int]:
    """(n, sums S of each dimension as exact integers, largest distance of an x from the shift)."""

    def run(batches):
        n, sums, most = 0, [], 0
        for batch in batches:
            x = matrix(batch.column(0)) - SHIFT
            most = max(most, int(np.abs(x).max(initial=0)))
            sums += [0] * (x.shape[1] - len(sums))
            exact = x if most * len(x) < 1 << 62 else x.astype(object)
            sums[: x.shape[1]] = [a + int(b) for a, b in zip(sums, exact.sum(axis=0) if len(x) else [], strict=False)] or sums
            n += len(x)
        columns = [pa.array(np.arange(-1, len(sums))), pa.array([str(n), *map(str, sums)], pa.string()), pa.array([most] * (len(sums) + 1), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["at", "total", "most"])

    parts = bounded_batches(vectors.select("x")).mapInArrow(run, "at long, total string, most long")
    # a row a dimension; totals of all partitions are added as decimals of 38 digits
    rows = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most")).orderBy("at").collect()
    n = int(rows[0]["total"]) if rows else 0
    return n, np.array([int(r["total"]) + n * SHIFT for r in rows[1:]], dtype=object), max((r["most"] for r in rows), default=0)


def primes(bound: int) -> list[int]:
    """The largest primes of PRIME_BITS bits, as many as it takes for their product to pass twice the bound: residues then tell all numbers within it apart."""
    found, product, candidate = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound + 1:
        if all(candidate % d for d in range(3, math.isqrt(candidate) + 1, 2)):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def residue_products(x: np.ndarray, n: int, sums: list[int], moduli: list[int]) -> np.ndarray:
    """For each prime the sum of y y' modulo it, y = n * x - S: centred before multiplying, in products of doubles that are exact."""
    out = np.zeros((len(moduli), x.shape[1], x.shape[1]), np.int64)
    for k, p in enumerate(moduli):
        y = (x % p * (n % p) - np.array([s % p for s in sums], np.int64)) % p
        y = np.where(y > p // 2, y - p, y).astype(np.float64)
        for lo in range(0, len(y), ROWS):
            block = y[lo : lo + ROWS]
            out[k] = (out[k] + (block.T @ block).astype(np.int64)) % p
    return out


def reconstruct(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to 0 with these residues (Chinese remaindering)."""
    whole = math.prod(moduli)
    value = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return value - whole if value > whole // 2 else value


def scatter(vectors: DataFrame, n: int, sums: np.ndarray, most: int) -> np.ndarray:
    """Sum of y y' over all vectors with y = n * x - S, in exact integers.

    Every partition multiplies residues for each prime and gives one matrix a prime; Spark adds these up; the integers come
    back from their residues. Only matrices of width * width entries reach the driver, whatever the number of rows.
    """
    width, given = len(sums), [int(s) for s in sums]
    reach = [n * (most + SHIFT) + abs(s) for s in given]
    moduli = primes(n * max(reach, default=0) ** 2)

    def run(batches):
        out = np.zeros((len(moduli), width, width), np.int64)
        for batch in batches:
            out = (out + residue_products(matrix(batch.column(0), width), n, given, moduli)) % np.array(moduli)[:, None, None]
        rows = [pa.array(a) for a in (np.repeat(np.arange(len(moduli)), width), np.tile(np.arange(width), len(moduli)))]
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(moduli) * width + 1, dtype=np.int32) * width), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*rows, values], ["prime", "i", "residues"])

    parts = bounded_batches(vectors.select("x")).mapInArrow(run, "prime long, i long, residues array<long>")
    parts = parts.select("prime", "i", F.posexplode("residues").alias("j", "r")).filter("j >= i")
    found = np.zeros((width, width, len(moduli)), dtype=object)
    for r in parts.groupBy("prime", "i", "j").agg(F.sum("r").alias("r")).toLocalIterator():
        found[r["i"], r["j"], r["prime"]] = r["r"] % moduli[r["prime"]]
    out = np.zeros((width, width), dtype=object)
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = reconstruct(found[i, j].tolist(), moduli)
    return out


@dataclass
class Whitening:
    """Rows n, sums of x, variances e by falling size, their components (a row each), the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Principal components of all vectors (vec_id, x): unit eigenvectors of the exact covariance, rounded once to doubles.

    Directions without variance (e at the rounding error of the largest one) are left out: nothing can be divided by their root.
    """
    n, sums, most = totals(vectors)
    if n == 0 or not len(sums):
        return Whitening(n, [int(s) for s in sums], np.empty(0), np.empty((0, len(sums))), 0.0)
    exact = scatter(vectors, n, sums, most)
    # the quotient of two integers is the double nearest to it
    covariance = np.array([[v / n**3 for v in row] for row in exact.tolist()], dtype=np.float64)
    trace = sum(exact.diagonal().tolist()) / n**3
    size = float(np.abs(covariance).max(initial=0)) or 1.0
    values, vectors_of = np.linalg.eigh(covariance / size)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(sums) * np.finfo(float).eps * max(values.max(initial=0), 0)]
    return Whitening(n, [int(s) for s in sums], values[order] * size, vectors_of[:, order].T, trace)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of vectors (vec_id, x): one number a component.

    deviation is the sum over dimensions of (n * x - S)^2, exact; null past 38 digits.
    """
    n, width = model.n, len(model.sums)
    turn = (model.components / np.sqrt(model.values)[:, None]).T if len(model.values) else np.empty((width, 0))
    most = (1 << 62) // max(1, n)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            sums = np.array(model.sums, dtype=object)
            if int(np.abs(x).max(initial=0)) < most and all(abs(s) < 1 << 62 for s in model.sums):
                y = x * n - sums.astype(np.int64)
            else:
                y = x.astype(object) * n - sums
            far = int(np.abs(y).max(initial=0))
            squares = (y if far * far * max(1, width) < 1 << 62 else y.astype(object)) ** 2
            deviation = [str(int(d)) for d in (squares.sum(axis=1) if width else np.zeros(len(x), int))]
            out = (y / n).astype(np.float64) @ turn
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.string()), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["vec_id", "deviation", "whitened"])

    rows = bounded_batches(vectors.select("vec_id", "x")).mapInArrow(run, "vec_id long, deviation string, whitened array<double>")
    return rows.select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened")


def identity_error(rows: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of the whitened columns (array<double> of `count`) minus the identity, measured on all rows."""
    if not count:
        return 0.0
    at = lambda i: F.col("whitened")[i]
    means = rows.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(count)]).first()
    if means["m0"] is None:
        return 0.0
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = rows.agg(*[F.avg((at(i) - means[i]) * (at(j) - means[j])).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"v{i}_{j}"] - (i == j)) for i, j in pairs)


def whitening_digest(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    All usable rows are the fit list; shorter vectors count as filled up with components 0. Repeated rows and ids, and null
    ids, count as rows of their own; labels and other columns are not read. A deviation that no long holds is null there and stays whole in
    deviation_exact. Components without variance give no rows, so a table of equal vectors, of one or of none gives none.
    """
    vectors = usable(embeddings)
    model = fit(vectors, components)
    rows = written(whiten(vectors, model))
    error = identity_error(rows, len(model.values))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
