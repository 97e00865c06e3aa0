"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

Spark sums the integer vectors and their products exactly, one partial result a task.  The scatter
n * sum(x x') - S S' is n^2 times the covariance.  Its characteristic polynomial is found modulo many
primes, one Spark row a prime: Hessenberg form by similarity, then its polynomial by recurrence; Chinese
remainders put the integer coefficients together.  All roots are real, so Descartes' rule counts exactly:
the sign changes of the polynomial shifted by a are its roots above a, with their multiplicity.  Bisection on these
counts isolates the largest roots and narrows them to ``DIGITS`` digits.  Null-space inverse iteration with that many
digits gives the components, each made orthogonal to those before.

The driver holds d^2 integers of a d-dimensional space, nothing that grows with the rows.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; shorter vectors
are read as if zeros stood in the missing places; an entry beyond the range of long becomes its nearest
long; components of variance zero do not exist, so equal rows or a single one give no rows, nor does an
empty table; repeated and null ids are rows like any other; other columns are left out, so their names cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, SHIFT, COMPONENTS, DIGITS = 1024, 100_000, 8, 60
#: Integers that floating point holds exactly, and that a long holds.
EXACT, LONG = 1 << 53, (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (array of doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", vector.alias("vector"))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(1024 * entry) of every vector, before the shift: floats that are whole numbers, or Python integers if they are large."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = np.floor(np.asarray(column.values.to_numpy(zero_copy_only=False))[offsets[0]:offsets[-1]] * SCALE)
    sizes, n = np.diff(offsets), len(column)
    out = np.zeros((n, d))
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    if np.abs(out).max(initial=0) < 1 << 40:
        return out
    whole = np.array([[max(-LONG - 1, min(LONG, int(v) + SHIFT)) - SHIFT if np.isfinite(v) else (LONG - SHIFT if v > 0 else -LONG - 1 - SHIFT)
                       for v in r] for r in out.tolist()], dtype=object)
    return whole.reshape(n, d)


def _exact_product(a: np.ndarray, b: np.ndarray, terms: int) -> np.ndarray:
    """a @ b in exact integers (Python integers in the result)."""
    top = lambda x: int(np.abs(x).max(initial=0)) if x.size else 0
    if a.dtype != object and b.dtype != object and top(a) * top(b) * max(terms, 1) < EXACT:
        return np.vectorize(int, otypes=[object])(a @ b) if a.size and b.size else (a @ b).astype(object)
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b)


def moments(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and product sums of the integer vectors before the shift, exactly."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _integers(batch.column(0), d)
            n += len(x)
            sums = sums + _exact_product(np.ones((1, len(x))), x, len(x))[0]
            products = products + _exact_product(x.T, x, len(x))
        if n:
            upper = [(i, j, products[i, j]) for i in range(d) for j in range(i, d)]
            cells = [(-1, -1, n)] + [(-1, i, sums[i]) for i in range(d)] + upper
            i, j, v = zip(*cells)
            # four limbs of 32 bits, so that Spark adds longs and no size of the numbers matters
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                   **{f"v{k}": pa.array([(x >> 32 * k) & 0xFFFFFFFF if k < 4 else x >> 128 for x in v], pa.int64())
                                      for k in range(5)}})

    limbs = [f"v{k}" for k in range(5)]
    cells = vectors.select("vector").mapInArrow(partial, "i int, j int, " + ", ".join(f"{v} long" for v in limbs))
    found = {(r.i, r.j): sum(r[v] << 32 * k for k, v in enumerate(limbs))
             for r in cells.groupBy("i", "j").agg(*[F.sum(v).alias(v) for v in limbs]).collect()}
    n = found.get((-1, -1), 0)
    return n, [found.get((-1, i), 0) for i in range(d)], [[found.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2^31), by trial of strong pseudoprime bases that are exact there."""
    def prime(p):
        if p % 2 == 0:
            return p == 2
        s = ((p - 1) & (1 - p)).bit_length() - 1
        for base in (2, 3, 5, 7):
            x = pow(base, (p - 1) >> s, p)
            if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(s - 1)):
                return False
        return True
    found, p = [], top - 1
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 1
    return found


def hessenberg(m: np.ndarray, p: int) -> np.ndarray:
    """Upper Hessenberg form of ``m`` modulo the prime ``p`` by a similarity."""
    h, d = m % p, len(m)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        r = k + 1 + int(rows[0])
        h[[k + 1, r]] = h[[r, k + 1]]
        h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo ``p``, the constant first."""
    h, d = hessenberg(m, p), len(m)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        below, weights = 1, np.zeros(k + 1, np.int64)
        for i in range(k, -1, -1):
            weights[i] = h[i, k] * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[:k + 1] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x - m) for a symmetric matrix without negative eigenvalues, the constant first."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = max(comb(d, k) * trace ** k for k in range(d + 1))  # no product of k eigenvalues exceeds trace^k
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 2)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column(0).to_pylist()
            reduced = [polynomial_mod(np.array([[v % p for v in row] for row in m], np.int64), p) for p in each]
            yield pa.record_batch({"p": pa.array(each, pa.int64()), "coefficients": pa.array([c.tolist() for c in reduced], pa.list_(pa.int64()))})

    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, min(len(primes) // 4, 200)))
            .mapInArrow(residues, "p long, coefficients array<long>").collect())
    modulus, total = 1, [0] * (d + 1)
    for r in rows:  # Chinese remainders, a prime at a time
        inverse = pow(modulus % r.p, -1, r.p)
        total = [c + modulus * ((v - c) * inverse % r.p) for c, v in zip(total, r.coefficients)]
        modulus *= r.p
    return [c - modulus if c > modulus // 2 else c for c in total]


def roots_above(poly: list[int], a: int, bits: int) -> int:
    """How many roots of a polynomial with only real roots exceed a / 2^bits: sign changes after a Taylor shift."""
    d = len(poly) - 1
    c = [v << bits * (d - k) for k, v in enumerate(poly)]  # the roots times 2^bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, digits: int = DIGITS) -> list[Decimal]:
    """The largest positive roots, falling, repeated ones as often as they occur, to about ``digits`` digits."""
    d = len(poly) - 1
    count = min(count, roots_above(poly, 0, 0))
    top = 1 << (-poly[d - 1]).bit_length()  # the trace bounds every root
    found = []
    for k in range(1, count + 1):
        low, high, bits = 0, top, 0
        n_low, n_high = roots_above(poly, 0, 0), 0
        # halve until the root stands alone or the interval is narrow: counts decide
        while True:
            if high - low < 2:
                low, high, bits = low << 8, high << 8, bits + 8
            if low and (low.bit_length() - (high - low).bit_length()) > digits * 10 // 3:
                break
            if n_low == k and n_high == k - 1 and low:
                break
            middle = (low + high) // 2
            n = roots_above(poly, middle, bits)
            low, n_low, high, n_high = (middle, n, high, n_high) if n >= k else (low, n_low, middle, n)
        # a root that stands alone changes the sign: one evaluation a step
        above = k % 2 == 1  # k - 1 roots lie above
        while low.bit_length() - (high - low).bit_length() <= digits * 10 // 3:
            low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            low, high = (low, middle) if (_horner(poly, middle, bits) > 0) == above else (middle, high)
        with localcontext(Context(prec=digits + 20)):
            found.append(Decimal(low + high) / (Decimal(2) ** (bits + 1)))
    return found


def _horner(poly: list[int], a: int, bits: int) -> int:
    out = 0
    for k, v in enumerate(reversed(poly)):
        out = out * a + (v << bits * k)
    return out


def eigenvectors(m: list[list[int]], values: list[Decimal], digits: int = DIGITS) -> np.ndarray:
    """Unit vectors of the null spaces of m - value, by inverse iteration; rows, as doubles."""
    d, found = len(m), []
    with localcontext(Context(prec=2 * digits + 20, Emax=10 ** 8, Emin=-10 ** 8)):
        whole = np.array([[Decimal(v) for v in row] for row in m], dtype=object).reshape(d, d)
        for k, value in enumerate(values):
            lu, order = whole - np.diag([value] * d), list(range(d))
            tiny = value * Decimal(10) ** (-digits)
            for c in range(d):
                pivot = max(range(c, d), key=lambda r: abs(lu[r, c]))
                lu[[c, pivot]] = lu[[pivot, c]]
                order[c], order[pivot] = order[pivot], order[c]
                if abs(lu[c, c]) < tiny:
                    lu[c, c] = tiny
                lu[c + 1:, c] = lu[c + 1:, c] / lu[c, c]
                lu[c + 1:, c + 1:] = lu[c + 1:, c + 1:] - np.outer(lu[c + 1:, c], lu[c, c + 1:])
            x = np.array([Decimal((i * i * 7 + k * 11 + 3) % 101 - 50) / 50 + 1 for i in range(d)], dtype=object)
            for _ in range(4):
                y = x[order]
                for i in range(1, d):
                    y[i] = y[i] - (lu[i, :i] * y[:i]).sum()
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - (lu[i, i + 1:] * y[i + 1:]).sum()) / lu[i, i] if i + 1 < d else y[i] / lu[i, i]
                for _ in range(2):
                    y = y / (y * y).sum().sqrt()
                    for v in found:
                        y = y - v * (v * y).sum()
                x = y / (y * y).sum().sqrt()
            found.append(x)
    return np.array([[float(v) for v in x] for x in found]).reshape(len(found), d)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error of every row and component."""
    spark = rows.sparkSession
    vectors = usable(rows)
    d = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    n, sums, products = moments(vectors, d) if d else (0, [], [])
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return spark.createDataFrame([], schema)
    values = largest_roots(characteristic_polynomial(spark, scatter), components)
    axes = eigenvectors(scatter, values)
    explained = [float(v / Decimal(trace)) for v in values]
    with localcontext(Context(prec=DIGITS)):
        scale = np.array([float(Decimal(n) / v.sqrt()) for v in values])  # the covariance is the scatter over n^2
        mean = np.array([float(Decimal(s) / Decimal(n)) for s in sums])
    square = sum(s * s for s in sums)

    def project(x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - mean) @ axes.T * scale

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(axes), len(axes)))
        for batch in batches:
            w = project(_integers(batch.column(0), d))
            total += w.T @ w
        yield pa.record_batch({"i": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel())})

    # whitened values have mean zero, so their mean product is their covariance
    cells = vectors.select("vector").mapInArrow(covariance, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = np.zeros(len(axes) ** 2)
    found[[r.i for r in cells]] = [r.v / n for r in cells]
    error = float(np.abs(found.reshape(len(axes), -1) - np.eye(len(axes))).max())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.array(sums, dtype=object).reshape(d, 1)
        k = len(axes)
        for batch in batches:
            x = _integers(batch.column("vector"), d)
            w = project(x)
            own = np.vectorize(int, otypes=[object])((x * x).sum(axis=1)) if x.dtype != object and np.abs(x).max(initial=0) ** 2 * d < EXACT \
                else np.array([sum(int(v) ** 2 for v in r) for r in x], dtype=object)
            cross = _exact_product(x, column.astype(float) if max(map(abs, sums)) < EXACT else column, d)[:, 0]
            # sum of (n x - S)^2; the shift of x and S cancels
            deviation = [n * n * a - 2 * n * b + square for a, b in zip(own, cross)]
            deviation = pa.array([Decimal(v) if abs(v) < 10 ** 38 else None for v in deviation], pa.decimal128(38, 0))
            take = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(take), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(size, n, np.int64)), "deviation": deviation.take(take), "whitened": pa.array(w.ravel()),
                "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array(np.full(size, error))})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(emit, schema)
