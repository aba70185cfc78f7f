"""Whitening from an exact characteristic polynomial.

The scatter matrix of integer vectors is summed exactly. Its characteristic polynomial is found modulo many primes, each a
Spark row: reduction to Hessenberg form, then the recurrence over leading blocks. Chinese remaindering gives the integer
coefficients. All roots are real, so sign changes of the shifted polynomial count the roots above any number exactly, and
halving isolates each root to any precision. Null-space inverse iteration in high precision gives the components.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle

SCALE = 256
LIMB = 20  # bits: products of limbs, summed over ROWS rows, are exact in doubles
ROWS = 8192
SAME_BITS = 128  # roots that agree in so many bits count as one


def integer_vector(vec: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` as long for each entry, null if the vector or an entry is null, NaN or infinite."""
    wide = vec.cast("array<double>")
    good = wide.isNotNull() & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(good, F.transform(wide, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles l0, l1, ... with ``x = sum(l_i << (LIMB * i))``; only the last may be negative."""
    out = []
    while x.size and (x.min() < -(1 << LIMB) or x.max() >= 1 << LIMB):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows of ``vectors(x array<long>)``, sums by dimension, and ``n * sum(x x') - S S'``, all exact.

    A task adds up its own rows; what it sends is as large as the matrix, whatever its rows, in parts by the shift of
    the limbs, and Spark adds the parts as decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        done = 0

        def parts() -> Iterator[pa.RecordBatch]:
            for shift, z in held.items():
                i, j = np.triu_indices(len(z))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), shift, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(z[i, j])],
                    names=["shift", "i", "j", "part"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0))
            for at in range(0, len(rows), ROWS):
                # A leading 1 gives the count and the sums as the first row of the product.
                x = rows[at : at + ROWS]
                limbs = _limbs(np.hstack([np.ones((len(x), 1), np.int64), x]))
                for a, u in enumerate(limbs):
                    for b, v in enumerate(limbs):
                        product = (u.T @ v).astype(np.int64)
                        held[a + b] = held[a + b] + product if a + b in held else product
                done += 1
                if done == 64:  # at most four pairs of limbs a shift, 2**53 each: within 64 bits
                    yield from parts()
                    held, done = {}, 0
        yield from parts()

    schema = "shift int, i int, j int, part long"
    summed = vectors.select("x").mapInArrow(run, schema).groupBy("shift", "i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    cells: dict[tuple[int, int], int] = {}
    for r in summed.collect():  # (dimensions + 1) squared numbers, halved, for each shift
        cells[r.i, r.j] = cells.get((r.i, r.j), 0) + (int(r.part) << (LIMB * r.shift))
    if not cells:
        return 0, [], []
    dim = max(j for _, j in cells)
    n, sums = cells[0, 0], [cells[0, j] for j in range(1, dim + 1)]
    centred = [
        [n * cells[min(i, j), max(i, j)] - sums[i - 1] * sums[j - 1] for j in range(1, dim + 1)] for i in range(1, dim + 1)
    ]
    return n, sums, centred


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 3.3e24."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(matrix: list[list[int]]) -> list[int]:
    """Primes below 2**31 whose product exceeds every coefficient of the characteristic polynomial.

    The matrix has no negative eigenvalue. By Maclaurin's inequality coefficient k is at most C(d, k) (trace / d)**k.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - a) modulo the prime ``p`` < 2**31, from the constant one up."""
    h, d = a.copy() % p, len(a)
    for k in range(1, d - 1):  # similar steps to Hessenberg form, column by column
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if (i := k + int(below[0])) != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        if u.any():
            h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k][None, :] % p) % p
            # Sums of products would leave 64 bits: split the factor in halves of 16 bits.
            low, high = u & 0xFFFF, u >> 16
            lifted = h[:, k + 1 :]
            h[:, k] = (h[:, k] + (lifted @ high % p << 16) + lifted @ low) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # row k: characteristic polynomial of the leading k x k block
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        t = 1
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            if t == 0:
                break
            polys[k] = (polys[k] - (t * int(h[i - 1, k - 1]) % p) * polys[i - 1]) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x I - matrix) from the constant one up; one Spark row for each prime."""
    primes, d = primes_for(matrix), len(matrix)
    shared = spark.sparkContext.broadcast(matrix)  # dimension squared numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, dtype=object)
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                found.append((p, polynomial_modulo((whole % p).astype(np.int64), p).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))], names=["p", "c"]
            )

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    residues = {r.p: r.c for r in rows.mapInArrow(run, "p long, c array<long>").collect()}
    shared.unpersist()
    product = math.prod(primes)
    out = [0] * (d + 1)
    for p, c in residues.items():
        other = product // p
        factor = other * pow(other, -1, p)
        for k in range(d + 1):
            out[k] += factor * c[k]
    # The sign of each coefficient is known: roots are not negative.
    out = [x % product for x in out]
    return [x if (d - k) % 2 == 0 else -((product - x) % product) for k, x in enumerate(out)]


def roots_above(poly: list[int], at: Fraction) -> int:
    """How many roots of a polynomial with real roots only are greater than ``at``, with multiplicity: the sign changes of
    its coefficients after the shift by ``at`` (Descartes' rule is exact here)."""
    num, den = at.numerator, at.denominator
    c, power = [], 1
    for x in reversed(poly):  # den**d * p(x / den): integers again
        c.append(x * power)
        power *= den
    c.reverse()
    d = len(c) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int = SAME_BITS) -> list[tuple[Fraction, int]]:
    """The ``count`` greatest positive roots in falling order, as ``(value, multiplicity)`` until the multiplicities reach
    ``count``. Intervals are halved until they are ``bits`` bits smaller than the root; roots of one interval are one."""
    out: list[tuple[Fraction, int]] = []
    d, found = len(poly) - 1, 0
    top = 1 << (-poly[d - 1]).bit_length()  # no root is above their sum
    positive = roots_above(poly, Fraction(0))
    while found < min(count, positive, d):
        low, high = Fraction(0), Fraction(top)
        # The next root is the greatest number that more than ``found`` roots are at or above.
        while low == 0 or (high - low) * (1 << bits) > low:
            middle = (low + high) / 2
            if roots_above(poly, middle) > found:
                low = middle
            else:
                high = middle
        many = roots_above(poly, low) - found
        out.append((high, many))
        found += many
    return out


def null_vectors(matrix: list[list[int]], root: Fraction, many: int, digits: int) -> list[list[Decimal]]:
    """``many`` orthonormal vectors of the null space of ``matrix - root``, by inverse iteration from fixed starts."""
    d = len(matrix)
    with decimal.localcontext() as context:
        context.prec = digits
        context.Emin, context.Emax = decimal.MIN_EMIN, decimal.MAX_EMAX
        value = Decimal(root.numerator) / Decimal(root.denominator)
        tiny = value.scaleb(-digits) if value else Decimal(1).scaleb(-digits)
        rows = [[Decimal(x) for x in row] for row in matrix]
        for i in range(d):
            rows[i][i] -= value
        order = list(range(d))
        for k in range(d):  # rows = L U with row exchanges; a zero pivot stands for a tiny one
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best] = rows[best], rows[k]
            order[k], order[best] = order[best], order[k]
            if abs(rows[k][k]) < tiny:
                rows[k][k] = tiny
            pivot = rows[k]
            for i in range(k + 1, d):
                if rows[i][k]:
                    f = rows[i][k] / pivot[k]
                    rows[i] = [*rows[i][:k], f, *[x - f * y for x, y in zip(rows[i][k + 1 :], pivot[k + 1 :])]]

        def solve(b: list[Decimal]) -> list[Decimal]:
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum((rows[i][j] * y[j] for j in range(i)), Decimal(0))
            for i in reversed(range(d)):
                y[i] = (y[i] - sum((rows[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / rows[i][i]
            return y

        def cleaned(v: list[Decimal], basis: list[list[Decimal]]) -> list[Decimal]:
            for u in basis:
                f = sum(a * b for a, b in zip(u, v))
                v = [a - f * b for a, b in zip(v, u)]
            norm = sum(a * a for a in v).sqrt()
            return [a / norm for a in v]

        basis: list[list[Decimal]] = []
        for k in range(many):
            # Starts that are independent of each other and of no special direction.
            v = [Decimal(1) / (1 + (i * (2 * k + 1) + k) % (d + k + 1)) + (i == k) for i in range(d)]
            v, near = cleaned(v, basis), Decimal(10) ** -30
            for _ in range(100):
                before, v = v, cleaned(solve(v), basis)
                if min(max(abs(a - f * b) for a, b in zip(v, before)) for f in (1, -1)) < near:
                    break
            basis.append(v)
        return basis


@dataclass
class Whitening:
    """Components of the fit list: ``axes`` unit rows by falling eigenvalue; ``roots`` are those of n * n * V."""

    n: int
    sums: list[int]
    axes: np.ndarray
    roots: list[float]
    explained: list[float]

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on each component over the root of its eigenvalue; ``n * x - S`` is exact."""
        return self.centred(x).astype(np.float64) @ self.axes.T / np.sqrt(np.array(self.roots))

    def centred(self, x: np.ndarray) -> np.ndarray:
        far = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums))
        kind = np.int64 if far * far * max(1, len(self.sums)) < 1 << 63 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)


def fit(vectors: DataFrame, count: int = 4, scale: int = SCALE) -> tuple[Whitening | None, DataFrame, DataFrame]:
    """The whitening of ``vectors(vec)``, None if no component has a positive eigenvalue, and two tables: the integer
    vectors that took part (all columns, ``x`` added) and the fit list ``(x)``, each different one once."""
    x = vectors.withColumn("x", integer_vector(F.col("vec"), scale)).filter("size(x) > 0")
    shapes = x.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    common = shapes.orderBy(F.desc("rows"), "dim").first()
    dim = common.dim if common else 0
    x = x.filter(F.size("x") == dim)
    distinct = settle(x.select("x").distinct())
    n, sums, matrix = scatter(distinct)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return None, x, distinct
    poly = characteristic_polynomial(vectors.sparkSession, matrix)
    axes, roots = [], []
    for root, many in largest_roots(poly, min(count, dim)):
        digits = 60 + int(SAME_BITS * 0.302) + len(str(trace))
        for v in null_vectors(matrix, root, many, digits):
            axes.append([float(c) for c in v])
            roots.append(root)
    axes, roots = axes[:count], roots[:count]
    explained = [float(r / trace) for r in roots]
    return Whitening(n, sums, np.array(axes), [float(r) for r in roots], explained), x, distinct


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity; the co-moments are merged centred."""
    k = len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = model.project(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    w = distinct.select("x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", count: int = 4, scale: int = SCALE) -> DataFrame:
    """Whitened coordinates of ``vectors`` on the first ``count`` components.

    Per row and component: the id, ``component`` (from 1), ``n`` (vectors of the fit list), ``deviation`` (squared length of
    ``n * x - S``, exact; null beyond 64 bits), ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors whose length is not
    the most common one (the smaller one on ties). Entries beyond 64 bits take the nearest long. Equal vectors count once
    in the fit, and each row gets its own result; ids may be null or repeat. Components with eigenvalue 0 cannot be
    scaled and are left out, so a table with one vector, or none, gives no rows. Of equal eigenvalues any orthonormal
    vectors are components, the same in each run. Other columns are ignored.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).alias("vec"))
    model, x, distinct = fit(rows, count, scale)
    schema = f"{id} {dict(vectors.dtypes)[id]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(model, distinct), len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            far, w = model.centred(v), model.project(v)
            squares = [s if s < 1 << 63 else None for s in (far * far).sum(axis=1).tolist()]
            rows = np.repeat(np.arange(len(v)), k)
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                pa.array(np.full(len(rows), model.n, np.int64)), pa.array(squares, pa.int64()).take(pa.array(rows)),
                pa.array(w.ravel()), pa.array(np.tile(np.array(model.explained), len(v))), pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return x.select("id", "x").mapInArrow(run, schema)
