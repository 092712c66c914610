"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

1. Every entry c becomes the integer x = floor(1024 c) + 100000.  Tasks add up sums and products of the integers; totals
   are exact, as they are added limb by limb.  M = n * sum(x x') - S S' is n^2 times the covariance.
2. M's characteristic polynomial modulo many 31-bit primes: Spark tasks reduce M to Hessenberg form for a block of primes
   at once.  As many primes are taken as a bound on the coefficients asks for, and Chinese remaindering gives the integers.
3. All roots are real, so the sign changes of the shifted polynomial count the roots above a point exactly.  Halving
   isolates the largest roots, and goes on to 2^-64, far below the rounding of a double.
4. The components are null vectors of M - root: inverse iteration on an LU decomposition with 120 digits.
5. The vectors are projected; what the covariance of the result lacks to the identity is measured on all of them.

Only matrices of dimension by dimension entries reach the driver, whatever the number of vectors.
"""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Steps of the grid of integers per unit, and its origin.
SCALE, ORIGIN = 1024, 100_000
#: Binary digits of a root after the point, decimal digits of the inverse iteration, primes of a task, bits of a limb.
ROOT_BITS, DIGITS, PER_TASK, LIMB = 64, 120, 16, 30


# -- integers --------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that are not null and hold no null or non-finite entry, and their dimension.

    Vectors of another length than the most frequent one (of equally frequent ones: the longest) have no place in its
    covariance and are dropped too; the dimension is 0 when there is nothing left.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = vectors.select("vec_id", "embedding").filter(F.coalesce(fine, F.lit(False)))
    most = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = most[0]["d"] if most else 0
    return good.filter(F.size("embedding") == dim), dim


def grid(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) of doubles: whole numbers as doubles while these are exact, else Python integers."""
    with np.errstate(over="ignore"):
        x = np.floor(values * SCALE)
    if not len(x) or np.abs(x).max() < 2.0 ** 52:
        return x
    whole = [int(v) * SCALE if abs(v) >= 2.0 ** 52 else math.floor(v * SCALE) for v in values.tolist()]
    return np.array(whole, dtype=object)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``grid`` values."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return grid(flat).reshape(-1, dim)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x exactly, as Python integers.  The product of doubles is exact where no sum can reach 2^53."""
    if x.dtype == object:
        return x.T @ x
    most = float(np.abs(x).max()) if x.size else 0.0
    rows = max(1, int(2.0 ** 53 / max(most * most, 1.0)))
    if rows < 64:
        x = x.astype(np.int64).astype(object)
        return x.T @ x
    total = np.zeros((x.shape[1],) * 2, dtype=object)
    for k in range(0, len(x), rows):
        part = x[k:k + rows]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _limbs(value: int):
    """(number, limb) of a signed integer's limbs that aren't zero."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << LIMB) - 1):
            yield k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


def moments(vectors: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, scatter M) of the vectors' integers, without the origin: M doesn't depend on it."""
    def add(batches):
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            sums = sums + np.array([int(v) for v in x.astype(object).sum(axis=0)] if len(x) else [0] * dim, dtype=object)
            products = products + _products(x)
        cells = [(-1, -1, n)] + [(-1, j, int(sums[j])) for j in range(dim)]
        cells += [(i, j, int(products[i, j])) for i in range(dim) for j in range(i, dim)]
        rows = [(i, j, k, v) for i, j, value in cells for k, v in _limbs(value)]
        yield pa.RecordBatch.from_pydict({name: [r[k] for r in rows] for k, name in enumerate("ijkv")}, _CELLS)

    cells = vectors.select("embedding").mapInArrow(add, "i int, j int, k int, v long")
    n, sums, products = 0, [0] * dim, np.zeros((dim, dim), dtype=object)
    for i, j, k, v in cells.groupBy("i", "j", "k").agg(F.sum("v")).collect():
        value = v << (LIMB * k) if v >= 0 else -(-v << (LIMB * k))
        if i >= 0:
            products[i, j] += value
        elif j >= 0:
            sums[j] += value
        else:
            n += value
    scatter = np.zeros((dim, dim), dtype=object)
    for i in range(dim):
        for j in range(i, dim):
            scatter[i, j] = scatter[j, i] = n * products[i, j] - sums[i] * sums[j]
    return n, sums, scatter


_CELLS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("v", pa.int64())])


# -- characteristic polynomial -----------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin; the bases decide every n below 3 * 10^9."""
    if n < 8 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_for(scatter: np.ndarray) -> list[int]:
    """Primes below 2^31 whose product exceeds twice any coefficient: the k-th one is at most C(d, k) (trace / d)^k, as
    no root is negative."""
    d, trace = len(scatter), sum(scatter.diagonal())
    most = max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    out, product, p = [], 1, 2 ** 31
    while product <= 2 * most:
        p -= 1
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p-2) mod p, elementwise; 0 for 0."""
    out, base, e = np.ones_like(a), a % p, p - 2
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return np.where(a % p == 0, 0, out)


def hessenberg_polynomials(residues: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Characteristic polynomials (ascending coefficients) of ``residues[b]`` modulo ``primes[b]``, all b side by side."""
    h, d = residues.astype(np.int64).copy(), residues.shape[1]
    p, at = primes.astype(np.int64), np.arange(len(primes))
    p1, p2 = p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        pivot = m + (h[:, m:, m - 1] != 0).argmax(axis=1)
        swap = h[at, pivot].copy()
        h[at, pivot], h[:, m] = h[:, m].copy(), swap
        swap = h[at, :, pivot].copy()
        h[at, :, pivot], h[:, :, m] = h[:, :, m].copy(), swap
        u = h[:, m + 1:, m - 1] * _inverse(h[:, m, m - 1], p)[:, None] % p1
        h[:, m + 1:] = (h[:, m + 1:] - u[:, :, None] * h[:, m:m + 1] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1:] * u[:, None, :] % p2).sum(axis=2)) % p1
    poly = np.zeros((len(p), d + 1, d + 1), np.int64)
    poly[:, 0, 0] = 1
    below = np.zeros((len(p), 0), np.int64)  # products of the subdiagonal down to row k, for columns 0..k-1
    for k in range(1, d + 1):
        col = h[:, :k - 1, k - 1]
        if k > 1:
            last = h[:, k - 1, k - 2][:, None]
            below = np.concatenate([below * last % p1, last], axis=1)
        drop = (col * below % p1)[:, :, None] * poly[:, :k - 1] % p2
        now = -h[:, k - 1, k - 1][:, None] * poly[:, k - 1] % p1 - drop.sum(axis=1)
        now[:, 1:] += poly[:, k - 1, :-1]
        poly[:, k] = now % p1
    return poly[:, d]


def characteristic_polynomial(spark, scatter: np.ndarray) -> list[int]:
    """Integer coefficients of det(t - scatter), ascending.  A Spark task does a block of primes."""
    d, primes = len(scatter), primes_for(scatter)
    whole = [int(v) for v in scatter.ravel()]

    def reduce(frames):
        for frame in frames:
            for first in frame["id"].tolist():
                block = primes[first:first + PER_TASK]
                left = np.array([[v % p for v in whole] for p in block], np.int64).reshape(-1, d, d)
                polys = hessenberg_polynomials(left, np.array(block, np.int64))
                yield pd.DataFrame({"p": block, "residues": polys.tolist()})

    tasks = -(-len(primes) // PER_TASK)
    found = spark.range(0, len(primes), PER_TASK, tasks).mapInPandas(reduce, "p long, residues array<long>").collect()
    product = math.prod(primes)
    shares = {p: product // p * pow(product // p % p, -1, p) for p in primes}
    out = [0] * (d + 1)
    for row in found:
        share = shares[row["p"]]
        for k, r in enumerate(row["residues"]):
            out[k] += r * share
    out = [v % product for v in out]
    return [v - product if 2 * v > product else v for v in out]


# -- roots and components ----------------------------------------------------------------------------------------


def _above(poly: list[int], point: int) -> int:
    """Roots above an integer point, with multiplicity: sign changes of the polynomial's expansion there (exact, as all
    roots are real)."""
    c, d = list(poly), len(poly) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], point: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * point + c
    return out


def largest_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The ``count`` largest positive roots, falling, repeated as often as they occur, each at most 2^-bits too large."""
    d = len(poly) - 1
    scaled = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    top = -scaled[d - 1] + 1  # the sum of the roots
    out, todo = [], [(0, top, _above(scaled, 0), 0)]
    while todo and len(out) < count:
        low, high, over_low, over_high = todo.pop()
        inside = over_low - over_high
        if not inside:
            continue
        if high - low == 1:
            out += [Fraction(high, 1 << bits)] * inside
            continue
        if inside == 1:  # a simple root: its sign alone decides
            right = _value(scaled, high)
            while right and high - low > 1:
                mid = (low + high) // 2
                here = _value(scaled, mid)
                low, high = (low, mid) if here == 0 or (here > 0) == (right > 0) else (mid, high)
                right = here if high == mid else right
            out.append(Fraction(high, 1 << bits))
            continue
        mid = (low + high) // 2
        over = _above(scaled, mid)
        todo += [(low, mid, over_low, over), (mid, high, over, over_high)]
    return out[:count]


def null_vector(scatter: np.ndarray, root: Fraction, earlier: list[list[Decimal]], steps: int = 3) -> list[Decimal]:
    """Unit vector x with scatter x = root x, orthogonal to ``earlier``: inverse iteration with ``DIGITS`` digits."""
    d = len(scatter)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        lu = [[Decimal(int(v)) for v in row] for row in scatter]
        for i in range(d):
            lu[i][i] -= shift
        least = max(max(abs(v) for v in row) for row in lu) * Decimal(10) ** (-DIGITS * 3 // 4) or Decimal(10) ** -DIGITS
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(lu[i][k]))
            lu[k], lu[best], order[k], order[best] = lu[best], lu[k], order[best], order[k]
            if abs(lu[k][k]) < least:
                lu[k][k] = least
            pivot, head = lu[k][k], lu[k]
            for i in range(k + 1, d):
                row = lu[i]
                if row[k]:
                    f = row[k] = row[k] / pivot
                    for j in range(k + 1, d):
                        row[j] -= f * head[j]
        seed = 1 + len(earlier)
        x = []
        for _ in range(d):  # any start will do; this one is the same on every run
            seed = seed * 1103515245 % 2147483648 + 12345
            x.append(Decimal(seed % 1000003 + 1))
        for _ in range(steps):
            y = [x[i] for i in order]
            for i in range(d):
                y[i] -= sum((lu[i][j] * y[j] for j in range(i)), Decimal(0))
            for i in reversed(range(d)):
                y[i] = (y[i] - sum((lu[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / lu[i][i]
            top = max(abs(v) for v in y)
            y = [v / top for v in y]
            for e in earlier:
                along = sum((a * b for a, b in zip(e, y)), Decimal(0))
                y = [b - along * a for a, b in zip(e, y)]
            size = sum((v * v for v in y), Decimal(0)).sqrt()
            x = [v / size for v in y]
        lead = max(range(d), key=lambda i: (abs(x[i]), -i))
        return x if x[lead] > 0 else [-v for v in x]


def principal(spark, scatter: np.ndarray, count: int) -> list[tuple[Fraction, np.ndarray]]:
    """(root, unit vector) of the scatter's largest positive roots."""
    if not any(scatter.diagonal()):
        return []
    out, found = [], []
    for root in largest_roots(characteristic_polynomial(spark, scatter), count):
        found.append(null_vector(scatter, root, found))
        out.append((root, np.array([float(v) for v in found[-1]])))
    return out


# -- whitened vectors --------------------------------------------------------------------------------------------


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Sum over dimensions of (n x - S)^2, exactly; None where it doesn't fit into a long."""
    whole = (x if x.dtype == object else x.astype(np.int64))
    most = max((abs(int(v)) for v in (whole.max(), whole.min())), default=0) if whole.size else 0
    reach = n * most + max(abs(s) for s in sums)
    if whole.dtype != object and reach * reach * len(sums) < 2 ** 62:
        off = n * whole - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * whole.astype(object) - np.array(sums, dtype=object)
    return [v if v < 2 ** 63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, count: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and
    each of the ``count`` largest components with a positive eigenvalue.

    Null vectors and those with a null or non-finite entry are dropped (see ``usable`` for vectors of other lengths);
    repeated rows count each; a null vec_id stays null; further columns are ignored.  No usable vector, or no variance
    at all: no rows.  ``deviation`` is null where the exact number doesn't fit into a long.
    """
    spark = vectors.sparkSession
    schema = StructType([StructField("vec_id", vectors.schema["vec_id"].dataType), *_parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    good, dim = usable(vectors)
    n, sums, scatter = moments(good, dim) if dim else (0, [], None)
    found = principal(spark, scatter, count) if n else []
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(scatter.diagonal())
    explained = [float(root / trace) for root, _ in found]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    weights = np.stack([v / math.sqrt(root / (n * n)) for root, v in found], axis=1)
    k = len(found)

    def project(x):
        return (x.astype(float) - mean) @ weights

    def second(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = project(_matrix(batch.column(0), dim))
            total, products = total + y.sum(axis=0), products + y.T @ y
        rows = [(-1, j, total[j]) for j in range(k)] + [(i, j, products[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_pydict({name: [r[a] for r in rows] for a, name in enumerate("ijv")},
                                         pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    cells = good.select("embedding").mapInArrow(second, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v"))
    middle, spread = np.zeros(k), np.zeros((k, k))
    for i, j, v in cells.collect():
        if i < 0:
            middle[j] = v / n
        else:
            spread[i, j] = v / n
    error = float(np.abs(spread - np.outer(middle, middle) - np.eye(k)).max())

    def rows(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), pa.array([v for v in (_deviation(x, n, sums) if m else []) for _ in range(k)], pa.int64()),
                pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                schema.names)

    return good.mapInArrow(rows, schema)
