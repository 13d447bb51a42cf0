"""Embedding whitening from an exact characteristic polynomial.

Entries become integers; their scatter M = n * sum(x x') - S S' is summed exactly. Its characteristic polynomial is
computed modulo many primes, a Hessenberg reduction for each, the primes dealt out as rows, and put together by
Chinese remaindering. All its roots are real, so the sign changes of the polynomial moved to a say exactly how many roots
lie above a: the largest roots are isolated by that, refined by the sign alone, and each component is found as the
null space of M - root * I by inverse iteration in high precision, a task for each component."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import written

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Bits of a limb of an entry, rows multiplied at once: their products add up below 2^53.
LIMB, BLOCK = 20, 8192
#: Bits that a sum is emitted in, so that long sums of them don't overflow.
DIGIT = 30
#: Bits to which roots are told apart; decimal digits of the inverse iteration.
ROOT_BITS, DIGITS = 110, 90


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c), which is x - 100000, within 62 bits."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -float(1 << 62), float(1 << 62)).astype(np.int64)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x exactly, as Python integers: products of limbs of 20 bits in floating point, no sum of which is rounded."""
    out = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for a in range(0, len(x), BLOCK):
        part = x[a : a + BLOCK]
        n = max(1, -(-(int(np.abs(part).max(initial=0)).bit_length() + 1) // LIMB))
        limbs = [((part >> (LIMB * k)) & ((1 << LIMB) - 1) if k < n - 1 else part >> (LIMB * k)).astype(np.float64) for k in range(n)]
        for i, u in enumerate(limbs):
            for j, v in enumerate(limbs):
                out += (u.T @ v).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products of the whole entries. What reaches the driver is bounded by the dimensions: d * (d + 3) / 2 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            x = whole(_matrix(batch.column(0), d))
            n += len(x)
            products += gram(x)
            for i in range(0, len(x), BLOCK):  # halves, so that no sum overflows
                part = x[i : i + BLOCK]
                sums += (part >> 31).sum(axis=0).astype(object) * (1 << 31) + (part & ((1 << 31) - 1)).sum(axis=0).astype(object)
        cells, digits, values = [], [], []
        for cell, v in enumerate([n, *sums.tolist(), *products[np.triu_indices(d)].tolist()]):
            sign, v, k = (-1 if v < 0 else 1), abs(v), 0
            while v:
                cells.append(cell), digits.append(k), values.append(sign * (v & ((1 << DIGIT) - 1)))
                v, k = v >> DIGIT, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(digits, pa.int32()), pa.array(values, pa.int64())], ["cell", "digit", "value"])

    found = vectors.mapInArrow(run, "cell int, digit int, value long").groupBy("cell", "digit").agg(F.sum("value").alias("value")).collect()
    flat = [0] * (1 + d + d * (d + 1) // 2)
    for r in found:
        flat[r.cell] += r.value << DIGIT * r.digit
    products = [[0] * d for _ in range(d)]
    for (i, j), v in zip(zip(*np.triu_indices(d)), flat[1 + d :]):
        products[i][j] = products[j][i] = v
    return flat[0], flat[1 : 1 + d], products


def primes_below(top: int, n: int) -> list[int]:
    """The ``n`` largest primes below ``top`` (at most 2^32), by a test that has no exceptions there."""
    found, p = [], top - 1 | 1
    while len(found) < n:
        p -= 2
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(p % q for q in (3, 5, 7, 11, 13)) and all(any(v in (1, p - 1) if k == 0 else v == p - 1 for k, v in enumerate(pow(b, odd << i, p) for i in range(twos))) for b in (2, 7, 61)):
            found.append(p)
    return found


def polynomials_mod(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo each prime, highest first. matrix: one of residues for each prime [p, d, d]."""
    a, p = matrix.copy(), primes[:, None]
    b, d = a.shape[0], a.shape[1]
    all_ = np.arange(b)
    for k in range(d - 2):
        at = k + 1 + np.argmax(a[:, k + 1 :, k] != 0, axis=1)  # a column of zeros: no step is needed, and none happens
        rows = a[all_, at].copy()
        a[all_, at], a[:, k + 1] = a[:, k + 1].copy(), rows
        cols = a[all_, :, at].copy()
        a[all_, :, at], a[:, :, k + 1] = a[:, :, k + 1].copy(), cols
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(a[:, k + 1, k], primes)], dtype=np.int64)
        m = a[:, k + 2 :, k] * inverse[:, None] % p
        a[:, k + 2 :] = (a[:, k + 2 :] - m[:, :, None] * a[:, None, k + 1] % p[:, :, None]) % p[:, :, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * m[:, None] % p[:, :, None]).sum(axis=2)) % p
    # polys[k]: lowest first, of the leading k x k part.
    polys = np.zeros((d + 1, b, d + 1), dtype=np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        polys[k, :, 1:] = polys[k - 1, :, :-1]
        polys[k] = (polys[k] - a[:, k - 1, k - 1, None] * polys[k - 1]) % p
        below = np.ones(b, dtype=np.int64)
        for i in range(1, k):
            below = below * a[:, k - i, k - i - 1] % primes
            polys[k] = (polys[k] - (a[:, k - i - 1, k - 1] * below % primes)[:, None] * polys[k - i - 1]) % p
    return polys[d][:, ::-1]


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - m), highest first, of a symmetric ``m`` without negative eigenvalues. One row a prime:
    their number grows with the dimensions and the digits of ``m``, not with the rows it was summed over."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # Coefficient k is the sum of products of k eigenvalues, at most C(d, k) (trace / d)^k.
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 1)
    at_once = max(1, (1 << 21) // (d * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(m, dtype=object)
        for batch in batches:
            mine = batch.column(0).to_numpy()
            for a in range(0, len(mine), at_once):
                some = mine[a : a + at_once]
                found = polynomials_mod(np.stack([(exact % int(p)).astype(np.int64) for p in some]), some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(found), pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    value, modulus = [0] * (d + 1), 1
    for r in rows:  # Chinese remaindering, a prime at a time
        inverse = pow(modulus, -1, r.p)
        value = [v + modulus * ((c - v) * inverse % r.p) for v, c in zip(value, r.c)]
        modulus *= r.p
    return [(-1) ** k * ((-1) ** k * v % modulus) for k, v in enumerate(value)]


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots (all real) are above num / 2^bits, repeated ones as often as they are: the sign changes of poly(x + num / 2^bits)."""
    c = [v << bits * k for k, v in enumerate(poly)]
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += c[i - 1] * num
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], num: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(poly):
        value = value * num + (v << bits * k)
    return (value > 0) - (value < 0)


def isolate(poly: list[int], k: int, top: int) -> tuple[Fraction, int, int]:
    """(root, first, last): the ``k``-th root from above, to ROOT_BITS bits, and the numbers of the first and last
    root that are the same to so many bits. top: a number above all roots."""
    low, high, bits, above_low, above_high = 0, top, 0, roots_above(poly, 0, 0), 0
    while True:
        if high - low == 1:
            low, high, bits = low << 32, high << 32, bits + 32
        if low and low.bit_length() - (high - low).bit_length() >= ROOT_BITS:
            return Fraction(low + high, 2 << bits), above_high + 1, above_low
        mid = (low + high) // 2
        if above_low - above_high > 1:
            above = roots_above(poly, mid, bits)
        else:  # one root within: the sign tells on which side
            sign = _sign(poly, mid, bits)
            if not sign:
                return Fraction(mid, 1 << bits), k, k
            above = k if sign == (-1) ** k else k - 1
        if above >= k:
            low, above_low = mid, above
        else:
            high, above_high = mid, above


def null_space(m: list[list[int]], root: Fraction, size: int) -> list[list[Decimal]]:
    """``size`` orthonormal vectors that m - root * I takes to nothing, by inverse iteration from fixed starts."""
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        a = np.array([[Decimal(v) for v in row] for row in m], dtype=object)
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        for i in range(d):
            a[i, i] -= shift
        least = max(abs(v) for v in a.flat) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
        order = list(range(d))
        for k in range(d):  # factors in place, with row exchanges
            at = max(range(k, d), key=lambda i: abs(a[i, k]))
            if at != k:
                a[[k, at]], order[k], order[at] = a[[at, k]], order[at], order[k]
            if abs(a[k, k]) < least:
                a[k, k] = least
            for i in range(k + 1, d):
                if a[i, k]:
                    a[i, k] /= a[k, k]
                    a[i, k + 1 :] -= a[i, k] * a[k, k + 1 :]
        found = [np.array([Decimal((7919 * (i + 1) * (j + 1) ** 2) % 1009 + 1) for i in range(d)], dtype=object) for j in range(size)]
        for _ in range(3):
            for j in range(size):
                y = found[j][order].copy()
                for i in range(d):
                    y[i] -= a[i, :i].dot(y[:i]) if i else 0
                for i in reversed(range(d)):
                    y[i] = (y[i] - (a[i, i + 1 :].dot(y[i + 1 :]) if i + 1 < d else 0)) / a[i, i]
                for _ in range(2):
                    for other in found[:j]:
                        y = y - other * other.dot(y)
                found[j] = y / y.dot(y).sqrt()
        return [list(v) if v[int(np.argmax(np.abs(v.astype(np.float64))))] > 0 else list(-v) for v in found]


def components(spark, m: list[list[int]], most: int = COMPONENTS) -> list[Row]:
    """Up to ``most`` rows (component, root, vector) of ``m`` by falling eigenvalue above 0, the largest entry of each vector positive."""
    poly, top = characteristic_polynomial(spark, m), sum(m[i][i] for i in range(len(m))) + 1
    n = min(most, roots_above(poly, 0, 0))
    if not n:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                root, first, last = isolate(poly, k, top)
                rows.append((k, f"{root.numerator}/{root.denominator}", [float(v) for v in null_space(m, root, last - first + 1)[k - first]]))
            cols = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.list_(pa.float64())))], ["component", "root", "vector"])

    numbers = spark.createDataFrame([(k,) for k in range(1, n + 1)], "component int").repartition(n, "component")
    return sorted(numbers.mapInArrow(run, "component int, root string, vector array<double>").collect(), key=lambda r: r.component)


def _projected(vectors: DataFrame, d: int, n: int, sums: list[int], found: list[Row]) -> DataFrame:
    """(vec_id, deviation, w): n * x - S squared and summed, exact in 38 digits (else null), and the whitened entries by component."""
    mean = np.array([float(Fraction(s, n)) for s in sums])
    scale = np.array([float(n) / float(Fraction(r.root)) ** 0.5 for r in found])
    basis = np.array([r.vector for r in found]).T * scale
    kind = vectors.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=object)
        for batch in batches:
            x = whole(_matrix(batch.column(1), d))
            fits = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums) < int(((1 << 63) / d) ** 0.5)
            off = n * x - total.astype(np.int64) if fits else n * x.astype(object) - total
            far = [Decimal(v) if v < 10**38 else None for v in (off * off).sum(axis=1).tolist()]
            w = (x - mean) @ basis
            flat = pa.array(w.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "w"])

    schema = f"vec_id {kind.simpleString()}, deviation decimal(38,0), w array<double>"
    return vectors.mapInArrow(run, schema)


def _identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry, without its sign, of the covariance of w less the identity; entries are centred before they are multiplied."""
    mean = rows.agg(*(F.avg(F.col("w")[i]) for i in range(k))).first()
    centred = [F.col("w")[i] - F.lit(mean[i]) for i in range(k)]
    cov = rows.agg(*(F.avg(centred[i] * centred[j]) for i in range(k) for j in range(i, k))).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(cov, ((i, j) for i in range(k) for j in range(i, k))))


def whiten(table: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per fitting row of ``table`` and component (up to ``most``): vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are those whose vector isn't as long as
    most are (of lengths as frequent, the longest). Entries that floor(1024 * c) takes beyond 62 bits count as 2^62. Components have an
    eigenvalue above 0, so vectors that are all alike have none and give no rows; of an eigenvalue that is repeated they are any orthonormal ones.
    deviation: decimal, null beyond 38 digits. Null ids and repeated rows are whitened like others; other columns don't matter; empty table: no rows."""
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = table.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where(finite & (F.size("vector") > 0))
    usual = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = f"vec_id {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if usual is None:
        return spark.createDataFrame([], nothing)
    d = usual.d
    kept = kept.where(F.size("vector") == d)
    n, sums, products = _moments(kept.select("vector"), d)
    m = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    found = components(spark, m, most)
    if not found:
        return spark.createDataFrame([], nothing)
    rows = written(_projected(kept, d, n, sums, found), "whitened")
    trace = sum(m[i][i] for i in range(d))
    share = F.element_at(F.array(*(F.lit(float(Fraction(r.root) / trace)) for r in found)), F.col("component"))
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return out.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(_identity_error(rows, len(found)))).alias("identity_error")
    )
