"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Every entry ``c`` becomes the whole number ``floor(64 c) + 1000000``. The scatter ``A = n X'X - S S'`` of those numbers
(``n * n`` times their covariance) is a matrix of integers that tasks add up without rounding. Its characteristic
polynomial is exact as well: modulo many primes a task reduces the matrix to Hessenberg form and reads the polynomial
off, and the remainders give the coefficients (Chinese remaindering, with as many primes as the bound on the
coefficients asks for). All roots of the polynomial are real and none is negative, so by Descartes' rule the number
of sign changes of ``p(x + t)`` *is* the number of roots above ``t``: bisection isolates the largest roots with whole
numbers only and halves on to a relative width of ``2 ** -PRECISION``. Solving ``(A - root) v = b`` in decimals of
``DIGITS`` digits, a few times over, leaves the null vector, which is the component.

What reaches the driver has as many numbers as a covariance; primes and roots are rows that tasks work off.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyflow.llm.common import stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Bits of a root that are settled, digits of the decimals in which components are solved for, solutions in a row.
PRECISION, DIGITS, SOLUTIONS = 160, 90, 3
#: Sums of products of numbers below 2 ** LIMB over CHUNK rows are exact in double precision.
LIMB, CHUNK = 20, 4096
#: Numbers a vector may hold, as whole numbers, so that sums of them stay 64-bit numbers.
LARGEST = 1 << 52


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, x, dim`` of the usable rows, ``x`` being ``floor(64 c)``.

    The ``SHIFT`` of every entry is left out: scatter, deviations and projections are of differences, where it cancels.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    usable = F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = v.where(F.col("c").isNotNull() & F.coalesce(usable, F.lit(False)) & (F.size("c") > 0))
    small = F.forall("c", lambda x: F.abs(x * SCALE) < float(LARGEST))
    told = F.when(small, F.transform("c", lambda x: F.floor(x * SCALE)))
    x = F.coalesce(told, F.raise_error(F.lit(f"an entry of a vector is {LARGEST // SCALE} or more")).cast("array<long>"))
    return rows.select("vec_id", x.alias("x"), F.size("c").alias("dim"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``dim``, the rows of the batch that have it, and their numbers as a matrix."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        column = batch.column("x") if len(at) == len(dims) else batch.column("x").take(pa.array(at))
        yield int(dim), at, column.flatten().to_numpy().reshape(-1, dim)


def products(x: np.ndarray) -> np.ndarray:
    """``x' x`` of 64-bit whole numbers, exactly, as Python's integers."""
    limbs, rest = [], x
    while True:
        low = rest & ((1 << LIMB) - 1)
        high = rest >> LIMB
        if not high.any() or (high == -1).all():
            limbs.append(rest.astype(np.float64))
            break
        if np.abs(rest).max() < 1 << LIMB:
            limbs.append(rest.astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
        rest = high
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), CHUNK):
        for a, p in enumerate(limbs):
            for b, q in enumerate(limbs):
                part = (p[at : at + CHUNK].T @ q[at : at + CHUNK]).astype(np.int64)
                total = total + part.astype(object) * (1 << LIMB * (a + b))
    return total


def scatters(rows: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """For each length of vectors: their number, the sums of their entries and ``n X'X - S S'``, all exact.

    A task sends the upper triangle of a matrix for each length it has met.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                n, s, p = held.get(dim, (0, 0, 0))
                held[dim] = (n + len(x), s + np.array([int(t) for t in x.sum(axis=0)], object), p + products(x))
        for dim, (n, s, p) in held.items():
            upper = [*[(-1, j, s[j]) for j in range(dim)], *[(i, j, p[i, j]) for i in range(dim) for j in range(i, dim)], (-2, 0, n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(upper), pa.int32()), pa.array([u[0] for u in upper], pa.int32()), pa.array([u[1] for u in upper], pa.int32()),
                 pa.array([decimal.Decimal(int(u[2])) for u in upper], pa.decimal128(38, 0))],
                names=["dim", "i", "j", "s"],
            )

    parts = rows.select("x", "dim").mapInArrow(add, "dim int, i int, j int, s decimal(38,0)")
    found: dict[int, tuple[int, list[int], np.ndarray]] = {}
    sums: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        sums.setdefault(r.dim, {})[r.i, r.j] = int(r.s)
    for dim, s in sums.items():
        n, total = s[-2, 0], [s[-1, j] for j in range(dim)]
        a = np.array([[n * s[min(i, j), max(i, j)] - total[i] * total[j] for j in range(dim)] for i in range(dim)], object)
        found[dim] = (n, total, a)
    return found


def primes(count: int) -> list[int]:
    """The largest primes below ``2 ** 31``, so that products of two remainders are 64-bit numbers."""

    def prime(p: int) -> bool:
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for base in (2, 3, 5, 7):  # decides every number below 3,215,031,751
            x = pow(base, d, p)
            if x not in (1, p - 1):
                for _ in range(r - 1):
                    x = x * x % p
                    if x == p - 1:
                        break
                else:
                    return False
        return True

    out, p = [], (1 << 31) - 1
    while len(out) < count:
        if prime(p):
            out.append(p)
        p -= 2
    return out


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(x - a)`` modulo ``p``, constant first, from the Hessenberg form of ``a`` modulo ``p``."""
    h, n = a.copy(), len(a)
    for k in range(1, n - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + below[0]
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), p - 2, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        # Adding multiples of later columns to column k; one product at a time stays below 64 bits.
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        weight, along = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * along % p
            along = along * int(h[i, i - 1]) % p if i else 0
            if not along:
                break
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (polys[:k] * weight[:, None] % p).sum(axis=0)) % p
    return polys[n]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Exact coefficients of ``det(x - a)``, constant first, of a matrix of integers without negative eigenvalues.

    The sum of all products of ``k`` eigenvalues is at most ``C(d, k) (trace / d) ** k`` and never negative, which
    bounds the coefficients and gives their signs; primes are dealt to tasks.
    """
    d, trace = len(a), sum(int(a[i, i]) for i in range(len(a)))
    bound = max(math.comb(d, k) * Fraction(trace, d) ** k for k in range(d + 1))
    used = primes(int(math.log2(math.ceil(bound) + 1) / 30.9) + 2)
    matrix = spark.sparkContext.broadcast([[int(v) for v in row] for row in a])

    def remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix.value, object)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                c = polynomial_modulo((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([c.tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in used], "p long").repartition(min(len(used), spark.sparkContext.defaultParallelism))
    rows = dealt.mapInArrow(remainders, "p long, c array<long>").collect()
    modulus = math.prod(used)
    coefficients = [0] * (d + 1)
    for r in rows:
        others = modulus // r.p
        lift = others * pow(others % r.p, r.p - 2, r.p)
        for k, c in enumerate(r.c):
            coefficients[k] += c * lift
    signed = [c % modulus for c in coefficients]
    return [c - modulus if (d - k) % 2 and c else c for k, c in enumerate(signed)]


def _above(poly: list[int], t: int, bits: int) -> int:
    """Number of roots above ``t / 2 ** bits``: sign changes of the polynomial moved there (all roots are real)."""
    n = len(poly) - 1
    c = [v << bits * (n - k) for k, v in enumerate(poly)]  # roots times 2 ** bits
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            c[k] += t * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], t: int, bits: int) -> int:
    value, scale = 0, 0
    for v in reversed(poly):
        value, scale = value * t + (v << scale), scale + bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int, precision: int = PRECISION) -> list[Fraction]:
    """The ``count`` largest roots, falling, a repeated root as often as it occurs; zero roots are exactly zero.

    A root is the middle of an interval that is isolated by exact counts and narrower than ``2 ** -precision`` of it.
    """
    low = 0
    while low < len(poly) - 1 and poly[low] == 0:
        low += 1
    p = poly[low:]  # without the roots at zero
    n = len(p) - 1
    if not n:
        return [Fraction(0)] * min(count, low)
    top = max(abs(p[n - 1]), 1)  # the sum of the roots
    roots: list[Fraction] = []
    # (low end, high end, bits, roots above the low end, roots above the high end); no root is above the first high end.
    todo = [(0, top, 0, n, 0)]
    while todo and len(roots) < count:
        a, b, bits, over_a, over_b = todo.pop()
        inside = over_a - over_b
        if not inside or over_b >= count:
            continue
        if a and (b - a) << precision <= a:
            roots += [Fraction(a + b, 2 << bits)] * inside
            continue
        a, b, bits = 2 * a, 2 * b, bits + 1
        mid = (a + b) // 2
        if inside == 1 and a:
            # One simple root: the sign at the middle tells its half.
            at, far = _sign(p, mid, bits), _sign(p, b, bits)
            over_mid = over_b + (far == 0 or at not in (0, far))  # sign 0: the root is that end itself
        else:
            over_mid = _above(p, mid, bits)
        todo.append((a, mid, bits, over_a, over_mid))
        todo.append((mid, b, bits, over_mid, over_b))
    roots += [Fraction(0)] * low
    return roots[:count]


def null_vectors(a: np.ndarray, root: Fraction, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors (decimals) that ``a - root`` sends to nearly nothing, by inverse iteration."""
    with decimal.localcontext() as context:
        context.prec = DIGITS
        d = len(a)
        shift = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        lu = np.array([[decimal.Decimal(int(v)) for v in row] for row in a], object)
        least = max(max(abs(v) for v in row) for row in lu).scaleb(-DIGITS + 5) or decimal.Decimal(1).scaleb(-DIGITS)
        for i in range(d):
            lu[i, i] -= shift
        order = np.arange(d)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(lu[k + i, k]))
            if pivot != k:
                lu[[k, pivot]], order[[k, pivot]] = lu[[pivot, k]], order[[pivot, k]]
            if abs(lu[k, k]) < least:
                lu[k, k] = least
            if k + 1 < d:
                lu[k + 1 :, k] = lu[k + 1 :, k] / lu[k, k]
                lu[k + 1 :, k + 1 :] = lu[k + 1 :, k + 1 :] - np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
        found: list[np.ndarray] = []
        rng = np.random.default_rng(d)
        for _ in range(count):
            v = np.array([decimal.Decimal(int(t)) for t in rng.integers(-(10**9), 10**9, d) | 1], object)
            for _ in range(SOLUTIONS):
                v = v[order]
                for k in range(1, d):
                    v[k] -= np.dot(lu[k, :k], v[:k])
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (np.dot(lu[k, k + 1 :], v[k + 1 :]) if k + 1 < d else 0)) / lu[k, k]
                for w in found:
                    v = v - w * np.dot(v, w)
                v = v / np.dot(v, v).sqrt()
            found.append(v)
        return found


def components_of(spark: SparkSession, a: np.ndarray, count: int) -> tuple[np.ndarray, list[Fraction]]:
    """Unit eigenvectors as columns and eigenvalues of ``a``, falling; roots are dealt to tasks."""
    roots = largest_roots(characteristic_polynomial(spark, a), count)
    told = sorted({r for r in roots if r}, reverse=True)
    vectors = np.zeros((len(a), len(roots)))
    if told:
        matrix = spark.sparkContext.broadcast([[int(v) for v in row] for row in a])

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.array(matrix.value, object)
            for batch in batches:
                for at, root, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [[float(t) for t in v] for v in null_vectors(whole, Fraction(root), times)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(at, at + times), pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["at", "v"]
                    )

        todo = [(roots.index(r), str(r), roots.count(r)) for r in told]
        dealt = spark.createDataFrame(todo, "at int, root string, times int").repartition(min(len(todo), spark.sparkContext.defaultParallelism))
        for r in dealt.mapInArrow(solve, "at int, v array<double>").collect():
            vectors[:, r.at] = r.v
    return vectors, roots


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row of ``vectors``
    (``vec_id``, ``embedding``) and each of the ``most`` largest components.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out. Vectors of different lengths
    are fitted apart, each length on its own rows. Repeated rows and null ids are rows like others; extra columns are
    left behind; an empty table gives an empty result. A component without variance (fewer rows than dimensions,
    equal rows) has explained 0 and ``whitened`` null, and takes no part in ``identity_error``, which is the largest over
    all lengths. Of equal eigenvalues the components are any orthonormal ones. ``deviation`` is a decimal, as the
    square of ``n`` times a difference may pass 64 bits. An entry of ``2 ** 46`` or more is an error.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    models = {}
    for dim, (n, total, a) in scatters(rows).items():
        axes, roots = components_of(spark, a, min(most, dim))
        trace = sum(int(a[i, i]) for i in range(dim))
        explained = [float(Fraction(r, trace)) if trace else 0.0 for r in roots]
        used = sum(r > 0 for r in roots)
        scaled = axes[:, :used] / np.array([math.sqrt(r) for r in roots[:used]])
        models[dim] = (n, total, scaled, explained)
    model = spark.sparkContext.broadcast(models)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the whitened numbers of all components."""
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                n, total, scaled, _ = model.value[dim]
                most_far = max(n * int(np.abs(x).max()), max(abs(t) for t in total))
                if dim * (2 * most_far) ** 2 < 1 << 62:
                    far = n * x - np.array(total, np.int64)
                    deviation = (far * far).sum(axis=1).tolist()
                else:
                    far = n * x.astype(object) - np.array(total, object)
                    deviation = [int(t) for t in (far * far).sum(axis=1)]
                w = far.astype(np.float64) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array([dim] * len(at), pa.int32()),
                     pa.array([decimal.Decimal(t) for t in deviation], pa.decimal128(38, 0)), pa.array(w.tolist(), pa.list_(pa.float64()))],
                    names=["vec_id", "dim", "deviation", "w"],
                )

    kind = dict(vectors.dtypes)["vec_id"]
    placed = stage(rows.mapInArrow(place, f"vec_id {kind}, dim int, deviation decimal(38,0), w array<double>"), "placed")
    error = identity_error(placed)
    told = [(d, k + 1, n, e) for d, (n, _, _, explained) in models.items() for k, e in enumerate(explained)]
    # As many rows as there are components.
    shares = F.broadcast(spark.createDataFrame(told, "dim int, component int, n long, explained double"))
    return placed.join(shares, "dim").select(
        "vec_id", "component", "n", "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"), "explained", F.lit(error).alias("identity_error"),
    )


def identity_error(placed: DataFrame) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity, over all lengths (``dim``)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                w = np.array(batch.column("w").take(pa.array(np.flatnonzero(dims == dim))).to_pylist(), np.float64)
                n, s, p = held.get(dim, (0, 0.0, 0.0))
                held[dim] = (n + len(w), s + w.sum(axis=0), p + w.T @ w)
        for dim, (n, s, p) in held.items():
            table = np.vstack([s, p])
            i, j = (x.ravel() for x in np.indices(table.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(i), pa.int32()), pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(i), pa.int64()), pa.array(table.ravel())],
                names=["dim", "i", "j", "n", "s"],
            )

    wide = placed.where(F.size("w") > 0).select("dim", "w")
    parts = wide.mapInArrow(add, "dim int, i int, j int, n long, s double")
    error, sums = 0.0, {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toLocalIterator():
        sums.setdefault(r.dim, {})[r.i, r.j] = r.s / r.n
    for s in sums.values():
        for (i, j), v in s.items():
            if i >= 0:
                error = max(error, abs(v - s[-1, i] * s[-1, j] - (i == j)))
    return error
