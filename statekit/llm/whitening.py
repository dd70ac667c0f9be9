"""Whitening of embedding vectors by the exact characteristic polynomial of their integer scatter.

1. *Scatter*: entries become integers; their sums, and the products of entries centred on the rounded mean, are added
   up by Spark without rounding. ``n * products - rest * rest'`` is n * n times the covariance, an integer matrix.
2. *Characteristic polynomial*: modulo many primes by Hessenberg reduction, each prime in a Spark task, joined by
   Chinese remaindering up to a bound that the trace implies.
3. *Roots*: all are real, so by Descartes' rule the sign changes of the polynomial shifted by a are the number of roots
   beyond a; the k-th largest is isolated by bisection with integers only and narrowed to ``WIDTH`` bits.
4. *Components*: inverse iteration in the null space of (matrix - root), in integers of ``DIGITS`` fraction bits. Roots
   nearer to each other than ``TWIN`` bits are one root with a space of several dimensions, solved for together.

Steps 3 and 4 are one Spark task per component. The driver holds what the dimension alone bounds: the matrix, the
polynomial, the components. A component whose root is exactly zero can't be scaled and is left out.

Rows: a vector that is null, or holds null or non-finite entries, is dropped; so is a vector whose length is not that of
most vectors (ties: the longer), for it has no place in the covariance; entries beyond 2**60 / 64 count as that.
Repeated rows count as often as they come, a null id is kept, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
MOST = 1 << 60
SLICE = 2_048
WIDTH, TWIN, DIGITS = 160, 100, 320
ROUNDS = 4
LARGEST_PRIME = (1 << 31) - 1
PRIMES_A_TASK = 16


@dataclass
class Whitening:
    dim: int
    n: int
    sums: list[int]  # of the entries without SHIFT
    trace: float  # of the covariance
    roots: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # one unit component a column


# ---- integer entries -------------------------------------------------------------------------------------------


def integers(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``floor(SCALE * c)`` of the usable vectors of length ``dim``, and which rows those are.

    Without ``dim``: the lengths of the usable vectors.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    value = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(value))]
    end = np.cumsum(size)
    usable = (bad[end] == bad[end - size]) & column.is_valid().to_numpy(zero_copy_only=False)
    if dim is None:
        return size[usable], usable
    usable &= size == dim
    rows = np.flatnonzero(usable)
    picked = value[c.expand((end - size)[rows], size[rows])].reshape(len(rows), dim)
    return np.clip(np.floor(picked * SCALE), -MOST, MOST).astype(np.int64), rows


def limbs(values: np.ndarray, bits: int, parts: int) -> list[np.ndarray]:
    """Integers as ``parts`` digits of ``bits`` bits; the last one carries the sign."""
    out = []
    for _ in range(parts - 1):
        out.append(values & ((1 << bits) - 1))
        values = values >> bits
    return [*out, values]


def limbs_of(values: np.ndarray, bits: int) -> list[np.ndarray]:
    top = int(max(values.max(), -int(values.min()) - 1, 1)) if values.size else 1
    return limbs(values, bits, -(-(top.bit_length() + 1) // bits))


def exact_products(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers; every product of digits is exact in doubles."""
    digits = [d.astype(np.float64) for d in limbs_of(z, 20)]
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            out += (a.T @ b).astype(np.int64).astype(object) << (20 * (i + j))
    return out


def digit_rows(i: np.ndarray, j: np.ndarray, values: np.ndarray):
    """Large integers as rows (i, j, k, v) with sum v * 2**(31 k), which Spark can add up without overflow."""
    rows: dict[str, list] = {"i": [], "j": [], "k": [], "v": []}
    for a, b, value in zip(i.tolist(), j.tolist(), values.tolist(), strict=True):
        sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
        while value:
            rows["i"].append(a)
            rows["j"].append(b)
            rows["k"].append(k)
            rows["v"].append(sign * (value & 0x7FFFFFFF))
            value >>= 31
            k += 1
    return rows


def added_up(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of :func:`digit_rows`; as many as there are pairs (i, j), which the dimension bounds."""
    out: Counter = Counter()
    for r in rows.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] += int(r["v"]) << (31 * r["k"])
    return out


def per_task(vectors: DataFrame, name: str, fn, schema: str) -> DataFrame:
    """One call of ``fn(slices)`` for all batches of a task; ``fn`` gives dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        slices = (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE))
        for columns in fn(slices):
            yield pa.RecordBatch.from_arrays([c.as_arrow(columns[f.name], f.type) for f in arrow], schema=arrow)

    return vectors.select(F.col(name).alias("vector")).mapInArrow(run, schema)


def usual_length(vectors: DataFrame, name: str) -> int:
    """The length of most usable vectors, 0 if there are none."""

    def count(slices):
        seen: Counter = Counter()
        for b in slices:
            seen.update(integers(b.column("vector"))[0].tolist())
        yield {"size": list(seen), "n": list(seen.values())}

    rows = per_task(vectors, name, count, "size int, n long").groupBy("size").agg(F.sum("n").alias("n"))
    row = rows.where("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    return row["size"] if row else 0


def sums(vectors: DataFrame, name: str, dim: int) -> tuple[int, list[int]]:
    """Number of usable vectors and the sum of every entry; key (dim, 0) carries the number."""

    def add(slices):
        n, total = 0, np.zeros(dim, object)
        for b in slices:
            y, _ = integers(b.column("vector"), dim)
            n += len(y)
            for k, digit in enumerate(limbs_of(y, 31)):
                total += digit.sum(axis=0).astype(object) << (31 * k)
        yield digit_rows(np.arange(dim + 1), np.zeros(dim + 1, int), np.r_[total, [n]])

    found = added_up(per_task(vectors, name, add, "i int, j int, k int, v long"))
    return found[dim, 0], [found[i, 0] for i in range(dim)]


def scatter(vectors: DataFrame, name: str, dim: int, n: int, total: list[int]) -> np.ndarray:
    """n * n times the covariance, exactly: entries are centred on the rounded mean, the rest is taken off at the end."""
    centre = [(2 * s + n) // (2 * n) for s in total]
    upper = np.triu_indices(dim)

    def multiply(slices):
        out = np.zeros((dim, dim), object)
        for b in slices:
            y, _ = integers(b.column("vector"), dim)
            out += exact_products(y - np.array(centre, np.int64))
        yield digit_rows(*upper, out[upper])

    found = added_up(per_task(vectors, name, multiply, "i int, j int, k int, v long"))
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]
    out = np.zeros((dim, dim), object)
    for i, j in zip(*upper, strict=True):
        out[i, j] = out[j, i] = n * found[i, j] - rest[i] * rest[j]
    return out


# ---- characteristic polynomial ---------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with the bases that decide every number below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Falling primes below 2**31 whose product is over ``bound``."""
    out, product, p = [], 1, LARGEST_PRIME
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg_polynomials(matrices: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Characteristic polynomials (constant term first) of a stack of matrices, each modulo its prime below 2**31."""
    h, d = matrices.copy(), matrices.shape[1]
    p1, p2, at = primes[:, None], primes[:, None, None], np.arange(len(primes))
    for m in range(1, d - 1):
        pivot = m + (h[:, m:, m - 1] != 0).argmax(axis=1)
        h[at, m], h[at, pivot] = h[at, pivot].copy(), h[at, m].copy()
        h[at, :, m], h[at, :, pivot] = h[at, :, pivot].copy(), h[at, :, m].copy()
        head = h[:, m, m - 1]
        inverse = np.array([pow(int(x), -1, int(p)) if x else 0 for x, p in zip(head, primes, strict=True)])
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m][:, None, :] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    polys = np.zeros((len(primes), d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(1, d + 1):
        before = polys[:, k - 1]
        now = np.concatenate([np.zeros_like(p1), before[:, :-1]], axis=1) - before * h[:, k - 1, k - 1][:, None] % p1
        below = np.ones(len(primes), np.int64)
        for i in range(k - 2, -1, -1):
            below = below * h[:, i + 1, i] % primes
            now -= polys[:, i] * (below * h[:, i, k - 1] % primes)[:, None] % p1
        polys[:, k] = now % p1
    return polys[:, d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant term first, of a symmetric integer matrix without negative eigenvalues.

    No coefficient is over (1 + trace / d)**d, since none of the means of the products of roots is over that of a
    d-fold root.
    """
    d = len(matrix)
    trace = sum(matrix[i, i] for i in range(d))
    primes = primes_beyond(2 * (2 + trace // d) ** d + 1)
    entries = matrix.tolist()

    def reduce(batches):
        for pdf in batches:
            for k in range(0, len(pdf), PRIMES_A_TASK):
                some = pdf["prime"].to_numpy(np.int64)[k : k + PRIMES_A_TASK]
                stack = np.array([[[x % int(p) for x in row] for row in entries] for p in some], np.int64)
                found = hessenberg_polynomials(stack, some)
                yield pdf.iloc[k : k + PRIMES_A_TASK].assign(remainders=list(found))

    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(-(-len(primes) // PRIMES_A_TASK))
    found = rows.mapInPandas(reduce, "prime long, remainders array<long>").collect()
    product = math.prod(primes)
    weights = [(product // r["prime"]) * pow(product // r["prime"], -1, r["prime"]) for r in found]
    out = [sum(w * r["remainders"][k] for w, r in zip(weights, found, strict=True)) % product for k in range(d + 1)]
    out = [x - product if 2 * x > product else x for x in out]
    if out[d] != 1 or out[d - 1] != -trace:
        raise ArithmeticError("the remainders do not fit the trace")
    return out


# ---- roots and components --------------------------------------------------------------------------------------


def scaled(poly: list[int], t: int) -> list[int]:
    """Coefficients, up to a power of two, of the polynomial in x / 2**t."""
    d = len(poly) - 1
    return [a << (t * k) for k, a in enumerate(poly)] if t >= 0 else [a << (-t * (d - k)) for k, a in enumerate(poly)]


def beyond(poly: list[int], m: int, t: int) -> int:
    """How many roots are over m * 2**t: sign changes after a shift, exact because every root is real."""
    out = scaled(poly, t)
    for i in range(len(out) - 1):
        for k in range(len(out) - 2, i - 1, -1):
            out[k] += m * out[k + 1]
    signs = [x > 0 for x in out if x]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def sign_at(poly: list[int], m: int, t: int) -> int:
    value = 0
    for a in reversed(scaled(poly, t)):
        value = value * m + a
    return (value > 0) - (value < 0)


def root(poly: list[int], k: int) -> tuple[int, int, int, int]:
    """The k-th largest root as (m, t, first, size): it lies in (m, m + 1] * 2**t, which holds ``size`` roots, the
    largest of them being the ``first``-th. An interval of one root is narrowed further than one of several."""
    top = max(1, -poly[-2]).bit_length()
    m, t, above, upto = 0, top, 0, beyond(poly, 0, top)
    while upto - above > 1 and t > top - TWIN:
        m, t = 2 * m, t - 1
        middle = beyond(poly, m + 1, t)
        if middle >= k:
            m, upto = m + 1, middle
        else:
            above = middle
    while upto - above == 1 and t > top - WIDTH:
        m, t = 2 * m, t - 1
        sign = sign_at(poly, m + 1, t)
        # With r roots beyond a point the sign there is that of (-1)**r; left of this root r is above + 1.
        if sign and (sign > 0) == (above % 2 == 1):
            m += 1
    return m, t, above + 1, upto - above


def factored(matrix: np.ndarray) -> np.ndarray:
    """Elimination with row pivots in place, the factors below the diagonal; returns the order of the rows."""
    order = np.arange(len(matrix))
    for k in range(len(matrix)):
        pivot = k + max(range(len(matrix) - k), key=lambda i: abs(matrix[k + i, k]))
        matrix[[k, pivot]], order[[k, pivot]] = matrix[[pivot, k]], order[[pivot, k]]
        matrix[k, k] = matrix[k, k] or 1
        matrix[k + 1 :, k] = (matrix[k + 1 :, k] << DIGITS) // matrix[k, k]
        matrix[k + 1 :, k + 1 :] -= (matrix[k + 1 :, k][:, None] * matrix[k, k + 1 :][None, :]) >> DIGITS
    return order


def solved(matrix: np.ndarray, order: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    x = right[order]
    for k in range(len(x)):
        x[k + 1 :] -= (matrix[k + 1 :, k][:, None] * x[k][None, :]) >> DIGITS
    for k in range(len(x) - 1, -1, -1):
        x[k] = ((x[k] << shift) - (matrix[k, k + 1 :][:, None] * x[k + 1 :]).sum(axis=0)) // matrix[k, k]
    return x


def orthonormal(x: np.ndarray) -> np.ndarray:
    for j in range(x.shape[1]):
        column = x[:, j]
        column = (column << DIGITS) // max(1, math.isqrt(sum(v * v for v in column)))
        for i in range(j):
            column = column - (((x[:, i] * column).sum() >> DIGITS) * x[:, i] >> DIGITS)
        x[:, j] = (column << DIGITS) // max(1, math.isqrt(sum(v * v for v in column)))
    return x


def null_space(entries: list[list[int]], m: int, t: int, size: int, top: int) -> np.ndarray:
    """Orthonormal vectors, times 2**DIGITS, that (matrix - root) sends nearly to zero, by inverse iteration."""
    shift = max(0, DIGITS - top)
    a = np.array(entries, object) << shift
    a[np.diag_indices(len(a))] -= (2 * m + 1) << (shift + t - 1)
    lu = a.copy()
    order = factored(lu)
    x = np.random.default_rng(1).integers(-(1 << 31), 1 << 31, (len(a), size)).astype(object) << (DIGITS - 31)
    for _ in range(ROUNDS):
        x = orthonormal(solved(lu, order, x, shift))
    rest = max(abs(v) for v in (a.dot(x) >> DIGITS).ravel())
    if rest >> shift > 1 << max(0, top - 60):
        raise ArithmeticError("inverse iteration has not settled")
    return x


def components(spark: SparkSession, matrix: np.ndarray, poly: list[int], most: int) -> list[tuple[int, int, list[float]]]:
    """Roots as (m, t) for (2 m + 1) * 2**(t - 1), and their unit vectors, by falling root; one Spark task each."""
    rank = len(poly) - 1 - next(k for k, a in enumerate(poly) if a)
    entries, top = matrix.tolist(), max(1, -poly[-2]).bit_length()

    def find(batches):
        for pdf in batches:
            for k in pdf["k"].tolist():
                m, t, first, size = root(poly, k)
                x = null_space(entries, m, t, size, top)[:, k - first]
                yield pdf[pdf["k"] == k].assign(m=str(m), t=t, vector=[[v / (1 << DIGITS) for v in x]])

    rows = spark.range(1, min(most, rank) + 1, numPartitions=max(1, min(most, rank))).withColumnRenamed("id", "k")
    found = rows.mapInPandas(find, "k long, m string, t int, vector array<double>").collect()
    return [(int(r["m"]), r["t"], r["vector"]) for r in sorted(found, key=lambda r: r["k"])]


def fit(spark: SparkSession, vectors: DataFrame, name: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """Components of all usable vectors of a column of arrays of numbers."""
    dim = usual_length(vectors, name)
    if dim == 0:
        return Whitening(0, 0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n, total = sums(vectors, name, dim)
    matrix = scatter(vectors, name, dim, n, total)
    common = math.gcd(*matrix.ravel().tolist())
    trace = sum(matrix[i, i] for i in range(dim))
    if trace == 0:
        return Whitening(dim, n, total, 0.0, np.zeros(0), np.zeros((dim, 0)))
    matrix = matrix // common
    found = components(spark, matrix, characteristic_polynomial(spark, matrix), most)
    roots = [(2 * m + 1) * common / (n * n << (1 - t)) if t < 1 else ((2 * m + 1) * common << (t - 1)) / (n * n) for m, t, _ in found]
    return Whitening(dim, n, total, trace / (n * n), np.array(roots), np.array([v for _, _, v in found]).T.reshape(dim, -1))


# ---- whitened rows ---------------------------------------------------------------------------------------------


def centred(y: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n in doubles, and the sum over dimensions of (n * x - S)**2 as Python integers or longs."""
    dim = y.shape[1]
    if not len(y):
        return np.zeros((0, dim)), np.zeros(0, np.int64)
    most = (int(np.abs(y).max()) + 1) * n + max(map(abs, total))
    if most >= 1 << 62:
        z = y.astype(object) * n - np.array(total, object)
        return (z / n).astype(np.float64), (z * z).sum(axis=1)
    z = y * n - np.array(total, np.int64)
    if most * most * dim < 1 << 63:
        return z / n, (z * z).sum(axis=1)
    digits = limbs(z, 24, 3)
    squares = sum((a * b).sum(axis=1).astype(object) << (24 * (i + j)) for i, a in enumerate(digits) for j, b in enumerate(digits))
    return z / n, squares


def projected(model: Whitening, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, rows = integers(column, model.dim)
    away, squares = centred(y, model.n, model.sums)
    return away @ model.vectors / np.sqrt(model.roots), squares, rows


def identity_error(spark: SparkSession, vectors: DataFrame, model: Whitening, name: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = len(model.roots)
    if not k:
        return 0.0
    shared = spark.sparkContext.broadcast(model)
    at, to = np.indices((k + 1, k))

    def multiply(slices):
        out = np.zeros((k + 1, k))
        for b in slices:
            w, _, _ = projected(shared.value, b.column("vector"))
            out += np.vstack([w.T @ w, w.sum(axis=0)])
        yield {"i": at.ravel(), "j": to.ravel(), "v": out.ravel()}

    rows = per_task(vectors, name, multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((k + 1, k))
    for r in rows.collect():
        out[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def whiten(spark: SparkSession, vectors: DataFrame, model: Whitening, id_col: str = "vec_id", name: str = "embedding") -> DataFrame:
    """A row for each usable vector and component (from 1): the id, component, n, deviation, whitened, explained.

    ``deviation`` is the exact sum of (n * x - S)**2, null beyond 38 digits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

    rest = _parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double")
    kind = vectors.schema[id_col].dataType if id_col in vectors.columns else LongType()
    schema = StructType([StructField(id_col, kind), *rest.fields])
    arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model: Whitening = shared.value
        k = len(model.roots)
        for whole in batches:
            for start in range(0, whole.num_rows if k else 0, SLICE):
                b = whole.slice(start, SLICE)
                w, squares, rows = projected(model, b.column("_vector"))
                if squares.dtype == object:
                    squares = pa.array([v if v < 10**38 else None for v in squares.tolist()], pa.decimal128(38, 0))
                else:
                    squares = pa.array(squares).cast(pa.decimal128(38, 0))
                twice = np.repeat(np.arange(len(rows)), k)
                columns = [
                    b.column("_id").take(pa.array(rows[twice])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(twice), model.n)),
                    squares.take(pa.array(twice)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.roots / model.trace, len(rows))),
                ]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return vectors.select(F.col(id_col).alias("_id"), F.col(name).alias("_vector")).mapInArrow(run, schema)
