"""Embedding whitening: the leading eigenpairs of the covariance by Jacobi-Davidson, without a matrix.

Entries become integers, floor(scale * entry). The fit list holds every distinct vector once, packed into
blocks of `BLOCK_ROWS` rows. The covariance V is never formed: a product V Y is one pass over the blocks,
in which every task centres its rows, multiplies them twice and sends one array of the size of Y.

* Search. A subspace W and its products V W give Ritz pairs (Rayleigh-Ritz); all wanted pairs are improved
  at once. Each takes the correction equation `(I - P)(V - theta I)(I - P) t = -r`, where P projects onto the
  locked vectors and the present Ritz vectors, and solves it roughly by `INNER` steps of MINRES. The
  solvers of all pairs run in lockstep, so that a step of all of them is one pass.
* Locking. The leading pair is locked as soon as its residual is below `TOLERANCE` times the largest
  eigenvalue, a few roundings of double precision; what follows is kept orthogonal to it. The basis restarts
  from the best Ritz vectors once it has `BASIS` of them.
* Passes do not depend on the number of rows. On the driver are arrays of dimension x `BASIS` at most; sums
  of tasks are added in a tree with fan-in `FAN_IN` before they reach it.

Sums of the fit list and `deviation` are exact; a deviation beyond a long is held at its end, as is an integer
entry. Products are in double precision, sums over blocks in extended precision.

Defined cases: vectors that are null or hold null or non-finite entries take no part; empty ones have no
components. Vectors of different lengths are fitted apart. Repeated vectors count once in the fit and each
get their rows; a null vec_id stays null. Directions without variance (one vector only, fewer vectors than
dimensions) cannot be whitened and give no row, so there may be fewer components than asked. No rows, no
result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import slices, stored

SCALE, COMPONENTS = 256, 4
BLOCK_ROWS, FAN_IN = 4096, 32
BASIS, INNER, ROUNDS = 48, 6, 300
TOLERANCE = 2.0**-46
#: Eigenvalues below this share of the trace (times the dimension) are rounding.
NOTHING = 2.0**-50
LONG = np.iinfo(np.int64)


@dataclass
class Fit:
    """The fit of one vector length: exact sums, components by falling eigenvalue, checks."""

    dim: int
    n: int
    sums: list[int]
    vectors: np.ndarray  # dim x components
    values: np.ndarray
    residuals: np.ndarray  # of V v - e v, as shares of the largest eigenvalue
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return means(self.sums, self.n)


def means(sums: list[int], n: int) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def sound(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, the integer entries, of the vectors that take part."""
    slim = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter(sound(F.col("e")) & (F.size("e") > 0))
    return slim.select("vec_id", F.transform("e", lambda c: F.floor(c * float(scale))).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per vector length of a batch: places of its rows and their entries as a matrix of longs."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == dim)
        yield mine, flat[starts[mine][:, None] + np.arange(dim)].reshape(len(mine), dim).astype("<i8")


def fit_blocks(rows: DataFrame) -> DataFrame:
    """dim, n, top (largest absolute entry), sums and cells: the distinct vectors in blocks."""
    schema = pa.schema(
        [("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("cells", pa.binary())]
    )

    def block(cells: np.ndarray) -> pa.RecordBatch:
        safe = np.abs(cells.astype(np.float64)).max() * len(cells) < 2.0**62
        sums = cells.sum(axis=0) if safe else cells.astype(object).sum(axis=0)
        values = [[cells.shape[1]], [len(cells)], [[Decimal(int(s)) for s in sums]], [cells.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, cells in matrices(batch.column("x")):
                dim = cells.shape[1]
                cells = np.concatenate([held.pop(dim), cells]) if dim in held else cells
                for part in slices(len(cells), BLOCK_ROWS):
                    if part.stop - part.start == BLOCK_ROWS:
                        yield block(cells[part])
                    else:
                        held[dim] = cells[part]
        for cells in held.values():
            yield block(cells)

    distinct = rows.select("x").distinct()
    return distinct.mapInArrow(run, "dim int, n bigint, sums array<decimal(38,0)>, cells binary")


class Passes:
    """Sums over the fit list of a function of its centred rows: one Spark job each."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray):
        self.blocks, self.mean, self.count = blocks.select("cells"), mean, 0
        self.parts = blocks.rdd.getNumPartitions()

    def total(self, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        mean, dim = self.mean, len(self.mean)
        self.count += 1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape, dtype=np.longdouble)
            for batch in batches:
                for cells in batch.column("cells"):
                    rows = np.frombuffer(cells.as_buffer(), "<i8").reshape(-1, dim)
                    held += work(rows.astype(np.float64) - mean)
            yield sums(held)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape, dtype=np.longdouble)
            for batch in batches:
                for x in batch.column("x").to_pylist():
                    held += np.frombuffer(x, np.longdouble).reshape(shape)
            yield sums(held)

        def sums(held: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["x"])

        found, parts = self.blocks.mapInArrow(partial, "x binary"), self.parts
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            found = found.repartition(parts).mapInArrow(add, "x binary")
        held = np.zeros(shape, dtype=np.longdouble)
        for row in found.collect():  # at most FAN_IN arrays
            held += np.frombuffer(row["x"], np.longdouble).reshape(shape)
        return held.astype(np.float64)

    def product(self, y: np.ndarray, n: int) -> np.ndarray:
        """V y."""
        return self.total(lambda c: c.T @ (c @ y), y.shape) / n


def minres(rhs: np.ndarray, theta: float, project: Callable[[np.ndarray], np.ndarray], steps: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Solves the projected correction equation roughly: yields vectors, is sent their products with V."""
    beta = size = float(np.linalg.norm(rhs))
    x = np.zeros_like(rhs)
    if size == 0.0:
        return x
    before, v = np.zeros_like(rhs), rhs / beta
    w0 = w1 = np.zeros_like(rhs)
    cos0 = cos1 = 1.0
    sin0 = sin1 = 0.0
    left = beta
    for _ in range(steps):
        p = project((yield v) - theta * v)
        delta = float(v @ p)
        p = project(p - delta * v - beta * before)
        after = float(np.linalg.norm(p))
        a0 = cos1 * delta - cos0 * sin1 * beta
        a1 = float(np.hypot(a0, after))
        if a1 == 0.0:
            break
        w2 = (v - sin0 * beta * w0 - (sin1 * delta + cos0 * cos1 * beta) * w1) / a1
        cos0, sin0, cos1, sin1 = cos1, sin1, a0 / a1, after / a1
        x = x + cos1 * left * w2
        left = -sin1 * left
        if after <= 1e-14 * abs(theta) or abs(left) < 1e-3 * size:
            break
        before, v, beta, w0, w1 = v, p / after, after, w1, w2
    return x


def lockstep(solvers: list[Generator], product: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Runs the solvers side by side: one block product for a step of all of them."""
    answers: list[np.ndarray | None] = [None] * len(solvers)
    asked: dict[int, np.ndarray] = {}

    def resume(i: int, value: np.ndarray | None) -> None:
        try:
            asked[i] = solvers[i].send(value)
        except StopIteration as done:
            asked.pop(i, None)
            answers[i] = done.value

    for i in range(len(solvers)):
        resume(i, None)
    while asked:
        now = sorted(asked)
        made = product(np.column_stack([asked[i] for i in now]))
        for k, i in enumerate(now):
            resume(i, made[:, k])
    return answers


def orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Unit columns that span what `new` adds to the bases; columns that add nothing go."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0.0:
            continue
        v = column / size
        for _ in range(3):  # twice is enough in theory
            for base in bases:
                v = v - base @ (base.T @ v)
            for k in kept:
                v = v - k * (k @ v)
            rest = np.linalg.norm(v)
            if rest < 1e-8:
                break
            v = v / rest
        else:
            kept.append(v)
    return np.column_stack(kept) if kept else np.empty((new.shape[0], 0))


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, values and residuals of the `wanted` largest eigenpairs of a symmetric operator."""
    random = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    locked = np.empty((dim, 0))
    basis = orthogonal(random.normal(size=(dim, min(dim, 2 * wanted))))
    products = product(basis)
    top = 0.0
    for turn in range(ROUNDS):
        h = basis.T @ products
        theta, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta)
        theta, basis, products = theta[order], basis @ s[:, order], products @ s[:, order]
        top = max(top, float(np.abs(theta).max(initial=0.0)))
        rest = products - basis * theta
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        whole = locked.shape[1] + basis.shape[1] >= dim  # nothing is left to add
        done = 0
        while done < len(theta) and locked.shape[1] + done < wanted and (whole or norms[done] <= TOLERANCE * top or turn == ROUNDS - 1):
            done += 1
        if done:
            locked = np.column_stack([locked, orthogonal(basis[:, :done], locked)])
            theta, basis, products, rest = theta[done:], basis[:, done:], products[:, done:], rest[:, done:]
        if locked.shape[1] >= wanted:
            break
        now = min(wanted - locked.shape[1], len(theta))
        out = np.column_stack([locked, basis[:, :now]])

        def project(v: np.ndarray, out: np.ndarray = out) -> np.ndarray:
            return v - out @ (out.T @ v)

        solvers = [minres(project(-rest[:, i]), float(theta[i]), project, INNER) for i in range(now)]
        corrections = lockstep(solvers, product)
        if basis.shape[1] + now > BASIS:
            basis, products = basis[:, : 3 * wanted], products[:, : 3 * wanted]
        new = orthogonal(np.column_stack([*corrections, random.normal(size=dim)])[:, : max(now, 1)], locked, basis)
        if new.shape[1] == 0:  # the corrections add nothing: go on with a random direction
            new = orthogonal(random.normal(size=(dim, 1)), locked, basis)
        basis, products = np.column_stack([basis, new]), np.column_stack([products, product(new)])
    # Among the locked vectors once more, so that order and values are those of fresh products.
    made = product(locked)
    h = locked.T @ made
    theta, s = np.linalg.eigh((h + h.T) / 2)
    theta, s = theta[::-1], s[:, ::-1]
    vectors, made = locked @ s, made @ s
    return vectors, theta, np.linalg.norm(made - vectors * theta, axis=0) / max(top, np.finfo(float).tiny)


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> list[Fit]:
    """The fit of every vector length."""
    blocks = stored(fit_blocks(integer_rows(vectors, scale)), "fit-list")
    each = blocks.select("dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums: dict[int, list] = {}
    for row in sorted(each.collect(), key=lambda r: (r["dim"], r["at"])):  # one row per dimension
        sums.setdefault(row["dim"], []).append(row)
    return [fit_one(blocks.filter(F.col("dim") == dim), rows[0]["n"], [int(r["s"]) for r in rows], components) for dim, rows in sums.items()]


def fit_one(blocks: DataFrame, n: int, sums: list[int], components: int) -> Fit:
    dim = len(sums)
    blocks = blocks.persist()  # read many times; lost parts are read again from the stored table
    try:
        passes = Passes(blocks, means(sums, n))
        trace = float(passes.total(lambda c: np.array([(c * c).sum()]), (1,))[0]) / n
        none = Fit(dim, n, sums, np.empty((dim, 0)), np.empty(0), np.empty(0), trace, 0.0, passes.count)
        if not trace > 0.0:
            return none
        found = jacobi_davidson(lambda y: passes.product(y, n), dim, components)
        vectors, values, residuals = (x[..., found[1] > NOTHING * dim * trace] for x in found)
        if not len(values):
            return none
        axes = vectors / np.sqrt(values)
        k = len(values)

        def moments(c: np.ndarray) -> np.ndarray:
            y = c @ axes
            return np.vstack([y.T @ y, y.sum(axis=0)])

        made = passes.total(moments, (k + 1, k)) / n
        error = float(np.abs(made[:k] - np.outer(made[k], made[k]) - np.eye(k)).max())
        return Fit(dim, n, sums, vectors, values, residuals, trace, error, passes.count)
    finally:
        blocks.unpersist()


def deviations(cells: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n*x - S)^2, exact; held at the end of a long."""
    most = max(n * int(np.abs(cells.astype(np.float64)).max(initial=0.0) + 1) + max(map(abs, sums), default=0), 1)
    if len(sums) * most * most < 2**62:
        apart = n * cells - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(axis=1)
    apart = n * cells.astype(object) - np.array(sums, dtype=object)
    return np.array([min(int(x), LONG.max) for x in (apart * apart).sum(axis=1)], dtype=np.int64)


def whiten(vectors: DataFrame, fits: list[Fit], scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every vector that takes part."""
    by_dim = {f.dim: f for f in fits if len(f.values)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, cells in matrices(batch.column("x")):
                if (f := by_dim.get(cells.shape[1])) is None:
                    continue
                k, rows = len(f.values), len(places)
                whitened = (cells.astype(np.float64) - f.mean) @ (f.vectors / np.sqrt(f.values))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(places, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, f.n, dtype=np.int64)),
                        pa.array(np.repeat(deviations(cells, f.n, f.sums), k)),
                        pa.array(whitened.reshape(-1)),
                        pa.array(np.tile(f.values / f.trace, rows)),
                        pa.array(np.full(rows * k, f.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = integer_rows(vectors, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    return whiten(vectors, fit(vectors, components, scale), scale)
