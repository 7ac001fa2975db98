"""Whitening of vectors: leading components of their covariance by spectrum slicing.

Vectors are cut to whole numbers; each distinct one counts once in the fit. Sums and covariance
are partial results of tasks, added by aggregations. The covariance of a vector length is solved
in one task, on a matrix of that length squared whatever the number of rows: counts of
eigenvalues above a shift, read from the signs of an LDL' factorisation, enclose each leading
eigenvalue alone, Rayleigh quotient iteration finds it there, and two more counts prove its
number. Rows travel in blocks of one length, each of which meets its model once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.tables import saved
from periodlens.session import lookup_join

COMPONENTS = 4
STEPS = 256
#: Entries of a block, and of the partial covariances that a task holds.
BLOCK = 1 << 16
HELD = 1 << 23
EPS = float(np.finfo(float).eps)
ALPHA = (1 + math.sqrt(17)) / 8


def above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of LDL' of ``a - shift``."""
    a = a - shift * np.eye(len(a))
    n, k, positive = len(a), 0, 0
    while k < n:
        size, r = 1, k
        rest = np.abs(a[k + 1 :, k])
        if len(rest):
            r = k + 1 + int(rest.argmax())
            most, own = rest[r - k - 1], abs(a[k, k])
            if own < ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if own * row.max() >= ALPHA * most * most:
                    r = k
                elif abs(a[r, r]) < ALPHA * row.max():
                    size = 2
            else:
                r = k
        at = k + size - 1
        if r != at:
            a[[at, r]] = a[[r, at]]
            a[:, [at, r]] = a[:, [r, at]]
        if size == 2:
            # Such a block always has one eigenvalue of each sign.
            positive += 1
            side = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(a[k : k + 2, k : k + 2], side.T)
        elif a[k, k]:
            positive += a[k, k] > 0
            side = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(side, side / a[k, k])
        k += size
    return positive


def _solve(a: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    m = a - shift * np.eye(len(a))
    try:
        y = np.linalg.solve(m, x)
    except np.linalg.LinAlgError:
        y = np.linalg.solve(m + EPS * scale * np.eye(len(a)), x)
    return y if np.isfinite(y).all() else x


def _refine(a: np.ndarray, lo: float, hi: float, found: np.ndarray, scale: float, start: int) -> tuple[float, np.ndarray, float]:
    """(value, vector, residual) by Rayleigh quotient iteration from the middle of (lo, hi)."""

    def unit(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            y = y - found.T @ (found @ y)
        return y / np.linalg.norm(y)

    x = unit(np.random.default_rng(start).standard_normal(len(a)))
    for _ in range(3):
        x = unit(_solve(a, (lo + hi) / 2, x, scale))
    best = (0.0, x, math.inf)
    for _ in range(12):
        value = float(x @ a @ x)
        residual = float(np.linalg.norm(a @ x - value * x))
        if residual >= best[2]:
            break
        best = (value, x, residual)
        x = unit(_solve(a, value, x, scale))
    return best


def leading(a: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of the ``count`` largest eigenvalues, by falling value.

    Every value is enclosed by counts that give its number. Values that no count tells apart get
    orthogonal vectors of their common space.
    """
    count = min(count, len(a))
    scale = float(np.abs(a).sum(axis=1).max()) if len(a) else 0.0
    values, vectors = np.zeros(count), np.zeros((0, len(a)))
    if not scale:
        return values, np.eye(len(a))[:count]
    counts = {-scale: len(a), scale * (1 + 4 * EPS): 0}

    def counted(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(a, shift)
        return counts[shift]

    tight = 8 * EPS * scale
    for k in range(1, count + 1):
        lo = max(s for s, c in counts.items() if c >= k)
        hi = min(s for s, c in counts.items() if c < k and s > lo)
        while True:
            alone = counted(lo) == k and counted(hi) == k - 1
            if alone or hi - lo <= tight:
                value, x, residual = _refine(a, lo, hi, vectors, scale, k)
                close = max(residual, tight)
                if hi - lo <= tight or (
                    lo < value < hi and residual <= 64 * tight and counted(value - close) >= k and counted(value + close) < k
                ):
                    break
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if counted(middle) >= k else (lo, middle)
        values[k - 1] = value
        vectors = np.vstack([vectors, x])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


def quantise(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) of the usable vectors, cut to ``STEPS`` a unit.

    Vectors that are null or hold a null or non-finite entry, or one whose whole number takes
    more than 62 bits, are left out.
    """
    scaled = lambda c: c.cast("double") * STEPS
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < float(2**62)))
    return rows.where(F.col(vector).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda c: F.floor(scaled(c))).alias("x")
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """(dims, ids, flat): vectors of one length, at most ``BLOCK`` entries or one vector a block."""

    def cut(batches):
        for batch in batches:
            x = batch.column("x")
            dims = np.diff(np.asarray(x.offsets))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                step = max(1, BLOCK // max(1, int(d)))
                for at in range(0, len(mine), step):
                    part = batch.take(pa.array(mine[at : at + step]))
                    one = lambda v: pa.ListArray.from_arrays([0, len(v)], v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), one(part.column("id")), one(part.column("x").flatten())],
                        names=["dims", "ids", "flat"],
                    )

    return rows.mapInArrow(cut, "dims int, ids array<long>, flat array<long>")


def _per_block(batches) -> Iterator[dict]:
    for batch in batches:
        flat, dims = batch.column("flat"), batch.column("dims").to_pylist()
        for i, d in enumerate(dims):
            out = {n: batch.column(n)[i] for n in batch.schema.names}
            x = flat[i].values.to_numpy(zero_copy_only=False)
            yield {**out, "x": x.reshape(-1, d) if d else np.zeros((len(out["ids"]), 0), np.int64)}


def _exact_sum(x: np.ndarray) -> list[int]:
    if len(x) * float(np.abs(x).max(initial=0)) < 2**62:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def _sums(blocks: DataFrame) -> DataFrame:
    """(dims, n, q, r): the number of vectors, and their sums ``q * n + r`` with ``0 <= r < n``."""

    def add(batches):
        for b in _per_block(batches):
            total = [str(s) for s in _exact_sum(b["x"])]
            yield pa.RecordBatch.from_pylist([{"dims": b["dims"].as_py(), "n": len(b["x"]), "s": total}], schema)

    schema = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.string()))])
    parts = blocks.mapInArrow(add, "dims int, n long, s array<string>")
    each = parts.select("dims", "n", F.posexplode("s").alias("i", "s"))
    by_dim = each.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # A whole quotient towards minus infinity, exactly, in decimals.
    low = F.pmod("s", F.col("n").cast("decimal(38,0)"))
    q = ((F.col("s") - low) / F.col("n").cast("decimal(20,0)")).cast("decimal(38,0)").cast("long")
    return (
        by_dim.select("dims", "n", F.struct("i", q.alias("q"), low.cast("long").alias("r")).alias("c"))
        .groupBy("dims").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("c")).alias("c"))
        .select("dims", "n", F.col("c.q").alias("q"), F.col("c.r").alias("r"))
    )


def _centred(b: dict) -> np.ndarray:
    q, r = (b[c].values.to_numpy() for c in ("q", "r"))
    return (b["x"] - q).astype(float) - r / b["n"].as_py()


def _covariance(blocks: DataFrame) -> DataFrame:
    """(dims, i, j, v): sums of products of centred entries, from ``i`` on."""
    schema = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("v", pa.list_(pa.float64()))])

    def given(held: dict[int, np.ndarray]):
        for d, m in held.items():
            yield pa.RecordBatch.from_pylist([{"dims": d, "i": i, "v": m[i, i:]} for i in range(d)], schema)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in _per_block(batches):
            c, d = _centred(b), b["dims"].as_py()
            held[d] = held[d] + c.T @ c if d in held else c.T @ c
            if sum(m.size for m in held.values()) > HELD:
                yield from given(held)
                held = {}
        yield from given(held)

    rows = blocks.mapInArrow(add, "dims int, i int, v array<double>")
    cells = rows.select("dims", "i", F.posexplode("v").alias("k", "v"))
    return cells.groupBy("dims", "i", (F.col("i") + F.col("k")).alias("j")).agg(F.sum("v").alias("v"))


def fit(quantised: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """(model, blocks of the fit list). The model has one row per vector length:

    (dims, n, q, r, values, vectors, trace); vectors are rows of ``vectors``, one after the other.
    """
    distinct = quantised.select("x").where(F.size("x") > 0).distinct().select(F.lit(None).cast("long").alias("id"), "x")
    blocks = saved(_blocks(distinct), "white-fit")
    sums = saved(_sums(blocks), "white-sums")
    cells = _covariance(lookup_join(blocks, sums, ["dims"])).join(sums.select("dims", "n"), "dims")
    schema = pa.schema([("dims", pa.int32()), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64())), ("trace", pa.float64())])

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        a = np.zeros((d, d))
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        a[i, j] = a[j, i] = table.column("v").to_numpy() / table.column("n")[0].as_py()
        values, vectors = leading(a, components)
        return pa.Table.from_pylist([{"dims": d, "values": values, "vectors": vectors.ravel(), "trace": float(np.trace(a))}], schema)

    solved = cells.groupBy("dims").applyInArrow(solve, "dims int, values array<double>, vectors array<double>, trace double")
    return saved(sums.join(solved, "dims"), "white-model"), blocks


def _project(b: dict) -> np.ndarray:
    """Whitened values; NaN for components without variance."""
    values = b["values"].values.to_numpy()
    vectors = b["vectors"].values.to_numpy().reshape(len(values), -1)
    size = np.where(values > 64 * EPS * len(vectors.T) * max(values.max(), 0), values, np.nan)
    return _centred(b) @ vectors.T / np.sqrt(size)


def _deviation(b: dict) -> list[int | None]:
    n, q, r = b["n"].as_py(), b["q"].values.to_numpy(), b["r"].values.to_numpy()
    step = b["x"] - q
    if float(((np.abs(step).astype(float) + 1) ** 2).sum(axis=1).max()) * n * n < 2**62:
        return ((step * n - r) ** 2).sum(axis=1).tolist()
    exact = ((step.astype(object) * n - r.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]


def _mapped(blocks: DataFrame, model: DataFrame, schema: str, make: Callable[[dict], pa.RecordBatch]) -> DataFrame:
    def work(batches):
        for b in _per_block(batches):
            yield make(b)

    return lookup_join(blocks, model, ["dims"]).mapInArrow(work, schema)


def identity_error(blocks: DataFrame, model: DataFrame, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""

    def make(b: dict) -> pa.RecordBatch:
        w = _project(b)
        full = np.full((len(w), components), np.nan)
        full[:, : w.shape[1]] = w
        columns = [pa.array(c, from_pandas=True) for c in full.T]
        return pa.RecordBatch.from_arrays([pa.array([b["dims"].as_py()] * len(w), pa.int32()), *columns], names=["dims", *names])

    names = [f"w{k}" for k in range(components)]
    spread = _mapped(blocks, model, "dims int, " + ", ".join(f"{n} double" for n in names), make)
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    off = [F.abs(F.covar_pop(names[i], names[j]) - float(i == j)).alias(f"e{i}{j}") for i, j in pairs]
    per = spread.groupBy("dims").agg(*off)
    worst = per.agg(*[F.max(f"e{i}{j}") for i, j in pairs]).first()
    return max((v for v in worst if v is not None), default=0.0)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component.

    Left out are the vectors that ``quantise`` leaves out, and those of no length. Vectors of each
    length have a fit, and components, of their own; ``identity_error`` is the largest of all. A
    row counts whatever its id, null included, and repeated rows each give theirs. Components
    without variance (of equal vectors, say) have null ``whitened``, and ``explained`` is null where
    nothing varies. ``deviation`` is null where it does not fit a long.
    """
    quantised = quantise(rows, id_col, vector)
    model, fitted = fit(quantised, components)
    error = identity_error(fitted, model, components)

    def make(b: dict) -> pa.RecordBatch:
        w, k = _project(b), len(b["values"])
        m, trace, n = len(w), b["trace"].as_py(), b["n"].as_py()
        share = b["values"].values.to_numpy() / trace if trace > 0 else np.full(k, np.nan)
        ids, deviation = b["ids"].values, pa.array(_deviation(b), pa.int64())
        every = pa.array(np.repeat(np.arange(m), k))
        return pa.RecordBatch.from_arrays(
            [
                ids.take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                deviation.take(every), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, m), from_pandas=True),
            ],
            names=["id", "component", "n", "deviation", "whitened", "explained"],
        )

    schema = "id long, component int, n long, deviation long, whitened double, explained double"
    done = _mapped(_blocks(quantised.where(F.size("x") > 0)), model, schema, make)
    return done.withColumnRenamed("id", id_col).withColumn("identity_error", F.lit(error))
