"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of the vectors; then every vector is filed under its leaf.
A query walks the tree with a priority queue of nodes by the distance of their centres: it goes
down to the nearest leaf, and from there always on at the nearest node not yet entered. How many
leaves are visited is calibrated: for sample vectors the true neighbours among all rows are
found, and visits are widened until the leaves visited hold the wanted share of them. Leaves and
their queries meet in blocks of bounded size. Copies collapse first: of equal vectors only the
lowest ids can be answers, and equal queries are answered once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.llm.tables import discard, saved, uniform
from periodlens.session import lookup_join

K = 10
RECALL = 0.94
#: The sample that the tree is fitted on holds about this many entries (rows times length).
FIT_ENTRIES = 1 << 21
LEAF = 128
BRANCH = 16
#: Vectors whose true neighbours are searched for calibration.
CALIBRATORS = 400
LEAST_CALIBRATORS = 50
BLOCK = 2048
#: Leaves searched first; what they hold bounds what the others may report.
FIRST = 16


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows paired one to one, also where squares would leave the range."""
    step = x - y
    most = np.abs(step).max(axis=1, initial=0.0)
    odd = (most > 1e150) | ((most < 1e-150) & (most > 0))
    size = np.where(odd, most, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return np.sqrt(((step / size) ** 2).sum(axis=1)) * size[:, 0]


def _near(
    x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, most: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows of each query, ties by id.

    Products choose candidates with room for their rounding; differences decide. Rows farther
    than a query's ``most`` are left out.
    """
    scale = max(np.abs(x).max(), np.abs(queries).max()) or 1.0
    a, b = queries / scale, x / scale
    sq = (b * b).sum(axis=1)
    rough = sq[None, :] - 2 * (a @ b.T)
    room = 64 * x.shape[1] * np.finfo(float).eps * (sq.max() + (a * a).sum(axis=1).max())
    take = min(k, len(x))
    limit = np.partition(rough, take - 1, axis=1)[:, take - 1] + 2 * room
    if most is not None:
        limit = np.minimum(limit, (most / scale) ** 2 * (1 + 1e-9) - (a * a).sum(axis=1) + 2 * room)
    i, j = np.nonzero(rough <= limit[:, None])
    if not len(i):
        return i, j, np.zeros(0)
    d = np.concatenate([distances(queries[i[s : s + 8192]], x[j[s : s + 8192]]) for s in range(0, len(i), 8192)])
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    if most is not None:
        keep &= d <= most[i]
    return i[keep], j[keep], d[keep]


@dataclass
class Tree:
    """Centres of all nodes, the children of inner ones, the leaf number of the others."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    scale: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x / self.scale, -1e100, 1e100)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        x, at = self._scaled(x), np.zeros(len(x), np.int64)
        open_ = np.arange(len(x)) if len(self.children[0]) else np.zeros(0, np.int64)
        while len(open_):
            for node in np.unique(at[open_]):
                mine = open_[at[open_] == node]
                at[mine] = self.children[node][_closest(x[mine], self.centres[self.children[node]])]
            open_ = open_[self.leaf[at[open_]] < 0]
        return self.leaf[at]

    def bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        query = self._scaled(query)
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            while self.leaf[node] < 0:
                below = self.children[node]
                d = ((self.centres[below] - query) ** 2).sum(axis=1)
                best = int(d.argmin())
                for c, n in enumerate(below.tolist()):
                    if c != best:
                        heapq.heappush(queue, (float(d[c]), n))
                node = int(below[best])
            yield int(self.leaf[node])


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def grow(x: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, rounds: int = 8, seed: int = 3) -> Tree:
    """A tree of k-means within k-means until a node holds at most ``leaf`` vectors."""
    scale = float(np.abs(x).max(initial=0.0)) or 1.0
    x, rng = x / scale, np.random.default_rng(seed)
    centres, children, numbers = [x.mean(axis=0)], [np.zeros(0, np.int64)], [-1]
    open_, made = [(0, np.arange(len(x)))], 0
    while open_:
        node, rows = open_.pop()
        parts = []
        if len(rows) > leaf:
            own = x[rows]
            means = own[rng.choice(len(rows), min(branch, -(-len(rows) // leaf) + 1), replace=False)]
            for _ in range(rounds):
                side = _closest(own, means)
                used = np.unique(side)
                means = np.stack([own[side == u].mean(axis=0) for u in used])
            side = _closest(own, means)
            parts = [(means[u], rows[side == u]) for u in np.unique(side)]
        if len(parts) < 2:
            numbers[node], made = made, made + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        for mean, mine in parts:
            open_.append((len(centres), mine))
            centres.append(mean)
            children.append(np.zeros(0, np.int64))
            numbers.append(-1)
    return Tree(np.array(centres), children, np.array(numbers), scale)


def usable(v: Column) -> Column:
    """Vectors that are not null, hold finite entries only and have one other than zero."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0)


@dataclass
class Index:
    """``rows`` (dims, leaf, id, v), a tree and the leaves to visit by vector length, and the recall met.

    A length without a tree is one leaf. ``filled`` holds the rows of each leaf of a tree.
    """

    rows: DataFrame
    trees: dict[int, Tree]
    filled: dict[int, np.ndarray]
    visits: dict[int, int]
    recall: dict[int, float]
    k: int


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.diff(np.asarray(batch.column("v").offsets))
    for d in np.unique(dims).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dims == d)))


def _file(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    kind = rows.schema["v"].dataType.simpleString()

    def file(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                leaf = trees[d].place(_matrix(part.column("v"), d)) if d in trees else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, d, np.int32)), pa.array(leaf.astype(np.int32)), part.column("id"), part.column("v")],
                    names=["dims", "leaf", "id", "v"],
                )

    return rows.mapInArrow(file, f"dims int, leaf int, id long, v {kind}")


def _truth(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(dims, query, leaf, rank) of the true neighbours of the calibration vectors ``asked`` by length."""

    def scan(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, part in _by_length(batch):
                if d not in asked:
                    continue
                ids, leaf = part.column("id").to_numpy(), part.column("leaf").to_numpy()
                q_ids, q = asked[d]
                # A vector's own row may be among the nearest, so one more is kept.
                i, j, dist = _near(_matrix(part.column("v"), d), ids, q, k + 1)
                new = [i, ids[j], leaf[j], dist]
                i, ids, leaf, dist = (np.concatenate(c) for c in zip(held[d], new)) if d in held else new
                order = np.lexsort((ids, dist, i))
                order = order[(np.arange(len(order)) - np.searchsorted(i[order], i[order])) < k + 1]
                held[d] = [c[order] for c in (i, ids, leaf, dist)]
        for d, (i, ids, leaf, dist) in held.items():
            own = asked[d][0][i] == ids
            columns = [np.full(len(i), d, np.int32), i.astype(np.int32), ids, leaf.astype(np.int32), dist]
            yield pa.RecordBatch.from_arrays([pa.array(c[~own]) for c in columns], names=["dims", "query", "id", "leaf", "dist"])

    found = rows.select("dims", "leaf", "id", "v").mapInArrow(scan, "dims int, query int, id long, leaf int, dist double")
    best = Window.partitionBy("dims", "query").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def build(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL,
    fit_entries: int = FIT_ENTRIES, leaf: int = LEAF, calibrators: int = CALIBRATORS,
) -> Index:
    """The index of all usable rows, with a tree and calibrated visits for each length sampled.

    Only the fit and the calibration use samples: about ``fit_entries`` entries, and ``calibrators``
    vectors drawn by a hash of their ids. A length with fewer than ``LEAST_CALIBRATORS`` of those
    has all its leaves visited.
    """
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    copies = Window.partitionBy("v").orderBy("id")
    distinct = plain.where(usable(F.col("v"))).distinct()
    lean = saved(distinct.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "near-rows")
    n, entries = lean.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    share = fit_entries / max(1, entries)
    sample = lean.where(uniform(F.lit(1), F.col("id")) < share).select("id", "v").toArrow()
    trees: dict[int, Tree] = {}
    for batch in sample.combine_chunks().to_batches():
        for d, part in _by_length(batch):
            trees[d] = grow(np.unique(_matrix(part.column("v"), d), axis=0), leaf)
    filed = saved(_file(lean, trees), "near-filed")
    discard(lean)
    filled = {d: np.zeros(t.leaves, np.int64) for d, t in trees.items()}
    for d, at, c in filed.where(F.col("dims").isin(*trees)).groupBy("dims", "leaf").count().collect() if trees else []:
        filled[d][at] = c
    drawn = filed.where(uniform(F.lit(2), F.col("id")) < calibrators / max(1, n)).select("id", "v").toArrow()
    asked = {}
    for batch in drawn.combine_chunks().to_batches():
        for d, part in _by_length(batch):
            if d in trees and part.num_rows >= LEAST_CALIBRATORS:
                asked[d] = (part.column("id").to_numpy(), _matrix(part.column("v"), d))
    visits, met = {d: t.leaves for d, t in trees.items()}, {}
    where: dict[int, list[tuple[int, int]]] = {}
    for d, q, at in _truth(filed, asked, k).select("dims", "query", "leaf").collect() if asked else []:
        where.setdefault(d, []).append((q, at))
    for d, hits in where.items():
        order = [{at: i for i, at in enumerate(trees[d].bins(q))} for q in asked[d][1]]
        needed = np.sort([order[q][at] + 1 for q, at in hits])
        visits[d] = int(needed[min(len(needed), math.ceil(recall * len(needed))) - 1])
        met[d] = float((needed <= visits[d]).mean())
    return Index(filed, trees, filled, visits, met, k)


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the nearest rows found for each query, its own id left out.

    Rows that are null, zero, without an id or hold null or non-finite entries take no part; rows
    of another length are no neighbours. Rows repeated with id and vector count once; an id on
    several vectors is a candidate, and a query, with each of them. Ties go
    to the smaller id. Where the leaves visited hold too few rows, more are visited. An empty
    table, or no query, gives an empty result.
    """
    k, kind = index.k, index.rows.schema["v"].dataType.simpleString()
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("v"))
    asked = saved(asked.where("query_id is not null").where(usable(F.col("v"))).distinct(), "near-asked")
    # Numbered when written, so that the numbers stay.
    reps = saved(asked.select("v").distinct().withColumn("rep", F.monotonically_increasing_id()), "near-reps")
    trees, filled, visits = index.trees, index.filled, index.visits

    def route(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                which, leaves, early = [], [], []
                for i, q in enumerate(_matrix(part.column("v"), d)):
                    seen = used = 0
                    for at, b in enumerate(trees[d].bins(q) if d in trees else [0]):
                        if d in trees and at >= visits[d] and seen > k:
                            break
                        if d not in trees or filled[d][b]:
                            which.append(i)
                            leaves.append(b)
                            early.append(used < FIRST or seen <= k)
                            used += 1
                            seen += filled[d][b] if d in trees else 0
                for s in range(0, len(which), 4096):
                    out = part.take(pa.array(np.asarray(which[s : s + 4096], np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(out.num_rows, d, np.int32)), pa.array(np.asarray(leaves[s : s + 4096], np.int32)),
                            pa.array(early[s : s + 4096], pa.bool_()), out.column("rep"), out.column("v"),
                        ],
                        names=["dims", "leaf", "early", "rep", "v"],
                    )

    routed = reps.select("rep", "v").mapInArrow(route, f"dims int, leaf int, early boolean, rep long, v {kind}")
    routed = saved(routed, "near-routed")

    def compared(asking: DataFrame) -> DataFrame:
        """(rep, id, score) of the rows found for (dims, leaf, rep, v, most), per block of a leaf."""
        parts = lambda df, name: df.groupBy("dims", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        blocks = saved(parts(index.rows, "row_parts").join(parts(asking, "query_parts"), ["dims", "leaf"]), "near-blocks")

        def cut(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str, *more: str) -> DataFrame:
            return lookup_join(df, blocks, ["dims", "leaf"]).select(
                "dims", "leaf", F.col(key).alias("key"), "v", *more,
                F.pmod(F.xxhash64(F.lit(3), key), F.col(own)).cast("int").alias(mine),
                F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs),
            )

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(("rep", "id", "score"), (pa.int64(), pa.int64(), pa.float64()))})
            dims, ids, reps = left.column("dims")[0].as_py(), left.column("key").to_numpy(), right.column("key").to_numpy()
            most = right.column("most").to_numpy()
            i, j, d = _near(_matrix(left.column("v"), dims), ids, _matrix(right.column("v"), dims), k + 1, most)
            return pa.table({"rep": pa.array(reps[i]), "id": pa.array(ids[j]), "score": pa.array(d)})

        group = ["dims", "leaf", "rb", "qb"]
        return (
            cut(index.rows, "id", "row_parts", "query_parts", "rb", "qb").groupBy(*group)
            .cogroup(cut(asking, "rep", "query_parts", "row_parts", "qb", "rb", "most").groupBy(*group))
            .applyInArrow(compare, "rep long, id long, score double")
        )

    def nearest(df: DataFrame, most: int, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy("score", "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    anything = F.lit(float("inf"))
    early = saved(nearest(compared(routed.where("early").withColumn("most", anything)), k + 1, "rep"), "near-early")
    bound = early.where(F.col("rank") == k + 1).select("rep", F.col("score").alias("most"))
    bounded = routed.where("not early").join(bound, "rep", "left").fillna(float("inf"), ["most"])
    late = compared(saved(bounded.select("dims", "leaf", "rep", "v", "most"), "near-late"))
    found = early.select("rep", "id", "score").unionByName(late)
    answers = saved(nearest(found, k + 1, "rep").drop("rank"), "near-answers")
    discard(routed)
    given = asked.join(reps, "v").select("query_id", "rep").join(answers, "rep")
    # Different vectors are never at distance 0, so this is the query's own row.
    others = given.where((F.col("id") != F.col("query_id")) | (F.col("score") > 0))
    return nearest(others, k, "query_id", "rep").select("query_id", "rank", F.col("id").alias(id_col), "score")
