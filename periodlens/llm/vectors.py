"""Near duplicates among vectors: random-hyperplane signs, exact cosines, components.

Equal vectors are one row with a count. Each of ``tables`` tables files every vector under the
signs of its products with ``bits`` random directions; vectors of a file are compared exactly.
``bits`` follows the number of vectors, so that a file holds about ``PER_FILE`` of them, and the
number of tables follows from ``bits``, so that a pair at the threshold meets with probability
``recall``. A file of more than ``BLOCK`` vectors is cut into blocks, and each pair of blocks is a
task of its own: every pair is compared, and no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm.components import components
from periodlens.llm.tables import saved

THRESHOLD = 0.9
RECALL = 0.99
PER_FILE = 64
BLOCK = 1024
SEED = 11


def sign_plan(n: int, threshold: float, recall: float, per_file: int = PER_FILE) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = max(4, math.ceil(math.log2(max(1, n) / per_file)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def directions(dims: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, bits * tables))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest part first keeps squares of extreme values in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(unit: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """One code per vector and table."""
    signs = (unit @ planes > 0).reshape(len(unit), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _filed(reps: DataFrame, dims: int, bits: int, tables: int) -> DataFrame:
    """A row (t, code, id, n, v) for each vector and table."""
    schema = T.StructType(
        [T.StructField("t", T.IntegerType()), T.StructField("code", T.LongType()), reps.schema["id"], reps.schema["n"], reps.schema["v"]]
    )

    def file(batches):
        planes = directions(dims, bits, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                code = _codes(_unit(_matrix(part.column("v"))), planes, bits)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t, np.int32)), pa.array(code[:, t]), part.column("id"), part.column("n"), part.column("v")],
                        names=schema.names,
                    )

    return reps.select("id", "n", "v").mapInArrow(file, schema)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _compare(table: pa.Table, key, planes: np.ndarray, bits: int, threshold: float) -> pa.Table:
    """(id, links, root) of the vectors of one file, or of one pair of its blocks, that link here first."""
    t, one, two = key[0].as_py(), key[2].as_py(), key[3].as_py()
    table = table.sort_by("id")
    ids, n, part = (table.column(c).to_numpy() for c in ("id", "n", "part"))
    unit = _unit(_matrix(table.column("v")))
    code = _codes(unit, planes, bits)
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        near = unit[rows] @ unit[right].T >= threshold
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        if one == two:
            i, j = i[i < j], j[i < j]
        # A pair counts in the first table in which both have one code.
        first = np.argmax(code[i] == code[j], axis=1) == t
        i, j = i[first], j[first]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = _root(parent, a), _root(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    hit = np.flatnonzero(links)
    roots = np.array([ids[_root(parent, k)] for k in hit.tolist()], np.int64)
    return pa.table({"id": pa.array(ids[hit]), "links": pa.array(links[hit]), "root": pa.array(roots)})


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    recall: float = RECALL, per_file: int = PER_FILE, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; ids are integers.

    Vectors that are null, zero or of no length, hold null or non-finite parts, or have no id
    link with nothing, and vectors of different lengths are compared only within a length. Rows
    of one id and equal vectors count as one another's links. An empty table gives an empty result.
    """
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = plain.where("id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    reps = saved(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vec-reps")
    found = []
    for dims, n in [tuple(r) for r in reps.groupBy(F.size("v")).count().collect()]:
        bits, tables = sign_plan(n, threshold, recall, per_file)
        found.append(_links(reps.where(F.size("v") == dims), dims, bits, tables, threshold, block))
    if not found:
        return plain.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"),
        )
    links = found[0]
    for other in found[1:]:
        links = links.unionByName(other)
    links = saved(links, "vec-links")
    sums = links.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_rep = saved(
        reps.join(sums, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
        .select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")),
        "vec-classes",
    )
    mine = F.when(finite, F.col("v"))
    return (
        plain.select("id", F.when(F.col("id").isNotNull(), mine).alias("v"))
        .join(per_rep, "v", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            (F.col("id") == F.coalesce("component", "id")).alias("kept"),
        )
    )


def _links(reps: DataFrame, dims: int, bits: int, tables: int, threshold: float, block: int) -> DataFrame:
    filed = saved(_filed(reps, dims, bits, tables), "vec-files")
    sizes = filed.groupBy("t", "code").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / block)).drop("count")
    cut = (
        filed.join(saved(sizes, "vec-sizes"), ["t", "code"])
        .withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("t", "code", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "id", "n", "v")
    )

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _compare(table, key, directions(dims, bits, tables), bits, threshold)

    return cut.groupBy("t", "code", "one", "two").applyInArrow(compare, "id long, links long, root long")
