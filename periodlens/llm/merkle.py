"""Merkle manifest of a table, and octopus multiproofs of its rows.

Rows of a group, in the order of their ids, are the leaves of a tree of ``FAN`` children a node;
the group roots, in the order of the groups, are the leaves of a tree over them. Nodes of one tree
are built level by level from runs of at most ``FAN`` digests.

Proofs are made for runs of about ``RUN`` consecutive rows at a time, whatever their groups. A run
knows its own leaves, so of each tree it needs only the nodes beside its two ends. It lists these
coordinates, all runs fetch theirs in one join with the inner nodes, and in the task of a run the
inner nodes are derived once and every row's proof is expanded from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.llm.tables import saved
from periodlens.session import lookup_join

FAN = 16
RUN = 4096
TOP = -1
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as digest input: ``-`` for null, else its number of bytes, ``:``, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def at_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``at``, each row's place in the order, from 0; written once.

    Rows are dealt by ranges of the whole order, so equal leading values don't stay together.
    """
    rows = saved(df.sort(*order).withColumn("_mark", F.monotonically_increasing_id()), "merkle-sorted")
    rows = rows.select("*", F.shiftright("_mark", 33).alias("_part"))
    # One row per sorted part.
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_mark").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = lookup_join(rows, parts, ["_part"])
    return placed.withColumn("at", F.col("_mark") + F.col("_shift")).drop("_mark", "_part", "_shift")


def _levels(base: DataFrame, label: str) -> list[DataFrame]:
    """The levels of all trees of (tree, idx, m, digest) leaves; ``m`` is a tree's width there."""
    levels = [base]
    widest = base.agg(F.max("m")).first()[0] or 0
    while widest > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda s: s["digest"])
        up = (
            levels[-1].where("m > 1")
            .groupBy("tree", F.floor(F.col("idx") / FAN).alias("up"), F.ceil(F.col("m") / FAN).alias("wide"))
            .agg(F.sha2(F.array_join(run, ""), 256).alias("digest"))
            .select("tree", F.col("up").alias("idx"), F.col("wide").alias("m"), "digest")
        )
        levels.append(saved(up, label))
        widest = -(-widest // FAN)
    return levels


@dataclass
class Manifest:
    """``leaves`` (at, first, tree, idx, m, leaf, group, id, carried columns), ``groups`` and ``nodes``."""

    leaves: DataFrame
    groups: DataFrame
    nodes: DataFrame

    def root(self) -> str | None:
        """The root of the whole table; None without rows."""
        top = self.nodes.where((F.col("tree") == TOP) & (F.col("m") == 1)).first()
        return top["digest"] if top else None


def build(docs: DataFrame, id_col: str, group_col: str, leaf: Column, **carry: Column) -> Manifest:
    """The trees over ``docs``; ``carry`` names further values of a row to keep beside its leaf.

    Rows without an id come first in their group, the group of null first of all. Rows of one id
    are ordered by their digest. A group of one row has that row's digest as its root. Columns
    that are not used may have any name. An empty table has no nodes.
    """
    named = {"id": F.col(id_col), "grp": F.col(group_col), "leaf": leaf, **carry}
    hashed = saved(docs.select(*[c.alias(n) for n, c in named.items()]), "merkle-leaves")
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    placed = saved(at_order(hashed, *order), "merkle-places")
    counts = placed.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    groups = at_order(counts, F.col("first")).withColumnRenamed("at", "tree")
    groups = saved(groups, "merkle-groups")
    leaves = lookup_join(placed, groups, ["grp"], nulls=True).withColumn("idx", F.col("at") - F.col("first"))
    leaves = saved(leaves, "merkle-numbered")
    levels = _levels(leaves.select("tree", "idx", "m", F.col("leaf").alias("digest")), "merkle-level")
    # Every tree ends at the level where it is one node wide.
    roots = reduce(DataFrame.unionByName, [x.where("m = 1").select(F.col("tree").alias("idx"), "digest") for x in levels])
    n = groups.count()
    base = saved(roots.select(F.lit(TOP).cast("long").alias("tree"), "idx", F.lit(n).cast("long").alias("m"), "digest"), "merkle-roots")
    numbered = [*enumerate(_levels(base, "merkle-top")), *enumerate(levels[1:], 1)]
    parts = [level.select("tree", F.lit(k).alias("level"), "idx", "m", "digest") for k, level in numbered]
    return Manifest(leaves, groups, reduce(DataFrame.unionByName, parts))


def beside(a: int, b: int, m: int) -> Iterator[tuple[int, int]]:
    """(level, idx) of the nodes that leaves ``a`` to ``b`` of a tree of ``m`` need beside their own."""
    level = 0
    while m > 1:
        for i in range(a - a % FAN, a):
            yield level, i
        for i in range(b + 1, min(b - b % FAN + FAN, m)):
            yield level, i
        a, b, m, level = a // FAN, b // FAN, -(-m // FAN), level + 1


def _hash(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


class _Tree:
    """What a run of leaves ``a`` to ``b`` and the nodes beside it tell of a tree of ``m`` leaves."""

    def __init__(self, a: int, b: int, m: int, own: dict[tuple[int, int], bytes], fetched: dict[tuple[int, int], bytes]):
        known = {**own, **{at: fetched[at] for at in beside(a, b, m)}}
        self.widths, level = [], 0
        while m > 1:
            self.widths.append(m)
            for up in range(a // FAN, b // FAN + 1):
                known[level + 1, up] = _hash(b"".join(known[level, i] for i in range(up * FAN, min(up * FAN + FAN, m))))
            a, b, m, level = a // FAN, b // FAN, -(-m // FAN), level + 1
        self.known, self.root, self.height = known, known[level, 0], level

    def run(self, level: int, idx: int) -> list[bytes]:
        low = idx - idx % FAN
        return [self.known[level, i] for i in range(low, min(low + FAN, self.widths[level]))]

    def siblings(self, level: int, idx: int) -> list[bytes]:
        if level >= self.height:
            return []
        run = self.run(level, idx)
        del run[idx % FAN]
        return run

    def path(self, level: int, idx: int) -> list[bytes]:
        """Siblings from a node to the root, level by level."""
        out = []
        for k in range(level, self.height):
            out += self.siblings(k, idx)
            idx //= FAN
        return out

    def fold(self, digest: bytes, idx: int) -> bytes:
        """The root that ``digest`` in the place of leaf ``idx`` leads to."""
        for k in range(self.height):
            if digest == self.known[k, idx]:
                return self.root
            run = self.run(k, idx)
            run[idx % FAN] = digest
            digest, idx = _hash(b"".join(run)), idx // FAN
        return digest


def _expand(rows: pa.Table, nodes: pa.Table, siblings: bool) -> pa.Table:
    rows = rows.sort_by("at")
    tree, idx, wide, top_wide = (rows.column(c).to_numpy() for c in ("tree", "idx", "m", "trees"))
    leaf = [x.encode() for x in rows.column("leaf").to_pylist()]
    claimed = [x.encode() for x in rows.column("claimed").to_pylist()]
    got: dict[int, dict] = {}
    for t, k, i, d in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
        got.setdefault(t, {})[k, i] = d.encode()
    cuts = [0, *[i for i in range(1, len(tree)) if tree[i] != tree[i - 1]], len(tree)]
    trees, roots = [], {}
    for s, e in zip(cuts, cuts[1:]):
        a, t = int(idx[s]), int(tree[s])
        made = _Tree(a, int(idx[e - 1]), int(wide[s]), {(0, a + j): leaf[s + j] for j in range(e - s)}, got.get(t, {}))
        trees.append(made)
        roots[0, t] = made.root
    first, last = int(tree[0]), int(tree[-1])
    top = _Tree(first, last, int(top_wide[0]), roots, got.get(TOP, {}))
    out = {c: [] for c in ("subroot", "proof", "folded", "siblings")}
    for made, s, e in zip(trees, cuts, cuts[1:]):
        t = int(tree[s])
        above = top.path(0, t)
        shared: dict[int, list[bytes]] = {}
        for j in range(s, e):
            i = int(idx[j])
            up = i // FAN
            if up not in shared:
                shared[up] = [*made.path(1, up), *above]
            path = [*made.siblings(0, i), *shared[up]]
            folded = made.fold(claimed[j], i)
            out["subroot"].append(made.root.decode())
            out["proof"].append(_hash(b"".join(path)).decode())
            out["folded"].append(top.fold(folded, t).decode())
            out["siblings"].append([x.decode() for x in path] if siblings else None)
    root = top.root.decode()
    return pa.table(
        {
            "id": rows.column("id"), "leaf": rows.column("leaf"), "subroot": pa.array(out["subroot"], pa.string()),
            "root": pa.array([root] * len(leaf), pa.string()), "proof_sha256": pa.array(out["proof"], pa.string()),
            "folded_root": pa.array(out["folded"], pa.string()),
            "verified": pa.array([f == root for f in out["folded"]], pa.bool_()),
            "siblings": pa.array(out["siblings"], pa.list_(pa.string())),
        }
    )


def prove(manifest: Manifest, siblings: bool = False, run: int = RUN) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings) of every row.

    Leaves carry ``claimed``, the digest to check. ``folded_root`` is the root that it leads to
    with the row's proof. The proof's digests themselves are given with ``siblings``, else null.
    """
    # Children of one node stay in one run, so only inner nodes are ever fetched.
    rows = manifest.leaves.withColumn("run", F.floor((F.col("at") - F.pmod("idx", F.lit(FAN))) / run))
    n = manifest.groups.select(F.count("*"))
    ends = rows.groupBy("run", "tree").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.max("m").alias("m"))
    over = rows.groupBy("run").agg(F.min("tree").alias("a"), F.max("tree").alias("b"))
    over = over.select("run", F.lit(TOP).cast("long").alias("tree"), "a", "b", n.scalar().alias("m"))
    open_ = ends.unionByName(over).where("a > 0 or b < m - 1")

    def coordinates(batches):
        for batch in batches:
            run, tree, a, b, m = (batch.column(i).to_pylist() for i in range(5))
            out = [(run[j], tree[j], k, i) for j in range(len(run)) for k, i in beside(a[j], b[j], m[j])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["run", "tree", "level", "idx"])

    wanted = open_.mapInArrow(coordinates, "run long, tree long, level int, idx long")
    nodes = manifest.nodes.select("tree", "level", "idx", "digest")
    fetched = nodes.join(wanted.hint("shuffle_merge"), ["tree", "level", "idx"]).select("run", "tree", "level", "idx", "digest")
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean, siblings array<string>"
    )

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        return _expand(left, right, siblings)

    mine = rows.select("run", "at", "id", "tree", "idx", "m", "leaf", "claimed", n.scalar().alias("trees"))
    return mine.groupBy("run").cogroup(fetched.groupBy("run")).applyInArrow(expand, schema)


def tampered_text(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def verify_documents(docs: DataFrame, changed: Column, siblings: bool = False) -> DataFrame:
    """Proofs of all documents, where those with ``changed`` are checked with lower-cased text."""
    values = [F.col(c) for c in DOCUMENT]
    leaf = digest(*values)
    other = digest(*values[:-1], tampered_text(F.col("text")))
    manifest = build(docs, "doc_id", "source", leaf, claimed=F.when(changed, other).otherwise(leaf))
    return prove(manifest, siblings).withColumnRenamed("id", "doc_id")
