"""Remove word spans that earlier documents hold, by a compacted de Bruijn graph.

Runs of ``width`` consecutive words are the edges of the graph. Only edges that can repeat are
built: the least hashed run of ``PROBE`` words inside an edge is the same wherever the edge
occurs, so an edge whose least run is in one document only is unique and never leaves its task.
Edges found in several documents are joined by the place of their first occurrence; an edge and
the next one merge when they occur at exactly the same places, one word apart, which is when the
node between them does not branch. What is left of a path is its first edge and its length. Joined
with all occurrences of that first edge, a path gives the place of every long repeated span.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm import wordhash as wh
from periodlens.llm.tables import discard, saved

WIDTH = 13
PROBE = 5


def _least_runs(w: wh.Words, width: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of a run of ``probe`` words in each run of ``width``, and which runs stay in a row."""
    n = len(w.hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least, have, want = wh.windows(w.hashes, probe), 1, width - probe + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least, wh.in_row(w.first, width, n)


def _probes(docs: DataFrame, width: int, probe: int) -> DataFrame:
    schema = T.StructType([T.StructField("h", T.LongType()), docs.schema["id"]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in wh.blocks(batch.column("text")):
                w = wh.words(data, rows)
                least, inside = _least_runs(w, width, probe)
                at = np.flatnonzero(inside)
                row = w.row_of[at]
                value = least[at]
                new = np.ones(len(at), bool)
                new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wh.signed(value[new])), batch.column("id").slice(lo, hi - lo).take(pa.array(row[new]))],
                    names=["h", "id"],
                )

    return docs.select("id", "text").mapInArrow(scan, schema)


def _edges(rows: DataFrame, width: int, probe: int) -> DataFrame:
    """(a, b, id, row, at): 128-bit hash and place of the edges whose least run is in ``hs``."""
    schema = T.StructType(
        [
            T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), rows.schema["id"],
            T.StructField("row", T.LongType()), T.StructField("at", T.IntegerType()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("hs")
            for lo, hi, data, offsets in wh.blocks(batch.column("text")):
                w = wh.words(data, offsets)
                least, inside = _least_runs(w, width, probe)
                take = np.zeros(len(least), bool)
                for r in range(hi - lo):
                    s, e = w.first[r], max(w.first[r], w.first[r + 1] - width + 1)
                    take[s:e] = np.isin(wh.signed(least[s:e]), wanted[lo + r].values.to_numpy())
                at = np.flatnonzero(take & inside)
                row = w.row_of[at]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(wh.signed(wh.windows(w.hashes, width)[at])),
                        pa.array(wh.signed(wh.windows(w.hashes, width, 0x9FB21C651E98DF25)[at])),
                        batch.column("id").slice(lo, hi - lo).take(pick),
                        batch.column("row").slice(lo, hi - lo).take(pick),
                        pa.array((at - w.first[row]).astype(np.int32)),
                    ],
                    names=schema.names,
                )

    return rows.select("id", F.xxhash64("id", "mark").alias("row"), "text", "hs").mapInArrow(build, schema)


def repeated_paths(edges: DataFrame) -> DataFrame:
    """(a, b, lo, length): first edge, smallest id and number of edges of each compacted path."""
    # A place is the upper half of a row's hash and the position in it; equal halves of different
    # rows do no harm, as edges merge only if all their full places agree.
    place = F.col("row").bitwiseAND(F.lit(0x7FFFFFFF80000000)).bitwiseOR(F.col("at").cast("long"))

    def prints(at: Column, name: str) -> list[Column]:
        """56 bits of the hashed places, summed in two parts, so that repeated rows don't cancel out.

        A sum holds for up to 2^35 places of one edge.
        """
        h = F.xxhash64("row", at)
        parts = [F.shiftrightunsigned(h, 28 * k).bitwiseAND(F.lit((1 << 28) - 1)) for k in range(2)]
        return [F.sum(part).alias(f"{name}{k}") for k, part in enumerate(parts)]

    repeated = (
        edges.groupBy("a", "b")
        .agg(
            F.min(place).alias("rep"),
            F.min("id").alias("lo"),
            F.max("id").alias("hi"),
            F.count("*").alias("n"),
            *prints(F.col("at"), "here"),
            *prints(F.col("at") + 1, "next"),
        )
        .where("lo < hi")
        .withColumn("doc", F.shiftright("rep", 31))
    )
    # The edges that a document is the one to stand for, in order; a document bounds the window.
    along = Window.partitionBy("doc").orderBy("rep")
    same = [F.lag(c).over(along) == F.col(c) for c in ("n", "lo", "hi")]
    same += [F.lag(f"next{k}").over(along) == F.col(f"here{k}") for k in range(2)]
    linked = F.lag("rep").over(along) == F.col("rep") - 1
    for s in same:
        linked = linked & s
    heads = repeated.withColumn("head", ~F.coalesce(linked, F.lit(False)))
    path = F.count_if("head").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        heads.withColumn("path", path)
        .groupBy("doc", "path")
        .agg(F.min_by(F.struct("a", "b"), "rep").alias("e"), F.min("lo").alias("lo"), F.count("*").alias("length"))
        .select("e.a", "e.b", "lo", "length")
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, probe: int = PROBE
) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) of every row of ``docs``.

    ``kept`` are the kept words joined by one space, ``spans`` the removed word ranges [from, to).
    A word goes when a run of ``width`` words over it also starts in a document with a smaller id.
    Null texts have no words. Rows of one id never remove each other's words; rows without an id
    keep all. An empty table gives an empty result.
    """
    plain = docs.select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark")
    )
    known = plain.where("id is not null and text is not null")
    # Exact copies of a smaller id go whole; only the first of them enters the graph.
    same = known.select("id", "mark", F.xxhash64(F.lit(1), "text").alias("mark2"))
    firsts = saved(
        same.groupBy("mark", "mark2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "span-firsts"
    )
    copies = saved(
        same.join(firsts, ["mark", "mark2"]).where("id > lo").select("id", "mark").distinct(), "span-copies"
    )
    probes = saved(_probes(known, width, probe), "span-probes")
    shared = saved(
        probes.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h"), "span-shared"
    )
    wanted = saved(
        probes.join(shared, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("hs")), "span-wanted"
    )
    discard(probes)
    rows = known.join(wanted, "id").join(copies, ["id", "mark"], "left_anti")
    edges = saved(_edges(rows, width, probe), "span-edges")
    discard(wanted)
    paths = saved(repeated_paths(edges), "span-paths")
    span = lambda start, end: F.struct(start.cast("long").alias("from"), end.cast("long").alias("to")).alias("s")
    found = (
        edges.join(paths, ["a", "b"])
        .where(F.col("id") > F.col("lo"))
        .select("id", "row", span(F.col("at"), F.col("at") + F.col("length") + width - 1))
    )
    whole = copies.select("id", F.xxhash64("id", "mark").alias("row"), span(F.lit(0), F.lit(2**62)))
    spans = saved(found.unionByName(whole).groupBy("id", "row").agg(F.collect_set("s").alias("spans")), "span-places")
    discard(edges)
    joined = plain.join(
        spans.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "spans"),
        (F.col("id") == F.col("_id")) & (F.xxhash64("id", "mark") == F.col("_row")),
        "left",
    ).select("id", "text", "spans")
    return _cut(joined, id_col, width)


def _cut(rows: DataFrame, id_col: str, width: int) -> DataFrame:
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )

    def merged(found: list[dict], n: int) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for s, e in sorted((x["from"], min(x["to"], n)) for x in found):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [tuple(x) for x in out]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept, spans = [], [], [], []
            for value, found in zip(batch.column("text"), batch.column("spans")):
                tokens = (value.as_py() or "").encode().split()  # bytes split at the six space characters
                n = len(tokens)
                gone = merged(found.as_py(), n) if found.is_valid and n >= width else []
                if gone:
                    keep = bytearray(b"\x01") * n
                    for s, e in gone:
                        keep[s:e] = bytes(e - s)
                    tokens = list(compress(tokens, keep))
                counts.append(n)
                removed.append(n - len(tokens))
                kept.append(b" ".join(tokens))
                spans.append([{"from": s, "to": e} for s, e in gone])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(cut, schema)
