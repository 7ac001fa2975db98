"""The manifest and its proofs against a plain recomputation."""

import zlib
from hashlib import sha256

import pytest
from conftest_llm import EDGE_ROWS, SF, read_rows
from pyspark.sql import functions as F

from periodlens.llm import merkle
from periodlens.llm.queries import op13_merkle_manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = list(row)
    if lower and values[-1] is not None:
        values[-1] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in values[-1])
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(digests):
    """Levels up to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        out += [(run, i % 16)]
        i //= 16
    return out


def brute(rows):
    """(doc_id, source, lang, n_chars, text) rows to sorted result tuples."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in by[s]]) for s in names]
    top = climb([t[-1][0] for t in trees])
    root, out = top[-1][0] if names else None, []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            runs = path(trees[k], i) + path(top, k)
            proof = H(*[d for run, at in runs for j, d in enumerate(run) if j != at])
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = leaf(r, changed)
            for run, at in runs:
                d = H(*run[:at], d, *run[at + 1 :])
            out.append((r[0], leaf(r), trees[k][-1][0], root, proof, d, d == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def proved(docs, run=merkle.RUN):
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaf_, other = merkle.digest(*map(F.col, merkle.DOCUMENT)), merkle.digest(*map(F.col, merkle.DOCUMENT[:-1]), merkle.tampered_text(F.col("text")))
    made = merkle.build(docs, "doc_id", "source", leaf_, claimed=F.when(changed, other).otherwise(leaf_))
    got = merkle.prove(made, siblings=True, run=run).withColumnRenamed("id", "doc_id")
    rows = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
    for r in got.collect():
        assert H(*r["siblings"]) == r["proof_sha256"]
    return sorted(rows, key=str), made


def test_query_on_documents(spark):
    rows = read_rows(f"{SF}/documents.parquet", ["doc_id", "source", "lang", "n_chars", "text"])
    got = op13_merkle_manifest(spark, SF)
    assert got.columns == COLUMNS
    got = sorted([tuple(r) for r in got.collect()], key=str)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("run", [16, 100, 4096])
def test_odd_rows_many_sources_and_levels(spark, run):
    rows = [(r[0], r[3], r[2], None if r[1] is None else len(r[1]), r[1]) for r in EDGE_ROWS]
    rows += [(None, "a", None, None, "No Id"), (None, None, None, None, None), (7, "z", "de", 1, "Twice"), (7, "z", "de", 1, "Twice")]
    rows += [(i, "big", "en", i, f"Text {i}") for i in range(1, 601)] + [(-i, f"s{i}", None, 0, "") for i in range(40)]
    rows += [(i, "é", None, 0, "x") for i in range(17)] + [(i, "\U0001f600", None, 0, "x") for i in range(16)]
    got, made = proved(spark.createDataFrame(rows, SCHEMA).repartition(3), run)
    assert got == brute(rows)
    assert made.root() == got[0][3]


def test_one_row_empty_table_and_clashing_columns(spark):
    one = [(3, "s", None, None, "Aa")]
    assert proved(spark.createDataFrame(one, SCHEMA))[0] == brute(one)
    empty, made = proved(spark.createDataFrame([], SCHEMA))
    assert empty == [] and made.root() is None
    docs = spark.createDataFrame(one, SCHEMA)
    for c in ("at", "first", "tree", "idx", "m", "leaf", "id", "_mark", "run", "digest", "claimed"):
        docs = docs.withColumn(c, F.create_map(F.lit(1), F.lit(2)))
    assert proved(docs)[0] == brute(one)
