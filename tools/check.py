"""Run registered queries next to their SQL twins and report differences.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import faulthandler
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from periodlens.catalog import ORACLES, QUERIES  # noqa: E402
from periodlens.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else a short description."""
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_names != names:
        return f"columns {got_names} != {names}", len(got)
    if got != want:
        a, b = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} vs {len(want)}; only spark {str(a)[:600]}; only sql {str(b)[:600]}", len(got)
    return None, len(got)


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    faulthandler.enable()
    for name, fn in QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        faulthandler.dump_traceback_later(240, exit=True)
        try:
            if name in ORACLES:
                diff, n = compare(fn(spark, sf_dir), con, ORACLES[name])
            else:
                diff, n = None, len(fn(spark, sf_dir).collect())
        except Exception as e:  # noqa: BLE001
            diff, n = f"error {str(e)[:1500]}", 0
        bad += diff is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {name} rows={n} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
