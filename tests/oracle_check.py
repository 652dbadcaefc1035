"""Compare every registered query with its SQL on DuckDB.

    python tests/oracle_check.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got, got_names = _normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want, want_names = _normal(cur.fetchall(), want_names)
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first {got[:1]} / {want[:1]}"
    types_got = dict(df.dtypes)
    for g, w in zip(got, want):
        if g != w:
            return False, f"{got_names}\n   spark {g}\n   duck  {w}"
    for i, n in enumerate(got_names):
        for g, w in zip(got, want):
            if g[i] is not None and type(g[i]) is not type(w[i]):
                return False, f"type of {n}: {types_got[n]} {type(g[i])} / {type(w[i])}"
    return True, f"{len(got)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from assetlens.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, name, query, oracles[name], sf_dir)
            else:
                ok, note = True, f"rows only: {query(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, str(exc)[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
