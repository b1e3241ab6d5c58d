"""Run registered queries next to their SQL in DuckDB and compare whole results.

Usage: python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '4GB'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if hasattr(v, "as_tuple"):
            return "decimal:" + str(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, sf_dir, query, sql):
    t0 = time.time()
    df = query(spark, sf_dir)
    ours, our_cols = canonical([tuple(r) for r in df.collect()], df.columns)
    t1 = time.time()
    if sql is None:
        return len(ours), t1 - t0, 0.0, None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs, their_cols = canonical(cur.fetchall(), names)
    t2 = time.time()
    problem = None
    if our_cols != their_cols:
        problem = f"columns {our_cols} vs {their_cols}"
    elif len(ours) != len(theirs):
        problem = f"rows {len(ours)} vs {len(theirs)}"
    elif ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        only = sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3]
        problem = f"{len(bad)} of {len(ours)} rows differ (columns {our_cols}); ours {only[0]}; sql {only[1]}"
    return len(ours), t1 - t0, t2 - t1, problem


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from loomgraph.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"{DATA}/sf{sf}")
    sql = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            n, ts, td, problem = compare(spark, con, f"{DATA}/sf{sf}", query, sql.get(name))
        except Exception as error:  # report and go on with the next query
            n, ts, td, problem = -1, 0.0, 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        state = "no sql" if name not in sql and not problem else ("ok" if not problem else "FAIL")
        print(f"{state:7} {name:32} rows={n} spark={ts:.1f}s duckdb={td:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
