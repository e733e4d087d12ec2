"""Compare a Spark frame with another engine's result: names, kinds of type, and all values.

Run as a script to check every query, or the named ones:
    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {
    "bigint": "long", "long": "long", "integer": "int", "int": "int", "double": "double", "float": "float",
    "varchar": "string", "string": "string", "date": "date", "boolean": "boolean", "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    return repr(v)


def differences(df, con, sql: str) -> list[str]:
    problems = []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {n: str(t).lower() for n, t in zip(names, [d[1] for d in result.description])}
    theirs = result.fetchall()
    described = {r[0]: r[1].lower() for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    order = sorted(df.columns)
    if sorted(names) != order:
        return [f"columns differ: {order} vs {sorted(names)}"]
    for name, dtype in df.dtypes:
        a, b = KINDS.get(dtype, dtype), KINDS.get(described[name], described[name])
        if a != b:
            problems.append(f"type of {name}: {a} vs {b}")
    ours = Counter(tuple(_cell(v) for v in row) for row in (tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect()))
    at = [names.index(n) for n in order]
    other = Counter(tuple(_cell(row[i]) for i in at) for row in theirs)
    if sum(ours.values()) != sum(other.values()):
        problems.append(f"rows: {sum(ours.values())} vs {sum(other.values())}")
    left, right = ours - other, other - ours
    if left or right:
        problems.append(f"{sum(left.values())} rows only here, {sum(right.values())} only there; {order}")
        problems += [f"  here  {r}"[:400] for r in sorted(left)[:3]] + [f"  there {r}"[:400] for r in sorted(right)[:3]]
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    from skarn.session import local_session

    sf_dir, only = argv[0], argv[1:]
    spark, con = local_session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries), set(sqls) - set(queries)
    failed = 0
    for name in only or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                problems = differences(df, con, sqls[name])
                n = "" if problems else "ok"
            else:
                n, problems = f"no SQL, {df.count()} rows", []
        except Exception as e:  # report and go on
            n, problems = "", [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        print(f"{name:32s} {time.time() - t:6.2f}s {n}", flush=True)
        for p in problems:
            print("    ", p, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
