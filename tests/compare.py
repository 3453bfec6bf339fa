"""Runs queries against their SQL over one folder of tables and reports what differs."""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (bool, int)):
        return f"{float(value):.9g}"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows), [columns[i] for i in order]


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from '{source}'")
    return con


def compare(spark, con, folder, name, run, sql):
    began = time.time()
    df = run(spark, folder)
    ours, columns = table_rows(df.columns, df.collect())
    took = time.time() - began
    if sql is None:
        return True, f"{name}: {len(ours)} rows, no SQL, {took:.1f} s"
    result = con.execute(sql)
    theirs, names = table_rows([c[0] for c in result.description], result.fetchall())
    if columns != names:
        return False, f"{name}: columns {columns} against {names}"
    if ours != theirs:
        a, b = [x for x in ours if x not in set(theirs)], [x for x in theirs if x not in set(ours)]
        return False, f"{name}: {len(ours)} rows against {len(theirs)}; only ours {a[:3]}; only SQL {b[:3]}"
    return True, f"{name}: {len(ours)} rows equal, {took:.1f} s"


def late(*_):
    raise TimeoutError("the query took too long")


def main():
    import __spark_entry__ as entry
    from siftwell.runtime import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master=f"local[{os.cpu_count()}]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    signal.signal(signal.SIGALRM, late)
    con, sqls = duck(folder), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        signal.alarm(int(os.environ.get("EACH_S", "120")))
        try:
            fine, said = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            fine, said = False, f"{name}: {type(e).__name__} {str(e)[:600]}"
        finally:
            signal.alarm(0)
        bad += not fine
        print("ok " if fine else "BAD", said, flush=True)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
