"""Run registered queries against their SQL: python tests/check.py [sf] [name ...]."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    types = [str(c[1]) for c in got.description]
    return names, types, got.fetchall()


def by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, sf_dir, sql):
    """None if equal, else a short text."""
    rows = [tuple(r) for r in df.collect()]
    names, types, want = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    have, want = by_name(df.columns, rows), by_name(names, want)
    if len(have) != len(want):
        return f"{len(have)} rows but SQL has {len(want)}"
    for a, b in zip(have, want):
        if a != b:
            return f"{a} but SQL has {b}"
    return None


def main():
    import __spark_entry__ as e
    from tests.conftest import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    for name in names:
        start = time.time()
        sql = e.oracle_sql().get(name)
        try:
            df = e.queries()[name](spark, sf_dir)
            found = differences(df, sf_dir, sql) if sql else f"no SQL, {df.count()} rows"
        except Exception as ex:  # show every failing query in one run
            found = f"{type(ex).__name__} {str(ex)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {'ok' if found is None else found}", flush=True)


if __name__ == "__main__":
    main()
