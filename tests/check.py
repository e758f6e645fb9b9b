"""Run registered queries beside their SQL and compare the rows.

    python -m tests.check [sf_dir] [name ...]
"""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, run, sql):
    """None when equal, else a short text."""
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {df.columns} / {columns}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        missing = [r for r in b if r not in set(a)][:2]
        return f"{len(a)} / {len(b)} rows\n   spark only: {extra}\n   sql only:   {missing}"
    return None if a else "no rows"


def main():
    import __spark_entry__ as entry
    from merchframe.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con = local_session("8"), connect(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, queries[name], oracles[name]) if name in oracles else (
                f"rows only: {len(queries[name](spark, sf_dir).collect())}")
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem) and not str(problem).startswith("rows only")
        print(f"{'ok  ' if not problem else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
