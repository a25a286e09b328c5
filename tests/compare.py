"""Run registered queries against their SQL in DuckDB: names, types and rows must agree.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TIMES = {}
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else f"{v:.9g}")
    return (3, str(v))


def _rows(rows, order):
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """An empty list when the two agree, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    TIMES[name] = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    s_cols, d_cols = df.columns, [d[0] for d in cur.description]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns {sorted(s_cols)} != {sorted(d_cols)}"]
    d_types = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        w = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if d_types[f.name] != w:
            problems.append(f"type of {f.name}: {w} != {d_types[f.name]}")
    cols = sorted(s_cols)
    a = _rows(got, [s_cols.index(c) for c in cols])
    b = _rows(want, [d_cols.index(c) for c in cols])
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        x, y = diff[0]
        cells = [(c, p[1][:120], q[1][:120]) for c, p, q in zip(cols, x, y) if p != q]
        problems.append(f"{len(diff)} rows differ, first: {cells[:3]}")
    return problems


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from convolens.session import local_session

    sf_dir, only = argv[0], argv[1:]
    spark = local_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                problems = compare(spark, con, name, fn, sqls[name], sf_dir)
                note = "match" if not problems else "; ".join(problems)
            else:
                problems, note = [], f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problems, note = [str(exc)], f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name:28s} {TIMES.get(name, time.time()) - t0:6.2f}s of {time.time() - t0:6.2f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
