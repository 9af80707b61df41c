"""Run a query and its SQL on the same tables and compare rows."""

import glob
import math

import duckdb


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return float(v) if isinstance(v, int) or type(v).__name__ == "Decimal" else str(v)[:26]


def compare(spark, query, sql, folder):
    """None if they agree, else what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, not {len(want[1])}"
    off = [(g, w) for g, w in zip(got[1], want[1]) if any(a != b and not (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)) for a, b in zip(g, w))]
    return f"{len(off)} differ, first {off[0]}" if off else None
