"""Compare a query with its DuckDB statement on the same tables."""

import datetime
import decimal
import glob

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (decimal.Decimal, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert ours == theirs
