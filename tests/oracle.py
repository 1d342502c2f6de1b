"""Compare a registered query with its oracle SQL, as rows with sorted columns."""

import collections

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), collections.Counter(tuple(repr(norm(r[i])) for i in order) for r in records)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


def actual(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sql, sf_dir):
    """Empty where both give the same rows; else a short account of how they differ."""
    (ac, a), (oc, o) = actual(df), oracle(sql, sf_dir)
    if ac != oc:
        return f"columns {ac} and {oc}"
    extra, missing = a - o, o - a
    return f"{sum(extra.values())} extra, {sum(missing.values())} missing; e.g. {list(extra)[:2]} {list(missing)[:2]}" if extra or missing else ""
