"""Row-for-row comparison of a Spark result with a DuckDB result (used by the tests)."""

import datetime
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

_FAMILY = {"HUGEINT": "BIGINT", "VARCHAR": "STRING", "INTEGER": "INT", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP"}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def _rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in at) for r in data)


def compare(df, con, sql):
    names = df.columns
    got = [tuple(x.asDict(True) if hasattr(x, "asDict") else x for x in r) for r in df.collect()]
    if sql is None:
        return f"ok rows={len(got)} (no SQL twin)"
    rel = con.sql(sql)
    want_names = rel.columns
    types = {n: _FAMILY.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    want = rel.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns differ: {sorted(names)} / {sorted(want_names)}"
    a, b = _rows(names, got), _rows(want_names, want)
    if a != b:
        order = sorted(names)
        sa, sb = set(a), set(b)
        return (f"rows differ {len(a)}/{len(b)} {order}\n   spark only {len(sa - sb)}: {sorted(sa - sb)[:3]}"
                f"\n   duck only {len(sb - sa)}: {sorted(sb - sa)[:3]}")
    mine = {f.name: f.dataType.simpleString().upper() for f in df.schema}
    off = {n: (mine[n], types[n]) for n in names if mine[n] != types[n] and "DECIMAL" not in types[n]
           and "[" not in types[n] and "STRUCT" not in types[n]}
    dec = {n: types[n] for n in names if "DECIMAL" in types[n]}
    note = f" types {off or ''} {dec or ''}" if off or dec else ""
    if not a:
        note += " EMPTY"
    return f"ok rows={len(a)}{note}"
