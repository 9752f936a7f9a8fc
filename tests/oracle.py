"""Runs queries beside their SQL, as the driver does. python tests/oracle.py DIR [NAME...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(v):
    import numpy as np

    if v is None or (isinstance(v, float) and v != v):
        return "∅"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{normal(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "asDict"):
        return normal(v.asDict())
    return str(v)


def compare(spark, duck, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = sorted(tuple(normal(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(normal(r[i]) for i in order) for r in cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{name}: {len(got)} rows against {len(want)}; only here {extra}; only SQL {missing}"
    return ""


def connect(sf_dir):
    import duckdb

    duck = duckdb.connect()
    duck.execute("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        duck.execute(f"create view \"{p.stem}\" as select * from read_parquet('{at}')")
    return duck


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from conftest import make_session

    spark, duck = make_session(), connect(sys.argv[1])
    sqls, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, duck, name, q, sqls[name], sys.argv[1])
            else:
                why = f"{name}: no SQL, {q(spark, sys.argv[1]).count()} rows"
        except Exception as x:
            why = f"{name}: {str(x)[:600]}"
        print(f"{time.time() - t:5.1f} {why or name + ' ok'}", flush=True)
