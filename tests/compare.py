"""Compare every registered query with its SQL statement, value by value."""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


TIMES = {"spark": 0.0}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        return "DECIMAL " + str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return "DATE " + str(v)
    if isinstance(v, (list, tuple, dict)) or type(v).__name__ == "Row":
        return "NESTED " + str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """Empty list when both results agree, else what differs."""
    df = fn(spark, sf_dir)
    start = time.time()
    sc, sr = rows_of(df.columns, df.collect())
    TIMES["spark"] = time.time() - start
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    oc, orr = rows_of(rel.columns, rel.fetchall())
    problems = []
    wide = {c: t for c, t in types.items() if t in ("HUGEINT",) or t.startswith("DECIMAL")}
    if wide:
        problems.append(f"oracle types {wide}")
    if sc != oc:
        problems.append(f"columns {sc} != {oc}")
    elif sr != orr:
        problems.append(f"rows {sum(sr.values())} vs {sum(orr.values())}; only spark "
                        f"{list((sr - orr).items())[:4]}; only sql {list((orr - sr).items())[:4]}")
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "date", "timestamp", "timestamp_ntz")]
    if nested:
        problems.append(f"spark column types of {nested}")
    return problems, sum(sr.values())


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from listingflow.session import local_session
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems, n = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                problems, n = [], fn(spark, sf_dir).count()
        except Exception as error:  # report and go on with the next query
            problems, n = [f"{type(error).__name__}: {str(error)[:900]}"], -1
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:28s} {n:8d} rows {TIMES['spark']:6.2f}s of {time.time() - start:6.2f}s  {mark} {' | '.join(problems)[:1500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
