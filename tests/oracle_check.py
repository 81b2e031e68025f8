"""Compare queries with their SQL in DuckDB: python tests/oracle_check.py [sf] [name-prefix...]"""
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "0.0" if v == 0 else repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def compare(name, df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).toLocalIterator())
    want = sorted(tuple(norm(v) for v in r)
                  for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER",
            "boolean": "BOOLEAN"}
    types = [(c, t, kinds[c]) for c, t in df.dtypes if same.get(t, kinds[c]) != kinds[c]]
    if got == want:
        return f"TYPES {types}" if types else None
    bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return f"rows {len(got)} vs {len(want)}; {cols}; first differences {bad} {types}"


def main():
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    b = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC"))
    if os.environ.get("BLOCK_ROWS"):
        b = b.config("spark.depthlens.blockRows", os.environ["BLOCK_ROWS"])
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from __spark_entry__ import oracle_sql, queries
    con = duckdb.connect()
    sf_dir = f"{DATA}/sf{sf}"
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                msg = compare(name, df, con, sqls[name])
            else:
                msg = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001 - report and go on
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        if msg and not msg.startswith("rows only"):
            bad += 1
        print(f"{'ok ' if msg is None else '-- '} {name} {time.time()-t0:.1f}s {msg or ''}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
