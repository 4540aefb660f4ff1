"""Run registered queries against their SQL oracles in DuckDB. Usage: oracle_check.py [sf] [names...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = entry_module.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(canonical(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - started
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(rows)} rows, no oracle, {took:.1f}s"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(canonical(r[i]) for i in order) for r in rel.fetchall()]
    a, b = sorted(map(repr, rows)), sorted(map(repr, want))
    if a == b:
        return True, f"{len(rows)} rows equal, {took:.1f}s"
    sa, sb = set(a), set(b)
    return False, (
        f"{len(a)} vs {len(b)} rows {cols}\n   spark only: {sorted(sa - sb)[:3]}\n   sql only:   {sorted(sb - sa)[:3]}"
    )


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), connect(sf_dir)
    picks = sys.argv[2:]
    names = [n for n in entry_module.queries() if not picks or any(n.startswith(p) for p in picks)]
    bad = []
    for name in names:
        try:
            ok, text = compare(spark, con, sf_dir, name)
        except Exception as exc:  # report and go on with the next query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(("ok   " if ok else "FAIL ") + name, text, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} passed; failing: {bad}")


if __name__ == "__main__":
    main()
