"""Compare registered queries with their SQL counterparts: python tests/oracle.py [sf_dir] [name part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if value.__class__.__name__ in ("NaTType", "NAType"):
        return None
    if isinstance(value, (list, tuple)) or value.__class__.__name__ == "ndarray":
        return tuple(cell(v) for v in value)
    if hasattr(value, "isoformat"):
        return str(value)[:26].replace("+00:00", "")
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


KIND = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double",
        "string": "text", "timestamp": "time", "timestamp_ntz": "time", "date": "date", "boolean": "bool",
        "INTEGER": "int", "BIGINT": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "double", "FLOAT": "double", "VARCHAR": "text",
        "TIMESTAMP": "time", "TIMESTAMP WITH TIME ZONE": "time", "DATE": "date", "BOOLEAN": "bool", "HUGEINT": "huge"}


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return f"ROWS {len(got):>7}  {spent:5.1f}s  {name}", True
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(want_cols)}")
    else:
        types = con.execute(f"DESCRIBE ({sql})").fetchall()
        for column, kind, *_ in types:
            spark_kind = dict(df.dtypes)[column]
            if KIND.get(spark_kind, spark_kind) != KIND.get(kind, kind) and not kind.endswith("[]"):
                problems.append(f"type {column}: {spark_kind} vs {kind}")
        a, b = rows(df.columns, got), rows(want_cols, want)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        if a != b:
            left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
            problems.append(f"values\n     spark  {left}\n     oracle {right}")
    del want_types
    if not got:
        problems.append("EMPTY RESULT")
    if problems:
        return f"FAIL {len(got):>7}  {spent:5.1f}s  {name}: " + "; ".join(problems), False
    return f"ok   {len(got):>7}  {spent:5.1f}s  {name}", True


def main(argv):
    import __spark_entry__ as entry
    from tidegrid.session import build_session

    sf_dir = argv[0] if argv and "/" in argv[0] else "/root/testdata/sf0.01"
    parts = [a for a in argv if "/" not in a]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                   "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            line, good = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # report every query
            text = str(error).split("JVM stacktrace")[0].strip()
            line, good = f"ERR  {name}: {type(error).__name__} {text[:600]}", False
        print(line, flush=True)
        if not good:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
