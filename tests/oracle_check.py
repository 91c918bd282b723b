"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python -m tests.oracle_check [sf_dir] [name ...]
Columns are sorted by name, rows compared order-insensitively, floats to
9 significant digits, timestamps as ISO text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

from linkstream.sources.tables import TABLES


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


_SPARK_KIND = {"IntegerType": "int32", "LongType": "int64", "ShortType": "int16", "ByteType": "int8",
               "DoubleType": "float64", "FloatType": "float32", "StringType": "str", "BooleanType": "bool",
               "TimestampType": "ts", "TimestampNTZType": "ts", "DateType": "date", "DecimalType": "decimal",
               "MapType": "map", "StructType": "struct", "ArrayType": "list", "BinaryType": "bytes"}
_DUCK_KIND = {"INTEGER": "int32", "BIGINT": "int64", "SMALLINT": "int16", "TINYINT": "int8", "HUGEINT": "int128",
              "UBIGINT": "uint64", "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "str", "BOOLEAN": "bool",
              "TIMESTAMP": "ts", "DATE": "date", "DECIMAL": "decimal", "MAP": "map", "STRUCT": "struct",
              "LIST": "list", "BLOB": "bytes", "JSON": "str"}


def type_kinds(df, res):
    s = {f.name: _SPARK_KIND.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in df.schema.fields}
    d = {}
    for name, t, *_ in res.description:
        key = str(t).split("(")[0].upper()
        d[name] = _DUCK_KIND.get(key, key)
    return s, d


def compare(spark, con, name, build, sql, sf_dir):
    df = build(spark, sf_dir)
    s_names = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    d_names = [c[0] for c in res.description]
    s_kinds, d_kinds = type_kinds(df, res)
    d_rows = res.fetchall()
    problems = []
    if sorted(s_names) != sorted(d_names):
        problems.append(f"columns spark={sorted(s_names)} duck={sorted(d_names)}")
    else:
        bad_types = {c: (s_kinds[c], d_kinds[c]) for c in s_names if s_kinds[c] != d_kinds[c]}
        if bad_types:
            problems.append(f"types (spark, duck) {bad_types}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = _rows(s_names, s_rows), _rows(d_names, d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return len(s_rows), problems


def main(argv):
    sys.path.insert(0, ".")
    from linkstream.plans.registry import load_all
    from linkstream.session import get_spark

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    reg = load_all()
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        if not q.oracle:
            n = q.build(spark, sf_dir).count()
            print(f"ROWS   {name:40s} {n}")
            continue
        try:
            n, problems = compare(spark, con, name, q.build, q.oracle, sf_dir)
        except Exception as e:  # report and keep going
            n, problems = -1, [f"error: {str(e)[:400]}"]
        bad += bool(problems)
        print(f"{'OK  ' if not problems else 'FAIL'}   {name:40s} {n} {'; '.join(problems)}")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
