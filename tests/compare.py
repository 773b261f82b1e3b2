"""Compares registered queries with their SQL on the given tables.

    python tests/compare.py [sf_dir] [name ...]
"""
import collections
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return ("f", 0.0 if value == 0 else float(f"{value:.12g}"))
    if isinstance(value, int):
        return value
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), collections.Counter(
        tuple(cell(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def type_differences(frame, con, sql):
    """Columns whose Spark type is not the SQL type."""
    relation = con.sql(sql)
    sql_types = dict(zip(relation.columns, map(str, relation.types)))
    return [f"{name} {kind}/{sql_types.get(name)}" for name, kind in frame.dtypes
            if KINDS.get(kind) != sql_types.get(name)]


def compare(frame, con, sql):
    """None when equal, else a text that says what differs."""
    columns, spark_bag = bag(frame.columns, [tuple(r) for r in frame.collect()])
    relation = con.sql(sql)
    sql_columns, sql_bag = bag(relation.columns, relation.fetchall())
    if columns != sql_columns:
        return f"columns {columns} != {sql_columns}"
    if spark_bag != sql_bag:
        left = list((spark_bag - sql_bag).items())[:2]
        right = list((sql_bag - spark_bag).items())[:2]
        return (f"{sum(spark_bag.values())} vs {sum(sql_bag.values())} rows, "
                f"{sum((spark_bag - sql_bag).values())} differ: {left} != {right}")
    return None if spark_bag else "EMPTY"


def main():
    import __spark_entry__ as entry
    from mooring.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    con, bad = duck(sf_dir), []
    for name in names:
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in sqls:
                problem = compare(frame, con, sqls[name])
                different = type_differences(frame, con, sqls[name])
                if different:
                    print(f"   {name} types: {different}")
            else:
                problem = f"no SQL, {frame.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        if problem and not problem.startswith("no SQL"):
            bad.append(name)
        print(f"{'OK ' if problem is None else '!! '} {name:24s} {time.time() - start:6.2f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} fine; {bad}")


if __name__ == "__main__":
    main()
