"""Run registered queries on Spark and their oracles on DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(frame):
    return sorted(frame.columns), rows_of(frame.columns, frame.collect())


def duck_rows(connection, text):
    result = connection.execute(text)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def difference(frame, connection, text) -> str | None:
    """None when equal, else a short account of what differs."""
    columns, ours = spark_rows(frame)
    oracle_columns, theirs = duck_rows(connection, text)
    if columns != oracle_columns:
        return f"columns {sorted(set(columns) ^ set(oracle_columns))}"
    if ours != theirs:
        mine, other = set(map(repr, ours)) - set(map(repr, theirs)), set(map(repr, theirs)) - set(map(repr, ours))
        return (
            f"rows {len(ours)} vs {len(theirs)}, differing {len(mine)}/{len(other)}\n"
            f"  cols   {columns}\n  spark  {sorted(mine)[:2]}\n  duckdb {sorted(other)[:2]}"
        )
    kinds = [(c, {type(v).__name__ for v in col if v is not None}) for c, col in zip(columns, zip(*ours))]
    other_kinds = [{type(v).__name__ for v in col if v is not None} for col in zip(*theirs)]
    mixed = [(c, k, o) for (c, k), o in zip(kinds, other_kinds) if k != o]
    return f"types {mixed}" if mixed else None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as contract
    from tickerloom import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, connection, bad = contract.queries(), contract.oracle_sql(), duck(folder), 0
    for name in names or list(queries):
        start, built = time.time(), 0.0
        try:
            frame = queries[name](spark, folder)
            built = time.time() - start
            if name in oracles:
                problem, count = difference(frame, connection, oracles[name]), ""
            else:
                problem, count = None, frame.count()
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {kind} rows={count} build={built:.1f}s all={time.time() - start:.1f}s")
        if problem:
            print("   ", problem)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
