"""Compare catalogue queries with their SQL counterpart in DuckDB."""

from __future__ import annotations

import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 9)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(names), rows_of(names, cur.fetchall())


def difference(spark_side, sql_side) -> str | None:
    if spark_side[0] != sql_side[0]:
        return f"columns {spark_side[0]} / {sql_side[0]}"
    a, b = spark_side[1], sql_side[1]
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:3] if len(a) < 200_000 else []
    only_b = [r for r in b if r not in set(a)][:3] if len(b) < 200_000 else []
    return f"rows {len(a)} / {len(b)}; spark only {str(only_a)[:600]}; sql only {str(only_b)[:600]}"


def main() -> None:
    sys.path.insert(0, "/root/repo")
    from atticwork.plans import CATALOG
    from atticwork.session import build_session

    directory = sys.argv[1]
    wanted = sys.argv[2:] or list(CATALOG)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    bad = 0
    for name in wanted:
        q = CATALOG[name]
        start = time.time()
        try:
            mine = spark_rows(q(spark, directory))
            took = time.time() - start
            problem = difference(mine, sql_rows(con, q.sql)) if q.sql else None
            label = "ok " if problem is None else "BAD"
            print(f"{label} {name} rows={len(mine[1])} {took:.2f}s {'' if q.sql else '(no sql)'} {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR {name} {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
