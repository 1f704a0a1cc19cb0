"""Runs a registered query and its SQL over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

SMALL = Path("/root/testdata/sf0.001")


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{files}'")
    return con


def rows(columns: list[str], values: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = [tuple(float(f"{r[k]:.9g}") if isinstance(r[k], float) else r[k] for k in order) for r in values]
    return sorted(clean, key=repr)


def agree(df, con, sql: str) -> None:
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, done.fetchall())
