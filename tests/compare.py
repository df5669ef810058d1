"""Holds registered queries against their SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for name in TABLES:
            if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
                db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        found = db.execute(sql)
        return [c[0] for c in found.description], found.fetchall()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, sf_dir: str, sql: str) -> list[str]:
    columns, data = oracle(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    got, want = rows(df.columns, map(tuple, df.collect())), rows(columns, data)
    if got == want:
        return []
    return [f"{len(got)} and {len(want)} rows", *[f"got {a} want {b}" for a, b in zip(got, want) if a != b][:3]]
