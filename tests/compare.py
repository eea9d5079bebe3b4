"""Compare a registered query with its DuckDB counterpart."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else f"{v + 0.0:.9g}")
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def compare(df, con, text: str) -> str | None:
    """None if equal, else what differs."""
    got_cols = df.columns
    got = df.collect()
    rel = con.sql(text)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    g, w = rows_of(got_cols, got), rows_of(want_cols, want)
    if g != w:
        bad = [(a, b) for a, b in zip(g, w) if a != b]
        return f"{len(bad)} rows differ, first: {bad[0]}"
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    same = {
        "long": {"BIGINT"}, "integer": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"},
    }
    odd = {c: (t, duck_types[c]) for c, t in types.items() if duck_types[c] not in same.get(t, {duck_types[c]})}
    return f"types differ: {odd}" if odd else None
