"""Compare a Spark result with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((c is not None, str(type(c)), c if c is not None else 0) for c in r))


def problems(df, connection, sql: str) -> list[str]:
    """Differences in columns, types, row count or values; empty when equal."""
    result = connection.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    wanted = _rows(list(described), result.fetchall())
    got_types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    found = []
    if set(got_types) != set(described):
        return [f"columns {sorted(got_types)} against {sorted(described)}"]
    for name, kind in described.items():
        if got_types[name] != kind and kind != '"NULL"':
            found.append(f"type of {name}: {got_types[name]} against {kind}")
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(wanted):
        found.append(f"rows: {len(got)} against {len(wanted)}")
    if got != wanted:
        extra = [r for r in got if r not in set(wanted)][:3]
        missing = [r for r in wanted if r not in set(got)][:3]
        found.append(f"values of {sorted(described)}: only here {extra}; only in SQL {missing}")
    return found
