"""Run a registered query and its SQL check and compare all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(row[n]) for n in names) for row in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted(tuple(_cell(row[i]) for i in order) for row in result.fetchall())


def compare(spark, con, name, query, sql, sf_dir=SF_DIR):
    """Empty text when both sides agree, else what differs."""
    names, got = spark_rows(query(spark, sf_dir))
    wanted_names, wanted = duck_rows(con, sql)
    if names != wanted_names:
        return f"{name}: columns {names} against {wanted_names}"
    if got == wanted:
        return "" if got else f"{name}: no rows on either side"
    only_got = [r for r in got if r not in set(wanted)][:3]
    only_wanted = [r for r in wanted if r not in set(got)][:3]
    return f"{name}: {len(got)} rows against {len(wanted)}\n {names}\n  spark {only_got}\n  sql   {only_wanted}"
