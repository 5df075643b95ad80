"""Every registered query at the smallest scale, next to DuckDB where it has a SQL text."""

import duckdb
import pytest

from check_oracle import TABLES, rows
from ebbtide.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
ENTRIES = catalogue()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_matches_sql(spark, duck, name):
    e = ENTRIES[name]
    df = e.run(spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(e.sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, cur.fetchall())


# Many boosted models of 150 rounds each; their parts are tested in test_models.py.
LONG = {"risk_definitions", "fitted_targeters", "two_stage_profit_targeting",
        "boosted_calibrated_hazard", "temporal_churn_model"}


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql and n not in LONG])
def test_runs(spark, name):
    df = ENTRIES[name].run(spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    rows = df.collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) > 0
    assert not all(v is None for r in rows for v in r)


def test_every_inventory_line_has_a_query_or_a_test():
    covered = {i for e in ENTRIES.values() for i in e.ids.split()}
    groups = {"N": 20, "A": 18, "W": 5, "K": 14, "U": 19, "C": 9, "T": 23, "B": 11, "M": 32,
              "H": 10, "D": 10, "F": 18, "P": 11, "L": 7, "S": 20, "V": 6, "ST": 5}
    # Driver-side contracts, checked in the other test files.
    contracts = {"U8", "T21", "C3", "F3", "L7", "D1", "D2", "V1"}
    missing = [f"{g}{i}" for g, n in groups.items() for i in range(1, n + 1)
               if f"{g}{i}" not in covered | contracts]
    assert missing == [] and "D6b" in covered


def test_boosted_queries_use_the_default_rounds():
    from pathlib import Path

    import ebbtide.plans

    plans = Path(ebbtide.plans.__file__).parent.glob("*.py")
    assert [p.name for p in plans if "rounds=" in p.read_text() or '"rounds"' in p.read_text()] == []
