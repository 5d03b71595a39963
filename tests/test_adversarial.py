"""The operators on hot keys and awkward values, against plain SQL joins over the same rows."""

from __future__ import annotations

import duckdb
import pytest

from registry import oracle, queries
from registry.fixtures import TABLES, VIEWS

from .adversarial import DDL, tables
from .compare import duck_rows, spark_rows

SEEDS = (8,)
# Read event logs only, or compare rows by a key that is not unique here.
SKIPPED = {"website_domain", "domain_related", "normalize_domain", "domain_root", "alnum_clean"}
NAMES = sorted(k for k in queries.QUERIES if k not in SKIPPED and "dq_" not in oracle.ORACLE[k].split("AS (", 1)[0])


def on_given_rows(sql: str) -> str:
    """The statement with each derived view replaced by the table of that name."""
    for name in DDL:
        derived = VIEWS[name].format(**{t: t for t in TABLES})
        sql = sql.replace(f" AS ({derived})", f" AS (SELECT * FROM given_{name})")
    return sql


@pytest.fixture(scope="module", params=SEEDS)
def given(request, spark):
    data = tables(request.param)
    with duckdb.connect() as con:
        frames = {}
        for name, rows in data.items():
            con.execute(f"CREATE TABLE given_{name} ({DDL[name]})")
            con.executemany(f"INSERT INTO given_{name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
            frames[name] = spark.createDataFrame(rows, DDL[name]).repartition(4).cache()
        yield frames, con
        for frame in frames.values():
            frame.unpersist()


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_and_awkward_values(spark, given, monkeypatch, name):
    frames, con = given
    monkeypatch.setattr(queries, "view", lambda _spark, _dir, view: frames[view])
    columns, rows = spark_rows(queries.QUERIES[name](spark, ""))
    expected_columns, expected = duck_rows(con, on_given_rows(oracle.ORACLE[name]))
    assert columns == expected_columns
    assert rows == expected
