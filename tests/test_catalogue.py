"""Every statement query against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from tallyloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        # the smallest tables have no alike pairs
        rows = rows or QUERIES[name](spark, str(Path(sf_dir).parent / "sf0.01")).limit(1).collect()
        assert df.columns and rows
        return
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)


def test_eval_scores_judges_every_order(spark, duck, sf_dir):
    got = {r["case_name"]: (r["expected_count"], r["actual_count"]) for r in QUERIES["eval_scores"](spark, sf_dir).collect()}
    want = duck.sql("select 'ACCT-' || (o_custkey % 40)::varchar, count(*) from orders group by 1").fetchall()
    assert got == {name: (n, n - (n + 4) // 5) for name, n in want}


def test_entry(spark, monkeypatch):
    import __spark_entry__ as e

    assert set(SQL) <= set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
