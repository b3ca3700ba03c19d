"""Results of any length as pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import catalogue
from tallyloom.sinks import export


def test_pages_are_bounded_and_follow_each_other(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("file"), (1000 - F.col("id")).alias("idx"))
    pages = export.paged(rows, ["file", "idx"], 50).groupBy("file", "page").agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).collect()
    assert sum(p["n"] for p in pages) == 1000 and max(p["n"] for p in pages) <= 50
    for file in range(3):
        own = sorted((p["a"], p["b"]) for p in pages if p["file"] == file)
        assert all(b < a for (_, b), (a, _) in zip(own, own[1:]))


def test_a_result_may_be_larger_than_a_payload(spark, duck, sf_dir, monkeypatch):
    monkeypatch.setattr(export, "MAX_PAYLOAD", 5000)
    whole = export.paged
    monkeypatch.setattr(export, "paged", lambda tx, order: whole(tx, order, 100))
    got = catalogue.queries()["result_json"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(catalogue.oracle_sql()["result_json"]).fetchall()) and len(got) == 5
