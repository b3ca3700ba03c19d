"""How well extracted rows match the truth."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_description
from ..functions.amounts import MONEY_SQL

CASE = "name string, statement_text string, expected struct<account_id:string,currency:string,opening_balance:string,closing_balance:string,transactions:array<struct<booking_date:string,amount:string,description:string>>>"


def load_cases(spark, paths) -> DataFrame:
    """Cases in JSON files, one a file; a file that isn't one raises."""
    return spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(paths).orderBy("name")


def expected_rows(cases: DataFrame) -> DataFrame:
    rows = cases.select(F.col("name").alias("case_name"), F.posexplode("expected.transactions").alias("pos", "t"))
    amount = F.coalesce(F.col("t.amount").try_cast(MONEY_SQL), F.raise_error(F.lit("a case's amount is not a number")).cast(MONEY_SQL))
    return rows.select("case_name", "pos", amount.alias("amount"), F.to_date("t.booking_date", "yyyy-MM-dd").alias("booking_date"), F.col("t.description").alias("description"))


def match_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_name, expected_pos, actual_pos): pairs of equal amount, each expected row in order taking the first free row of its date, else the first free one.

    An earlier row may take what a later one would have, so each case and
    amount is one group; the groups spread over the cluster.
    """

    def one(key: tuple, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        free = have.sort_values("pos")[["pos", "booking_date"]].values.tolist()
        of_date: dict[object, deque[int]] = defaultdict(deque)
        for k, (_, date) in enumerate(free):
            if not pd.isna(date):
                of_date[date].append(k)
        taken, first, rows = bytearray(len(free)), 0, []
        for pos, date in want.sort_values("pos")[["pos", "booking_date"]].values.tolist():
            same = of_date.get(date) if not pd.isna(date) else None
            # each row is passed over once in either queue, so the work grows with the rows and not with their pairs
            while same and taken[same[0]]:
                same.popleft()
            while first < len(free) and taken[first]:
                first += 1
            best = same[0] if same else first
            if best < len(free):
                taken[best] = 1
                rows.append((key[0], pos, free[best][0]))
        return pd.DataFrame(rows, columns=["case_name", "expected_pos", "actual_pos"])

    columns = ["case_name", "amount", "pos", "booking_date"]
    left, right = (x.select(F.col("case_name"), F.col("amount").cast(MONEY_SQL).alias("amount"), F.col("pos").cast("int").alias("pos"), "booking_date").select(columns) for x in (expected, actual))
    return left.groupBy("case_name", "amount").cogroup(right.groupBy("case_name", "amount")).applyInPandas(one, "case_name string, expected_pos int, actual_pos int")


def descriptions_match(expected: Column, actual: Column) -> Column:
    """Both empty, or one normal form within the other."""
    e, a = normalize_description(expected), normalize_description(actual)
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(none(expected), none(actual)).when(none(actual), F.lit(False)).otherwise(F.contains(a, e) | F.contains(e, a))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def score(expected: DataFrame, actual: DataFrame, matched: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_name, expected_count, actual_count, matched, precision, recall, f1, date_accuracy, description_accuracy); ``cases`` (case_name) lists all of them."""
    e = expected.select("case_name", F.col("pos").alias("expected_pos"), F.col("booking_date").alias("e_date"), F.col("description").alias("e_text"))
    a = actual.select("case_name", F.col("pos").alias("actual_pos"), F.col("booking_date").alias("a_date"), F.col("description").alias("a_text"))
    pairs = matched.join(e, ["case_name", "expected_pos"]).join(a, ["case_name", "actual_pos"])
    yes = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per = pairs.groupBy("case_name").agg(
        F.count("*").alias("matched"), F.avg(F.when(F.col("e_date").isNotNull(), F.when(F.coalesce(F.col("e_date") == F.col("a_date"), F.lit(False)), 1.0).otherwise(0.0))).alias("date_accuracy"),
        yes(descriptions_match(F.col("e_text"), F.col("a_text"))).alias("description_accuracy"),
    )
    out = cases.select("case_name").distinct()
    for part, name in ((expected, "expected_count"), (actual, "actual_count")):
        out = out.join(part.groupBy("case_name").agg(F.count("*").alias(name)), "case_name", "left")
    out = out.join(per, "case_name", "left").na.fill(0, ["expected_count", "actual_count", "matched"])
    out = out.withColumns({"precision": ratio(F.col("matched"), F.col("actual_count")), "recall": ratio(F.col("matched"), F.col("expected_count"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def header_checks(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(case_name, *_correct): null where the truth says nothing."""
    out = truth.alias("t").join(found.alias("f"), "case_name", "left")
    check = lambda c, got: F.when(F.col(f"t.{c}").isNotNull(), F.coalesce(F.col(f"t.{c}") == got, F.lit(False))).alias(f"{c}_correct")
    return out.select("case_name", check("opening_balance", F.col("f.opening_balance")), check("closing_balance", F.col("f.closing_balance")), check("currency", F.upper("f.currency")), check("account_id", F.col("f.account_id")))


def summarize(scores: DataFrame) -> DataFrame:
    """(case_count, mean_f1, mean_precision, mean_recall, worst_case, worst_f1), of no score no row."""
    worst = F.struct("f1", "case_name")
    out = scores.agg(F.count("*").alias("case_count"), F.avg("f1").alias("mean_f1"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.min_by("case_name", worst).alias("worst_case"), F.min("f1").alias("worst_f1"))
    return out.where("case_count > 0")
