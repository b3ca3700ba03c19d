"""Operators on small tables of known results."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import dedup, enrichment, evaluation, normalize, payload, privacy, review, verification
from tallyloom.sinks import export, ledger

KINDS = "idx int, account_id string, currency string, amount decimal(38,10), booking_date date, value_date date, description string, reference string, transaction_id string, category string, counterparty string, confidence double"


def day(n):
    return datetime.date(2026, 3, n)


def transactions(spark, rows):
    full = [(k, *(r + (None,) * (11 - len(r)))) for k, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(Decimal(x) if j == 3 else x for j, x in enumerate(r)) for r in full], KINDS)
    return normalize.with_identity(df.withColumn("source_index", F.col("idx")))


def test_exact_and_probable(spark):
    tx = transactions(spark, [("A", "EUR", "12.30", day(20), day(20), "Coffee Shop London"), ("A", "EUR", "12.3", day(20), day(20), "Coffee Shop Londn"), ("A", "EUR", "9", day(20), day(20), "Lunch")])
    out = dedup.deduplicate(tx)
    assert [r["members"] for r in out.exact.collect()] == [[0, 1]]
    probable = out.suspected.collect()
    assert len(probable) == 1 and probable[0]["tier"] == "probable" and 0.9 <= probable[0]["confidence"] <= 0.99 and "similarity 0.9" in probable[0]["reason"]
    assert [r["idx"] for r in out.unique.collect()] == [2]


def test_temporal(spark):
    tx = transactions(spark, [("A", "EUR", "1200", day(20), day(20), "Rent March"), ("A", "EUR", "1200.00", day(22), day(22), "Rent March"), ("A", "EUR", "17.5", day(20), day(20), "Lunch"), ("A", "EUR", "1200", day(29), day(29), "Rent"), ("A", "EUR", "1200", None, None, "Rent")])
    out = dedup.deduplicate(tx)
    group = out.suspected.collect()
    assert len(group) == 1 and group[0]["members"] == [0, 1] and group[0]["tier"] == "suspected"
    assert group[0]["reason"] == "Value date shift within 2 day window; description similarity 1.00" and group[0]["confidence"] == pytest.approx(0.95)
    assert sorted(r["idx"] for r in out.unique.collect()) == [2, 3, 4]


def test_idempotent_keys(spark):
    tx = transactions(spark, [("A", "EUR", "-4.50", day(20), day(20), "Coffee")] * 2)
    none = spark.createDataFrame([], "dedup_key string")
    first = dedup.new_rows(tx, none)
    assert first.count() == 2
    assert dedup.new_rows(tx, first).count() == 0 and dedup.skipped_rows(tx, first).count() == 2
    assert dedup.union_seen(first, first).count() == 2


def test_golden_rule(spark):
    tx = transactions(spark, [("A", "EUR", "1250.50", day(1)), ("A", "EUR", "-500.25", day(1)), ("B", "usd", "-99.99", day(1)), ("C", None, "1", day(1))])
    eur = tx.where("currency = 'EUR'")
    good = verification.verify_balance(eur, "10000", "10750.25").first()
    assert (good["status"], good["total_credits"], good["total_debits"], good["discrepancy"]) == ("verified", Decimal("1250.5"), Decimal("500.25"), 0)
    assert verification.verify_balance(eur, "10000", "10750.26").first()["status"] == "verified"
    bad = verification.verify_balance(eur, "10000", "10760").first()
    assert bad["status"] == "discrepancy" and bad["message"].startswith("Balance mismatch: expected delta 760.")
    assert verification.verify_balance(eur, None, "1").first()["status"] == "unverifiable"
    assert verification.verify_balance(tx.where("false"), "1", "1").first()["status"] == "verified"
    balances = spark.createDataFrame([("eur", "10000", "10750.25"), ("USD", "2500", "0")], "currency string, opening_balance string, closing_balance string")
    per = verification.verify_by_currency(tx, balances)
    assert [(r["currency"], r["status"]) for r in per.collect()] == [("EUR", "verified"), ("UNKNOWN", "unverifiable"), ("USD", "discrepancy")]
    whole = verification.aggregate_verdicts(per).first()
    assert whole["status"] == "discrepancy" and whole["message"].startswith("Multi-currency statement — EUR: verified (") and whole["actual_delta"] == Decimal("651.26")
    assert verification.aggregate_verdicts(per.where("false")).count() == 0
    assert verification.verify_transactions(tx, "1", "2").first()["status"] == "unverifiable"
    assert verification.verify_transactions(eur, "10000", "10750.25").first()["status"] == "verified"


def test_continuity(spark):
    kinds = "label string, opening_balance decimal(38,2), closing_balance decimal(38,2)"
    make = lambda *rows: spark.createDataFrame([(a, b and Decimal(b), c and Decimal(c)) for a, b, c in rows], kinds)
    check = lambda df: verification.verify_continuity(df, ["label"]).first()
    assert check(make(("1", "100", "250"), ("2", "250", "300")))["message"] == "Continuity verified across 2 statements"
    broken = check(make(("1", "100", "250"), ("2", "400", "500"), ("3", None, None)))
    assert broken["status"] == "discrepancy" and broken["breaks"][0]["gap"] == 150 and broken["unchecked_links"] == 1
    assert "1 closed at 250.00 but 2 opened at 400.00 (gap 150.00)" in broken["message"]
    assert check(make(("1", "1", "2")))["status"] == "unverifiable"
    assert check(make(("1", "1", None), ("2", "2", "3")))["message"] == "Continuity incomplete: 1 of 1 links missing a balance"


def test_normalize(spark):
    rows = spark.createDataFrame([("", "Memo", "5.5", "eur", None), ("Ref", None, "x", None, None)], "Description string, Memo string, Amount string, Currency string, Name string")
    with pytest.raises(Exception, match="not a number"):
        normalize.normalize(rows).collect()
    good, bad = normalize.split_rejects(normalize.normalize(rows, "f", strict=False))
    row = good.first()
    assert (row["description"], row["currency"], row["amount"], row["source"], row["source_method"]) == ("Memo", "EUR", Decimal("5.5"), "f", "deterministic")
    assert bad.first()["_reject"] == "amount is not a number: x"
    assert [f.name for f in good.schema] == [f.name for f in normalize.SILVER]


def test_accounts(spark):
    tx = transactions(spark, [("A", "EUR", "1", day(1), None, "UBER trip"), ("A", "EUR", "1", day(1), None, "Uber eats"), ("A", "EUR", "1", day(1), None, None)])
    rules = [("eats", "Food"), ("uber", "Travel")]
    assert [r["a"] for r in tx.select("idx", enrichment.map_accounts(F.col("description"), rules, "Other").alias("a")).orderBy("idx").collect()] == ["Travel", "Food", "Other"]
    table = spark.createDataFrame([(k, p, a) for k, (p, a) in enumerate(rules)], "ord int, pattern string, account string")
    small = {r["idx"]: r["account"] for r in enrichment.map_accounts_by(tx, table, "Other").collect()}
    enrichment.INLINE_RULES, before = 0, enrichment.INLINE_RULES
    try:
        assert {r["idx"]: r["account"] for r in enrichment.map_accounts_by(tx, table, "Other").collect()} == small == {0: "Travel", 1: "Food", 2: "Other"}
    finally:
        enrichment.INLINE_RULES = before


def test_categorize_with_a_model(spark):
    tx = transactions(spark, [("A", "EUR", str(k), day(1), None, f"row {k}") for k in range(5)]).withColumn("file", F.lit("f"))

    def model(prompt):
        if "row 4" in prompt:
            return "sorry"
        return 'Sure!\n```json\n{"results": [{"index": 0, "category": " travel ", "confidence": 2, "is_business_expense": true}, {"index": 1, "category": "Nonsense", "confidence": 0.5, "rationale": "x"}]}\n```'

    rows = {r["idx"]: r for r in enrichment.categorize(tx, model, ["file"], ["idx"], size=3).collect()}
    assert rows[0]["category"] == "Travel" and rows[0]["enrichment_confidence"] is None and rows[0]["is_business_expense"] is True
    assert rows[1]["category"] is None and rows[1]["enrichment_confidence"] == 0.5 and rows[2]["rationale"] == enrichment.NO_RESULT
    assert rows[4]["rationale"].startswith("categorization failed") and len(rows) == 5


def test_payload(spark):
    text = 'Here: {"account_id": "A", "currency": "eur", "opening_balance": "1", "transactions": [{"booking_date": "2026-03-20", "description": "Coffee 12", "amount": "-4.50", "confidence": 0.4, "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1, "page_index": 0}}]} and more'
    rows = payload.payload_rows(spark.createDataFrame([(text,)], "answer string")).collect()
    assert (rows[0]["amount"], rows[0]["currency"], rows[0]["normalized_description"], rows[0]["source_method"]) == (Decimal("-4.5"), "EUR", "coffee", "llm")
    for bad in (text.replace("-4.50", "x"), text.replace("0.4", "4"), text.replace("2026-03-20", "20.3."), text.replace('"x1": 1', '"x1": 7'), "no object"):
        with pytest.raises(Exception):  # noqa: B017
            payload.payload_rows(spark.createDataFrame([(bad,)], "answer string")).collect()
    chat = spark.createDataFrame([(json.dumps({"choices": [{"message": {"content": "hi"}}]}),)], "r string")
    assert chat.select(payload.message_content(F.col("r"))).first()[0] == "hi"


def test_evaluation(spark, tmp_path):
    case = {"name": "c", "statement_text": "t", "expected": {"account_id": "A", "currency": "GBP", "opening_balance": "1", "closing_balance": None, "transactions": [{"booking_date": "2026-03-20", "amount": "-4.50", "description": "Coffee"}, {"booking_date": "2026-03-21", "amount": "-4.5", "description": "Coffee"}, {"booking_date": None, "amount": "9", "description": None}]}}
    (tmp_path / "c.json").write_text(json.dumps(case))
    cases = evaluation.load_cases(spark, str(tmp_path))
    want = evaluation.expected_rows(cases)
    have = spark.createDataFrame([("c", 0, Decimal("-4.5"), day(21), "coffee shop"), ("c", 1, Decimal("-4.5"), day(25), "Tea"), ("c", 2, Decimal("7"), day(1), "x")], "case_name string, pos int, amount decimal(38,10), booking_date date, description string")
    pairs = evaluation.match_rows(want, have)
    assert sorted(map(tuple, pairs.collect())) == [("c", 0, 0), ("c", 1, 1)]  # the first takes the row of the second's date
    row = evaluation.score(want, have, pairs, cases.select(F.col("name").alias("case_name"))).first()
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3) and row["date_accuracy"] == 0 and row["description_accuracy"] == 0.5
    total = evaluation.summarize(spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 0.5, 0.5, 0.5)], "case_name string, precision double, recall double, f1 double")).first()
    assert (total["worst_case"], total["mean_f1"]) == ("b", 0.75)
    truth = cases.select(F.col("name").alias("case_name"), "expected.*")
    found = spark.createDataFrame([("c", "1", "2", "gbp", "B")], "case_name string, opening_balance string, closing_balance string, currency string, account_id string")
    checks = evaluation.header_checks(truth, found).first()
    assert (checks["opening_balance_correct"], checks["closing_balance_correct"], checks["currency_correct"], checks["account_id_correct"]) == (True, None, True, False)


def test_review(spark):
    tx = transactions(spark, [("A", "EUR", str(k), day(1), None, f"row {'abc'[k]}", None, None, None, None, 0.2 * k) for k in range(3)]).withColumn("source_page", F.lit(3))
    assert [r["idx"] for r in review.needs_review(tx, 0.3).collect()] == [0, 1] and review.needs_review(tx, 0.0, "discrepancy").count() == 3
    edits = spark.createDataFrame([(0, "delete", None, None), (1, "edit", "new", None), (2, "accept", None, None)], "source_index int, action string, description string, amount string")
    after, trail = review.apply_edits(tx, edits)
    rows = {r["idx"]: r for r in after.collect()}
    assert set(rows) == {1, 2} and rows[1]["description"] == "new" and rows[1]["amount"] == 1 and rows[1]["source_page"] == 3
    log = {r["row_index"]: r for r in trail.collect()}
    assert log[0]["deleted_hash"] and log[1]["before_hash"] != log[1]["after_hash"] == rows[1]["transaction_hash"] and log[2]["after_hash"] is None


def test_ledgers_and_exports(spark, tmp_path):
    tx = transactions(spark, [("A", "USD", "-4.50", day(20), None, 'Say "hi"\nnow', None, None, "Food and/Drink", "Bo"), ("A", None, "100", None, None, None)])
    books = [r["e"] for r in tx.select("idx", ledger.hledger_entry().alias("e")).orderBy("idx").collect()]
    assert books == ['2026-03-20 Say "hi" now\n    Assets:Bank:Checking    USD -4.5\n    Expenses:Food:and:Drink\n', "1970-01-01 Unknown\n    Assets:Bank:Checking    EUR 100\n    Expenses:Uncategorized\n"]
    bean = [r["e"] for r in tx.select("idx", ledger.beancount_entry().alias("e")).orderBy("idx").collect()]
    assert bean[0] == '2026-03-20 txn "Bo" "Say \\"hi\\" now"\n  Assets:Bank:Checking  -4.5 USD\n  Expenses:Food:and:Drink  4.5 USD\n'
    assert ledger.journal(tx, ["idx"]).first()["journal"] == "\n".join(books)
    ledger.write_journal(tx, str(tmp_path / "j"), ["idx"])
    export.write_csv(tx.drop("source_index"), str(tmp_path / "c"), single=True)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 2
    both = json.loads(export.summary_json(spark.createDataFrame([("A", Decimal("1.50"))], "account string, total decimal(10,2)"), tx.select("idx", "amount"), ["idx"]).first()["json"])
    assert both["summary"]["total"] == "1.50" and [t["idx"] for t in both["transactions"]] == [0, 1]
    late = spark.createDataFrame([('{"schema_version": 2}',)], "json string")
    with pytest.raises(Exception, match="schema_version"):
        export.load_result(late, "warnings array<string>").collect()
    body = spark.createDataFrame([(1,)], "x int").select(F.struct(F.lit("llm").alias("source_method"), F.lit("pdf").alias("source_format"), F.array(F.lit(1)).alias("transactions"), F.struct(F.lit("verified").alias("status"), F.lit(1).alias("expected_delta"), F.lit(1).alias("actual_delta")).alias("verification"), F.array(F.lit("w")).alias("warnings")).alias("r"))
    assert json.loads(body.select(export.rest_body(F.col("r"))).first()[0]) == {"source_method": "llm", "source_format": "pdf", "transaction_count": 1, "transactions": [1], "verification": {"status": "verified"}, "warnings": ["w"]}


def test_privacy(spark):
    df = spark.createDataFrame([("x", None, "keep", "N")], "AccountId string, BIC string, other string, DbtrNm string")
    assert tuple(privacy.mask_by_name(df).first()) == ("***REDACTED***", "***REDACTED***", "keep", "N")
    assert privacy.mask_by_name(df, parties=True).first()["DbtrNm"] == "***REDACTED***"
    assert privacy.mask_filled(df, ("BIC", "DbtrNm")).first()["BIC"] is None


def test_matching_passes_over_each_row_once(spark):
    """A group of one amount and date that differs from all: pairs would be 400 million."""
    import time

    n = 20_000
    row = lambda day: spark.range(n).select(F.lit("c").alias("case_name"), F.lit(1).cast("decimal(38,10)").alias("amount"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 3 != 0, F.date_add(F.lit(day).cast("date"), (F.col("id") % 700).cast("int"))).alias("booking_date"))
    want, have = row("2020-01-01"), row("2020-06-01")
    evaluation.match_rows(want.limit(1), have.limit(1)).collect()
    began = time.monotonic()
    got = [(r[1], r[2]) for r in evaluation.match_rows(want, have).collect()]
    assert time.monotonic() - began < 20 and len(got) == len({a for a, _ in got}) == len({b for _, b in got}) == n
    small = [(x.limit(300).select("pos", "booking_date").orderBy("pos").collect()) for x in (want, have)]
    free, expected = [tuple(r) for r in small[1]], []
    for pos, date in small[0]:
        best = next((x for x in free if date is not None and x[1] == date), free[0])
        free.remove(best)
        expected.append((pos, best[0]))
    assert sorted((r[1], r[2]) for r in evaluation.match_rows(want.where("pos < 300"), have.where("pos < 300")).collect()) == expected
