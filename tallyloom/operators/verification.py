"""Balances: does opening plus credits less debits make closing, and do statements follow one another?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("verified", "unverifiable", "failed", "discrepancy")  # from best to worst
TOLERANCE = "0.01"
UNKNOWN = "UNKNOWN"


def currency_key(column: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(column, F.lit("")), F.lit(UNKNOWN)))


def totals(tx: DataFrame, by: list[str], money: str = "decimal(38,10)") -> DataFrame:
    """(by, total_credits, total_debits, actual_delta, n_transactions); one row without keys."""
    amount = F.col("amount").cast(money)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(money)
    credits, debits = total(F.when(amount >= 0, amount)), total(F.when(amount < 0, -amount))
    out = tx.groupBy(*by).agg(credits.alias("total_credits"), debits.alias("total_debits"), F.count("*").alias("n_transactions"))
    return out.withColumn("actual_delta", (F.col("total_credits") - F.col("total_debits")).cast(money))


def verdict(summed: DataFrame, tolerance: str = TOLERANCE, money: str = "decimal(38,10)") -> DataFrame:
    """Adds expected_delta, discrepancy, status and message to totals with opening_balance and closing_balance."""
    expected = (F.col("closing_balance").cast(money) - F.col("opening_balance").cast(money)).cast(money)
    out = summed.withColumn("expected_delta", expected).withColumn("discrepancy", (F.col("actual_delta") - F.col("expected_delta")).cast(money))
    fine = F.abs("discrepancy") <= F.lit(tolerance).cast("decimal(18,10)")
    status = F.when(F.col("discrepancy").isNull(), "unverifiable").when(fine, "verified").otherwise("discrepancy")
    text = lambda c: F.col(c).cast("string")
    mismatch = F.concat(F.lit("Balance mismatch: expected delta "), text("expected_delta"), F.lit(", actual "), text("actual_delta"), F.lit(" (off by "), text("discrepancy"), F.lit(")"))
    message = F.when(F.col("status") == "unverifiable", "Cannot verify: missing opening or closing balance").when(F.col("status") == "verified", "Balance verified within tolerance").otherwise(mismatch)
    return out.withColumn("status", status).withColumn("message", message)


def verify_balance(tx: DataFrame, opening_balance: str | None, closing_balance: str | None, tolerance: str = TOLERANCE, money: str = "decimal(38,10)") -> DataFrame:
    """The golden rule over all of ``tx``, in one row."""
    given = totals(tx, [], money).withColumns({"opening_balance": F.lit(opening_balance).cast(money), "closing_balance": F.lit(closing_balance).cast(money)})
    return verdict(given, tolerance, money)


def verify_by(tx: DataFrame, balances: DataFrame, keys: list[str], tolerance: str = TOLERANCE, money: str = "decimal(38,10)") -> DataFrame:
    """The golden rule for each key; ``balances`` has keys, opening_balance and closing_balance.  Keys without balances are unverifiable.

    The transactions are summed before the join, so only totals meet balances.
    """
    keyed = tx.withColumn("currency", currency_key(F.col("currency"))) if "currency" in keys else tx
    right = balances.withColumn("currency", currency_key(F.col("currency"))) if "currency" in keys else balances
    # several balances of one key are no reason to count its transactions twice
    right = right.groupBy(*keys).agg(*(F.min_by(c, F.struct(*right.columns)).alias(c) for c in ("opening_balance", "closing_balance")))
    return verdict(totals(keyed, keys, money).join(right, keys, "left"), tolerance, money)


def verify_by_currency(tx: DataFrame, balances: DataFrame, tolerance: str = TOLERANCE, money: str = "decimal(38,10)") -> DataFrame:
    return verify_by(tx, balances, ["currency"], tolerance, money).orderBy("currency")


def aggregate_verdicts(results: DataFrame, by: list[str] | None = None, label: str = "currency") -> DataFrame:
    """One verdict of several: the worst status, raw sums, all messages.  No rows give no verdict."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col("status"))
    detail = F.concat(F.col(label), F.lit(": "), F.col("status"), F.lit(" ("), F.col("message"), F.lit(")"))
    out = results.withColumns({"__rank": rank, "__detail": F.struct(F.col(label), detail.alias("text"))}).groupBy(*(by or [])).agg(
        F.element_at(F.array(*(F.lit(s) for s in STATUSES)), F.max("__rank").cast("int")).alias("status"),
        F.sum("total_credits").alias("total_credits"), F.sum("total_debits").alias("total_debits"), F.sum("actual_delta").alias("actual_delta"),
        F.count("*").alias("n_results"), F.array_sort(F.collect_list("__detail")).alias("__details"),
    )
    message = F.concat(F.lit("Multi-currency statement — "), F.array_join(F.col("__details.text"), "; "))
    return out.where("n_results > 0").withColumn("message", message).drop("__details", "n_results")


def verify_transactions(tx: DataFrame, opening_balance: str | None, closing_balance: str | None, tolerance: str = TOLERANCE, money: str = "decimal(38,10)") -> DataFrame:
    """The golden rule where one balance pair can hold: with several currencies nothing can be verified, and the verdict says so for each.

    Both verdicts are expressions of one small frame of totals per currency.
    """
    per = totals(tx.withColumn("currency", currency_key(F.col("currency"))), ["currency"], money)
    real = F.sum(F.when(F.col("currency") != UNKNOWN, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    marked = per.withColumn("__real", real)
    none = F.lit(None).cast(money)
    several = aggregate_verdicts(verdict(marked.where("__real > 1").withColumns({"opening_balance": none, "closing_balance": none}), tolerance, money))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(money).alias(c) for c in ("total_credits", "total_debits", "actual_delta")]
    single = per.agg(*sums, F.coalesce(F.sum(F.when(F.col("currency") != UNKNOWN, 1)), F.lit(0)).alias("__real")).where("__real <= 1")
    single = verdict(single.withColumns({"opening_balance": F.lit(opening_balance).cast(money), "closing_balance": F.lit(closing_balance).cast(money)}), tolerance, money)
    return several.unionByName(single.drop("__real"), allowMissingColumns=True)


def continuity_links(statements: DataFrame, order: list[str], by: list[str] | None = None, label: str = "label", tolerance: str = TOLERANCE) -> DataFrame:
    """(by, previous_label, next_label, previous_closing, next_opening, gap, checked, broken) of each two statements in order.

    Without ``by`` all statements are one sequence, and so one partition: give the account.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    linked = statements.select(*(by or []), F.lag(label).over(w).alias("previous_label"), F.col(label).alias("next_label"), F.lag("closing_balance").over(w).alias("previous_closing"), F.col("opening_balance").alias("next_opening"), F.row_number().over(w).alias("__n"))
    out = linked.where("__n > 1").drop("__n").withColumn("gap", F.col("next_opening") - F.col("previous_closing"))
    checked = F.col("gap").isNotNull()
    return out.withColumn("checked", checked).withColumn("broken", checked & (F.abs("gap") > F.lit(tolerance).cast("decimal(18,10)")))


def verify_continuity(statements: DataFrame, order: list[str], by: list[str] | None = None, label: str = "label", tolerance: str = TOLERANCE) -> DataFrame:
    """(by, status, checked_links, unchecked_links, n_breaks, breaks, message)."""
    keys = by or []
    links = continuity_links(statements, order, by, label, tolerance)
    broken = F.struct(*(F.col(c) for c in ("previous_label", "next_label", "previous_closing", "next_opening", "gap")))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    found = links.groupBy(*keys).agg(
        count(F.col("checked")).alias("checked_links"), count(~F.col("checked")).alias("unchecked_links"), count(F.col("broken")).alias("n_breaks"),
        F.array_sort(F.collect_list(F.when(F.col("broken"), broken))).alias("breaks"),
    )
    if keys:  # keys of a single statement have no link but a verdict
        found = statements.select(*keys).distinct().join(found, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("checked_links", "unchecked_links", "n_breaks")}).withColumn("breaks", F.coalesce("breaks", F.slice(F.array(F.lit(None).cast(found.schema["breaks"].dataType.elementType)), 1, 0)))
    links_ = F.col("checked_links") + F.col("unchecked_links")
    status = F.when(F.col("n_breaks") > 0, "discrepancy").when((links_ == 0) | (F.col("unchecked_links") > 0), "unverifiable").otherwise("verified")
    s = lambda c: c.cast("string")
    told = F.transform("breaks", lambda b: F.concat(s(b["previous_label"]), F.lit(" closed at "), s(b["previous_closing"]), F.lit(" but "), s(b["next_label"]), F.lit(" opened at "), s(b["next_opening"]), F.lit(" (gap "), s(b["gap"]), F.lit(")")))
    message = (
        F.when(F.col("status") == "discrepancy", F.concat(F.lit("Continuity broken: "), F.array_join(told, "; ")))
        .when(links_ == 0, "Cannot verify continuity: need at least two statements")
        .when(F.col("status") == "unverifiable", F.concat(F.lit("Continuity incomplete: "), s(F.col("unchecked_links")), F.lit(" of "), s(links_), F.lit(" links missing a balance")))
        .otherwise(F.concat(F.lit("Continuity verified across "), s(F.col("checked_links") + 1), F.lit(" statements")))
    )
    return found.withColumn("status", status).withColumn("message", message)
