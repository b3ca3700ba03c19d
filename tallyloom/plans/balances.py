"""Verification, summaries and continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import TX_SQL, load, transactions
from ..functions import signed_by_indicator, signed_difference
from ..operators import verification as v

MONEY = "decimal(38,2)"


def _balances(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """Opening balances from the customers'; closing ones fit for even accounts only, and one currency has none."""
    tx = transactions(spark, sf_dir)
    sums = tx.groupBy(*by).agg(F.sum("amount").cast(MONEY).alias("s"), F.min("idx").alias("k"))
    opening = (F.col("k") % 1000).cast(MONEY)
    closing = F.when(F.col("k") % 3 == 0, F.lit(None).cast(MONEY)).otherwise((opening + F.col("s") + F.when(F.col("k") % 2 == 0, 0).otherwise(5)).cast(MONEY))
    return sums.select(*by, opening.alias("opening_balance"), closing.alias("closing_balance"))


_B = """
b as (select {by}, cast(min(idx) % 1000 as decimal(38,2)) as opening_balance,
      case when min(idx) % 3 = 0 then null else cast(min(idx) % 1000 + sum(amount) + case when min(idx) % 2 = 0 then 0 else 5 end as decimal(38,2)) end as closing_balance
      from tx group by {by}),
t as (select {by}, cast(coalesce(sum(case when amount >= 0 then amount end), 0) as decimal(38,2)) as total_credits,
      cast(coalesce(sum(case when amount < 0 then -amount end), 0) as decimal(38,2)) as total_debits, count(*) as n_transactions from tx group by {by}),
d as (select t.*, b.opening_balance, b.closing_balance, total_credits - total_debits as actual_delta,
      cast(closing_balance - opening_balance as decimal(38,2)) as expected_delta from t left join b using ({by})),
r as (select *, cast(actual_delta - expected_delta as decimal(38,2)) as discrepancy,
      case when expected_delta is null then 'unverifiable' when abs(actual_delta - expected_delta) <= 0.01 then 'verified' else 'discrepancy' end as status from d),
v as (select *, case status when 'unverifiable' then 'Cannot verify: missing opening or closing balance' when 'verified' then 'Balance verified within tolerance'
      else 'Balance mismatch: expected delta ' || expected_delta || ', actual ' || actual_delta || ' (off by ' || discrepancy || ')' end as message from r)
"""


def golden_rule_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.verify_by_currency(transactions(spark, sf_dir), _balances(spark, sf_dir, ["currency"]), money=MONEY)


def golden_rule_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.verify_by(transactions(spark, sf_dir), _balances(spark, sf_dir, ["account_id", "currency"]), ["account_id", "currency"], money=MONEY)


def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = v.verify_by(transactions(spark, sf_dir), _balances(spark, sf_dir, ["account_id", "currency"]), ["account_id", "currency"], money=MONEY)
    out = v.aggregate_verdicts(per.withColumn("currency", F.concat("account_id", F.lit("/"), "currency")), [], "currency")
    return out.select("status", *(F.col(c).cast(MONEY).alias(c) for c in ("total_credits", "total_debits", "actual_delta")), "message")


def verify_multi_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.verify_transactions(transactions(spark, sf_dir), "0", "0", money=MONEY)
    return out.select("status", *(F.col(c).cast(MONEY).alias(c) for c in ("total_credits", "total_debits", "actual_delta")), "message")


def distinct_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.count_distinct("currency").alias("n_currencies"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statements of an account, every eleventh of which begins elsewhere and every seventh of which lacks an end."""
    tx = transactions(spark, sf_dir)
    months = tx.withColumn("label", F.date_format("booking_date", "yyyy-MM")).groupBy("account_id", "currency", "label").agg(F.sum("amount").cast(MONEY).alias("s"), F.min("idx").alias("k"))
    w = Window.partitionBy("account_id", "currency").orderBy("label")
    run = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY)
    opening = (run - F.col("s") + F.when(F.col("k") % 11 == 0, 7).otherwise(0)).cast(MONEY)
    return months.select("account_id", "currency", "label", opening.alias("opening_balance"), F.when(F.col("k") % 7 != 0, run).alias("closing_balance"))


_S = """
m as (select account_id, currency, strftime(booking_date, '%Y-%m') as label, sum(amount) as s, min(idx) as k from tx group by 1, 2, 3),
st as (select *, sum(s) over (partition by account_id, currency order by label rows unbounded preceding) as run from m),
l as (select account_id, currency, label as next_label, lag(label) over w as previous_label,
      cast(lag(case when k % 7 <> 0 then run end) over w as decimal(38,2)) as previous_closing,
      cast(run - s + case when k % 11 = 0 then 7 else 0 end as decimal(38,2)) as next_opening, row_number() over w as n
      from st window w as (partition by account_id, currency order by label)),
k as (select *, cast(next_opening - previous_closing as decimal(38,2)) as gap from l where n > 1)
"""


def continuity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = v.continuity_links(_statements(spark, sf_dir), ["label"], ["account_id", "currency"])
    return links.where("broken").select("account_id", "currency", "previous_label", "next_label", *(F.col(c).cast(MONEY).alias(c) for c in ("previous_closing", "next_opening", "gap")))


def continuity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.verify_continuity(_statements(spark, sf_dir), ["label"], ["account_id", "currency"]).select("account_id", "currency", "status", "checked_links", "unchecked_links", "n_breaks", F.when(F.col("status") != "discrepancy", F.col("message")).alias("message"))


def statement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries of an order's statement; returned ones are debits."""
    line = load(spark, sf_dir, "lineitem")
    amount = signed_by_indicator(F.col("l_extendedprice").cast("decimal(18,2)"), F.when(F.col("l_returnflag") == "R", "DBIT").otherwise("CRDT"))
    return line.groupBy("l_orderkey").agg(F.count("*").alias("num_transactions"), F.sum(amount).cast(MONEY).alias("net_amount"))


def summary_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    first, last = lambda c: F.min_by(c, "idx"), lambda c: F.max_by(c, "idx")
    return tx.groupBy("file").agg(
        first("account_id").alias("account_id"), first("currency").alias("currency"), last(F.col("value_date")).alias("statement_date"), F.count("*").alias("transaction_count"),
        F.sum("amount").cast(MONEY).alias("total_amount"), first("amount").cast(MONEY).alias("first_amount"), last("amount").cast(MONEY).alias("last_amount"),
    )


def carry_forward_last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))


def attach_to_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the last answer before the next one."""
    c = load(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = c.withColumn("entry", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("entry > 0")
    return n.groupBy("conv_id", "entry").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.max_by("text", F.when(F.col("role") != "user", F.col("turn"))).alias("answer"))


def credit_debit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return line.select("l_orderkey", "l_linenumber", signed_difference(F.when(F.col("l_returnflag") != "R", price), F.when(F.col("l_returnflag") == "R", price)).cast(MONEY).alias("amount"))


def sign_by_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    amount = signed_by_indicator(F.col("l_extendedprice").cast("decimal(18,2)"), F.when(F.col("l_linestatus") == "O", "DBIT").otherwise("CRDT"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum(amount).cast(MONEY).alias("net_amount"), F.count("*").alias("n"))


def balances_pivot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances by code, joined to their statements."""
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("ACCT-"), (F.col("c_custkey") % 40).cast("string")).alias("account_id"), F.element_at(F.array(*(F.lit(x) for x in ("OPBD", "CLBD", "CLAV"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("code"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"), "c_custkey")
    last = c.groupBy("account_id", "code").agg(F.max_by("amount", "c_custkey").alias("amount"))
    by = last.groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "amount"))).alias("m"))
    stats = transactions(spark, sf_dir).groupBy("account_id").agg(F.count("*").alias("num_transactions"))
    pick = lambda k: F.try_element_at("m", F.lit(k)).cast(MONEY).alias(k.lower())
    return stats.join(by, "account_id", "left").select("account_id", "num_transactions", pick("OPBD"), pick("CLBD"), pick("CLAV"))


def unnest_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines collected under their order and unnested again with its fields."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount")))).alias("lines"))
    o = load(spark, sf_dir, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).select("o_orderkey", "o_custkey", F.posexplode("lines").alias("pos", "l")).select("o_orderkey", "o_custkey", "pos", F.col("l.l_linenumber").alias("l_linenumber"), F.col("l.amount").cast(MONEY).alias("amount"))


def rollup_account_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).rollup("account_id", "currency").agg(F.sum("amount").cast(MONEY).alias("total"), F.count("*").alias("n"))


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("booking_date", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return transactions(spark, sf_dir).select("idx", "account_id", F.sum("amount").over(w).cast(MONEY).alias("running"))


_ROLL = ", g as (select 'Multi-currency statement — ' || string_agg(account_id || '/' || currency || ': ' || status || ' (' || message || ')', '; ' order by account_id || '/' || currency) as message, max(case status when 'verified' then 1 when 'unverifiable' then 2 when 'failed' then 3 else 4 end) as k, sum(total_credits)::decimal(38,2) as total_credits, sum(total_debits)::decimal(38,2) as total_debits, sum(actual_delta)::decimal(38,2) as actual_delta from v) select case k when 1 then 'verified' when 2 then 'unverifiable' when 3 then 'failed' else 'discrepancy' end as status, total_credits, total_debits, actual_delta, message from g"

SQL = {
    "golden_rule_by_currency": TX_SQL + "," + _B.format(by="currency") + "select * from v",
    "golden_rule_by_account": TX_SQL + "," + _B.format(by="account_id, currency") + "select * from v",
    "verdict_rollup": TX_SQL + "," + _B.format(by="account_id, currency") + _ROLL,
    "verify_multi_currency": TX_SQL + """, c as (select currency, sum(amount) filter (amount >= 0) as c, -sum(amount) filter (amount < 0) as d from tx group by 1)
        select 'unverifiable' as status, sum(c)::decimal(38,2) as total_credits, sum(d)::decimal(38,2) as total_debits, (sum(c) - sum(d))::decimal(38,2) as actual_delta,
        'Multi-currency statement — ' || string_agg(currency || ': unverifiable (Cannot verify: missing opening or closing balance)', '; ' order by currency) as message from c""",
    "distinct_currencies": TX_SQL + "select account_id, count(distinct currency) as n_currencies from tx group by 1",
    "continuity_breaks": TX_SQL + "," + _S + "select account_id, currency, previous_label, next_label, previous_closing, next_opening, gap from k where abs(gap) > 0.01",
    "continuity_verdict": TX_SQL + "," + _S + """, g as (select account_id, currency, count(gap) as c, count(*) - count(gap) as u, count(*) filter (abs(gap) > 0.01) as b from k group by 1, 2),
        a as (select a.account_id, a.currency, coalesce(c, 0) as c, coalesce(u, 0) as u, coalesce(b, 0) as b from (select distinct account_id, currency from tx) a left join g using (account_id, currency))
        select account_id, currency, case when b > 0 then 'discrepancy' when c + u = 0 or u > 0 then 'unverifiable' else 'verified' end as status, c as checked_links, u as unchecked_links, b as n_breaks,
        case when b > 0 then null when c + u = 0 then 'Cannot verify continuity: need at least two statements' when u > 0 then 'Continuity incomplete: ' || u || ' of ' || (c + u) || ' links missing a balance'
        else 'Continuity verified across ' || (c + 1) || ' statements' end as message from a""",
    "statement_stats": "select l_orderkey, count(*) as num_transactions, sum(case when l_returnflag = 'R' then -1 else 1 end * cast(l_extendedprice as decimal(18,2)))::decimal(38,2) as net_amount from lineitem group by 1",
    "summary_first_last": TX_SQL + "select file, arg_min(account_id, idx) as account_id, arg_min(currency, idx) as currency, arg_max(value_date, idx) as statement_date, count(*) as transaction_count, sum(amount)::decimal(38,2) as total_amount, arg_min(amount, idx)::decimal(38,2) as first_amount, arg_max(amount, idx)::decimal(38,2) as last_amount from tx group by 1",
    "carry_forward_last_non_null": "select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_signup from events",
    "attach_to_previous": """with n as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding)::bigint as entry from conversations)
        select conv_id, entry, arg_min(text, turn) filter (role = 'user') as question, arg_max(text, turn) filter (role <> 'user') as answer from n where entry > 0 group by 1, 2""",
    "credit_debit_merge": "select l_orderkey, l_linenumber, (case when l_returnflag = 'R' then -1 else 1 end * cast(l_extendedprice as decimal(18,2)))::decimal(38,2) as amount from lineitem",
    "sign_by_indicator": "select l_returnflag, l_linestatus, sum(case when l_linestatus = 'O' then -1 else 1 end * cast(l_extendedprice as decimal(18,2)))::decimal(38,2) as net_amount, count(*) as n from lineitem group by 1, 2",
    "balances_pivot_map": TX_SQL + """, c as (select 'ACCT-' || (c_custkey % 40)::varchar as account_id, c_custkey % 3 as code, cast(c_acctbal as decimal(18,2)) as amount, c_custkey from customer),
        l as (select account_id, code, arg_max(amount, c_custkey) as amount from c group by 1, 2), p as (select account_id, max(amount) filter (code = 0) as o, max(amount) filter (code = 1) as c, max(amount) filter (code = 2) as a from l group by 1),
        s as (select account_id, count(*) as num_transactions from tx group by 1)
        select account_id, num_transactions, o::decimal(38,2) as opbd, c::decimal(38,2) as clbd, a::decimal(38,2) as clav from s left join p using (account_id)""",
    "unnest_header_lines": "select o_orderkey, o_custkey, (row_number() over (partition by o_orderkey order by l_linenumber, cast(l_extendedprice as decimal(18,2))) - 1)::int as pos, l_linenumber, cast(l_extendedprice as decimal(38,2)) as amount from orders join lineitem on o_orderkey = l_orderkey",
    "rollup_account_currency": TX_SQL + "select account_id, currency, sum(amount)::decimal(38,2) as total, count(*) as n from tx group by rollup (account_id, currency)",
    "running_total": TX_SQL + "select idx, account_id, sum(amount) over (partition by account_id order by booking_date, idx rows unbounded preceding)::decimal(38,2) as running from tx",
}

QUERIES = {f.__name__: f for f in (golden_rule_by_currency, golden_rule_by_account, verdict_rollup, verify_multi_currency, distinct_currencies, continuity_breaks, continuity_verdict, statement_stats, summary_first_last, carry_forward_last_non_null, attach_to_previous, credit_debit_merge, sign_by_indicator, balances_pivot_map, unnest_header_lines, rollup_account_currency, running_total)}
