"""Readers on files that are written from the driver's orders: what is read must be what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import TX_SQL, transactions
from ..sources import camt, flat, large, pain001
from .streams import shared_folder

MONEY = "decimal(38,2)"


def _abs() -> Column:
    return F.abs("amount").cast("string")


#: The order of a document's pieces.
ORDER = ["place", "idx", "text"]


def pieces(tx: DataFrame, line: Column, per: DataFrame, head: Column, tail: Column | None = None) -> DataFrame:
    """(_file, place, idx, text): a document for each account as lines, so that none is held whole; ``head`` and ``tail`` are of ``per``'s columns."""
    ends = per.select("account_id", F.posexplode(F.array(head, F.lit(None).cast("string"), F.when(head.isNotNull(), tail) if tail is not None else F.lit(None).cast("string"))).alias("place", "text"))
    rows = tx.select(F.col("account_id").alias("_file"), F.lit(1).alias("place"), "idx", line.alias("text"))
    out = rows.unionByName(ends.select(F.col("account_id").alias("_file"), "place", F.lit(None).cast("bigint").alias("idx"), "text"))
    return out.where("_file is not null and text is not null")


def streamed(documents: DataFrame) -> DataFrame:
    """Pieces as the readers take them."""
    return large.in_order(documents.withColumn("text", F.concat("text", F.lit("\n"))), ORDER)


def camt_pieces(tx: DataFrame) -> DataFrame:
    """A statement for each account, with opening and closing balance."""
    side = F.when(F.col("amount") < 0, "DBIT").otherwise("CRDT")
    entry = F.concat(
        F.lit("<Ntry><Amt Ccy=\""), "currency", F.lit('">'), _abs(), F.lit("</Amt><CdtDbtInd>"), side, F.lit("</CdtDbtInd><BookgDt><Dt>"), F.col("booking_date").cast("string"), F.lit("</Dt></BookgDt><ValDt><Dt>"), F.col("value_date").cast("string"),
        F.lit("</Dt></ValDt><NtryDtls><TxDtls><RltdPties><Dbtr><Nm>"), "priority", F.lit("</Nm></Dbtr></RltdPties><RmtInf><Ustrd>"), F.col("idx").cast("string"), F.lit("</Ustrd></RmtInf></TxDtls></NtryDtls></Ntry>"),
    )
    balance = lambda code, amount: F.concat(F.lit(f"<Bal><Tp><CdOrPrtry><Cd>{code}</Cd></CdOrPrtry></Tp><Amt Ccy=\""), F.col("currency"), F.lit('">'), F.abs(amount).cast("string"), F.lit("</Amt><CdtDbtInd>"), F.when(amount < 0, "DBIT").otherwise("CRDT"), F.lit("</CdtDbtInd><Dt><Dt>2020-01-01</Dt></Dt></Bal>"))
    per = tx.groupBy("account_id").agg(F.first("currency").alias("currency"), F.sum("amount").cast(MONEY).alias("net"))
    head = F.concat(F.lit('<Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><GrpHdr><MsgId>M</MsgId></GrpHdr><Stmt><Id>S1</Id><CreDtTm>2020-01-01T00:00:00</CreDtTm><Acct><Id><Othr><Id>'), "account_id", F.lit("</Id></Othr></Id></Acct>"), balance("OPBD", F.lit(100).cast(MONEY)), balance("CLBD", (F.col("net") + 100).cast(MONEY)))
    return pieces(tx, entry, per, head, F.lit("</Stmt></BkToCstmrStmt></Document>"))


def _camt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large.camt_parts(streamed(camt_pieces(transactions(spark, sf_dir))))


def camt_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = camt.transactions(_camt(spark, sf_dir))
    return out.select(F.col("Reference").cast("bigint").alias("idx"), F.col("AccountId").alias("account_id"), F.col("Currency").alias("currency"), F.col("Amount").cast(MONEY).alias("amount"), F.to_date("BookgDt").alias("booking_date"), F.to_date("ValDt").alias("value_date"), F.col("Debtor").alias("debtor"))


def camt_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camt.balances(_camt(spark, sf_dir)).select(F.col("AccountId").alias("account_id"), F.col("Code").alias("code"), F.col("Amount").cast(MONEY).alias("amount"), F.col("Description").alias("description"))


def camt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camt.stats(_camt(spark, sf_dir)).select(F.col("AccountId").alias("account_id"), F.col("NumTransactions").cast("bigint").alias("n"), F.col("NetAmount").cast(MONEY).alias("net"))


def camt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camt.summary(_camt(spark, sf_dir)).select("account_id", F.col("transaction_count").cast("bigint").alias("n"), *(F.col(c).cast(MONEY).alias(c) for c in ("total_amount", "opening_balance", "closing_balance")), "currency")


def camt_golden_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in, verdicts out."""
    from ..operators import normalize, verification

    stmts = _camt(spark, sf_dir)
    tx = normalize.normalize(camt.transactions(stmts))
    out = verification.verify_by(tx, camt.statement_balances(stmts), ["account_id", "currency"])
    return out.select("account_id", "currency", "status", F.col("actual_delta").cast(MONEY).alias("actual_delta"))


def _pain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    one = F.concat(F.lit("<CdtTrfTxInf><PmtId><EndToEndId>"), F.col("idx").cast("string"), F.lit('</EndToEndId></PmtId><Amt><InstdAmt Ccy="'), "currency", F.lit('">'), _abs(), F.lit("</InstdAmt></Amt><Cdtr><Nm>"), "priority", F.lit("</Nm></Cdtr></CdtTrfTxInf>"))
    per = tx.groupBy("account_id").agg(F.count("*").alias("n"))
    head = F.concat(F.lit("<Document><CstmrCdtTrfInitn><GrpHdr><MsgId>M</MsgId><NbOfTxs>"), F.col("n").cast("string"), F.lit("</NbOfTxs><InitgPty><Nm>Ada</Nm></InitgPty></GrpHdr><PmtInf><PmtInfId>P</PmtInfId><DbtrAcct><Id><IBAN>"), "account_id", F.lit("</IBAN></Id></DbtrAcct>"))
    return large.pain_parts(streamed(pieces(tx, one, per, head, F.lit("</PmtInf></CstmrCdtTrfInitn></Document>"))))


def pain_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pain001.payments(_pain(spark, sf_dir)).select(F.col("EndToEndId").cast("bigint").alias("idx"), F.col("DbtrIBAN").alias("account_id"), F.col("InstdAmt").alias("amount"), F.col("Currency").alias("currency"), F.col("CdtrNm").alias("creditor"), F.col("NbOfTxs").alias("n"))


def pain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pain001.summary(_pain(spark, sf_dir)).select("_file", F.col("transaction_count").cast("bigint").alias("n"), F.col("total_amount").cast(MONEY).alias("total"), "initiating_party").withColumnRenamed("_file", "account_id")


def _texts(spark: SparkSession, sf_dir: str, line: Column, head: Column, tail: Column | None = None) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return pieces(tx, line, tx.groupBy("account_id").agg(F.first("currency").alias("currency")), head, tail)


def ofx_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<STMTTRN>\n<TRNTYPE>X\n<DTPOSTED>"), F.date_format("booking_date", "yyyyMMdd"), F.lit("120000\n<TRNAMT>"), F.col("amount").cast("string"), F.lit("\n<FITID>"), F.col("idx").cast("string"), F.lit("\n<NAME>"), F.col("priority"), F.when(F.col("idx") % 2 == 0, "\n</STMTTRN>").otherwise(""))
    files = _texts(spark, sf_dir, line, F.concat(F.lit("<OFX><CURDEF>"), "currency", F.lit("\n<ACCTID>"), "account_id", F.lit("\n<BANKTRANLIST>")), F.lit("</BANKTRANLIST></OFX>"))
    return flat.ofx_transactions(streamed(files)).select(F.col("transaction_id").cast("bigint").alias("idx"), "account_id", "currency", F.col("amount").cast(MONEY).alias("amount"), F.col("date"), "description")


def mt940_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit(":61:"), F.date_format("booking_date", "yyMMdd"), F.when(F.col("amount") < 0, "D").otherwise("C"), F.replace(_abs(), F.lit("."), F.lit(",")), F.lit("NTRF"), F.col("idx").cast("string"), F.lit("\n:86:"), F.col("priority"))
    files = _texts(spark, sf_dir, line, F.concat(F.lit(":20:X\n:25:"), "account_id", F.lit("\n:60F:C200101"), "currency", F.lit("0,00")), F.lit(":62F:C200131EUR1,00"))
    return flat.mt940_transactions(streamed(files)).select(F.substring("transaction_id", 5, 20).cast("bigint").alias("idx"), "account_id", "currency", F.col("amount").cast(MONEY).alias("amount"), F.pmod(F.year("date"), F.lit(100)).cast("int").alias("yy"), "description")


def csv_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dialects, written to the shared folder and read together."""
    folder = shared_folder(spark)
    tx = transactions(spark, sf_dir)
    local = F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))
    even, odd = tx.where("idx % 2 = 0"), tx.where("idx % 2 = 1")
    even.select(F.col("booking_date").cast("string").alias("Buchungstag"), F.col("priority").alias("Verwendungszweck"), local.alias("Betrag"), F.col("currency").alias("CCY"), F.col("account_id").alias("IBAN"), F.col("idx").alias("Ref")).write.option("header", True).option("sep", ";").csv(f"{folder}/a")
    side = lambda sign: F.when(sign, _abs()).otherwise("")
    odd.select(F.col("booking_date").cast("string").alias("Date"), F.col("priority").alias("Details"), side(F.col("amount") >= 0).alias("Credit"), side(F.col("amount") < 0).alias("Debit"), F.col("currency").alias("Currency"), F.col("account_id").alias("Account"), F.col("idx").alias("Reference")).write.option("header", True).csv(f"{folder}/b")
    out = flat.csv_transactions(spark, [f"{folder}/a", f"{folder}/b"])
    return out.select(F.col("transaction_id").cast("bigint").alias("idx"), "account_id", "currency", F.col("amount").cast(MONEY).alias("amount"), "date", "description")


_ALL = TX_SQL + "select idx, account_id, currency, amount::decimal(38,2) as amount, {more} from tx"
SQL = {
    "camt_transactions": _ALL.format(more="booking_date, value_date, priority as debtor"),
    "camt_balances": TX_SQL + "select account_id, 'OPBD' as code, 100::decimal(38,2) as amount, 'Opening Booked balance' as description from tx group by 1 union all select account_id, 'CLBD', (100 + sum(amount))::decimal(38,2), 'Closing Booked balance' from tx group by 1",
    "camt_stats": TX_SQL + "select account_id, count(*) as n, sum(amount)::decimal(38,2) as net from tx group by 1",
    "camt_summary": TX_SQL + "select account_id, count(*) as n, sum(amount)::decimal(38,2) as total_amount, 100::decimal(38,2) as opening_balance, (100 + sum(amount))::decimal(38,2) as closing_balance, arg_min(currency, idx) as currency from tx group by 1",
    "camt_golden_rule": TX_SQL + "select account_id, currency, 'verified' as status, sum(amount)::decimal(38,2) as actual_delta from tx group by 1, 2",
    "pain_payments": TX_SQL + "select idx, account_id, abs(amount)::varchar as amount, currency, priority as creditor, (count(*) over (partition by account_id))::varchar as n from tx",
    "pain_summary": TX_SQL + "select account_id, count(*) as n, sum(abs(amount))::decimal(38,2) as total, 'Ada' as initiating_party from tx group by 1",
    "ofx_transactions": _ALL.format(more="strftime(booking_date, '%Y%m%d') as date, priority as description"),
    "mt940_transactions": _ALL.format(more="(year(booking_date) % 100)::int as yy, priority as description"),
    "csv_transactions": _ALL.format(more="booking_date::varchar as date, priority as description"),
}

QUERIES = {f.__name__: f for f in (camt_transactions, camt_balances, camt_stats, camt_summary, camt_golden_rule, pain_payments, pain_summary, ofx_transactions, mt940_transactions, csv_transactions)}
