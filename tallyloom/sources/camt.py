"""CAMT.053 statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signed_by_indicator
from ..functions.amounts import MONEY_SQL, plain_amount, required, unreadable
from ..functions.text import mask
from .xml import parse_documents, parsed_once, read_documents, runs_parsed, text_of

_PARTY = "struct<Nm:string,PstlAdr:struct<AdrLine:array<string>,StrtNm:string>>"
_WHEN = "struct<Dt:string,DtTm:string>"
_AMT = "struct<_VALUE:string,_Ccy:string>"
_TX = f"struct<RltdPties:struct<Dbtr:{_PARTY},Cdtr:{_PARTY}>,RmtInf:struct<Ustrd:array<string>>,Refs:struct<EndToEndId:string>>"
_ENTRY = f"struct<Amt:{_AMT},CdtDbtInd:string,BookgDt:{_WHEN},ValDt:{_WHEN},NtryDtls:array<struct<TxDtls:array<{_TX}>>>>"
_BALANCE = f"struct<Tp:struct<CdOrPrtry:struct<Cd:string,Prtry:string>>,Amt:{_AMT},CdtDbtInd:string,Dt:{_WHEN}>"
STATEMENT = f"struct<Id:string,CreDtTm:string,Acct:struct<Id:struct<IBAN:string,Othr:struct<Id:string>>,Ccy:string>,Bal:array<{_BALANCE}>,Ntry:array<{_ENTRY}>>"
DOCUMENT = f"GrpHdr struct<MsgId:string,CreDtTm:string>, Stmt array<{STATEMENT}>"

#: Code -> name, but for the closing word.
BALANCE_CODES = dict(FWAV="Forward Available", PRCD="Previously Closed Booked", CLAV="Closing Available", CLBD="Closing Booked", OPBD="Opening Booked")


def balance_description(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in BALANCE_CODES.items() for x in (k, f"{v} balance")))
    return F.coalesce(F.try_element_at(known, code), F.lit("Unknown code"))


def statements(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(_file, stmt_index, stmt): the statements of each file in order."""
    docs = read_documents(spark, paths, "BkToCstmrStmt", DOCUMENT, strict)
    keep = ["_file"] if strict else ["_file", "_corrupt"]
    return docs.select(*keep, F.posexplode_outer("Stmt").alias("stmt_index", "stmt")).where("stmt is not null" if strict else "stmt is not null or _corrupt is not null")


def parts(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """The statements of files of any size, an entry or balance a row; the functions below take it in place of ``statements``."""
    from .large import camt_parts, listed

    return camt_parts(listed(spark, paths), strict)


def split_statements(spark: SparkSession, paths) -> DataFrame:
    """The same from files too large for one task: statements are split apart, so their order within a file isn't known."""
    names = "Id string, CreDtTm string, Acct struct<Id:struct<IBAN:string,Othr:struct<Id:string>>,Ccy:string>, " + f"Bal array<{_BALANCE}>, Ntry array<{_ENTRY}>"
    rows = read_documents(spark, paths, "Stmt", names)
    return rows.select("_file", F.lit(None).cast("int").alias("stmt_index"), F.struct("Id", "CreDtTm", "Acct", "Bal", "Ntry").alias("stmt"))


def statements_from_text(texts: DataFrame, xml: str = "xml", name: str = "_file", strict: bool = True) -> DataFrame:
    """The same from a column of whole documents."""
    body = F.regexp_extract(F.col(xml), r"(?s)(<(?:\w+:)?BkToCstmrStmt\b.*</(?:\w+:)?BkToCstmrStmt>)", 1)
    docs = parse_documents(texts, body, DOCUMENT, [name], strict)
    return docs.select(F.col(name).alias("_file"), F.posexplode("Stmt").alias("stmt_index", "stmt"))


def account_id(stmt: Column) -> Column:
    return F.coalesce(stmt["Acct"]["Id"]["IBAN"], stmt["Acct"]["Id"]["Othr"]["Id"], F.lit(""))


def _date(when: Column) -> Column:
    return F.coalesce(when["Dt"], when["DtTm"], F.lit(""))


def transactions(stmts: DataFrame, redact_pii: bool = False, statement_currency: bool = False, strict: bool = True, incomplete: str = "skip") -> DataFrame:
    """One row an entry, in order; entries without amount, currency or indicator are left out.

    ``statement_currency`` takes the account's currency where an entry has
    none.  An amount that is there but unreadable raises, or without ``strict``
    is told of in ``_fault``.  ``incomplete`` may be "raise" instead.
    """
    if "_kind" in stmts.columns:  # the parts of large files
        rows = runs_parsed(stmts.where("_kind = 'Ntry'"), "xml", "Ntry", _ENTRY, "e", "_at").where("e is not null").withColumnRenamed("_at", "_entry").drop("xml", "_kind", "_created", "error")
        return project(rows, redact_pii, statement_currency, strict, incomplete)
    # the statement's own fields first: exploded rows must not each carry the whole statement
    flat = stmts.select("_file", "stmt_index", account_id(F.col("stmt")).alias("AccountId"), F.col("stmt.Id").alias("_stmt_id"), F.col("stmt.Acct.Ccy").alias("__ccy"), F.col("stmt.Ntry").alias("__entries"))
    rows = flat.select("_file", "stmt_index", "AccountId", "_stmt_id", "__ccy", F.posexplode("__entries").alias("_entry", "e"))
    return project(rows, redact_pii, statement_currency, strict, incomplete)


def project(rows: DataFrame, redact_pii: bool = False, statement_currency: bool = False, strict: bool = True, incomplete: str = "skip") -> DataFrame:
    """The same from entries ``e`` beside their statement's (_file, stmt_index, AccountId, _stmt_id, __ccy, _entry)."""
    e = F.col("e")
    details = F.flatten(F.transform(F.coalesce(e["NtryDtls"], F.array()), lambda d: F.coalesce(d["TxDtls"], F.array())))
    rows = rows.withColumn("__d", details)
    currency = F.coalesce(e["Amt"]["_Ccy"], F.col("__ccy")) if statement_currency else e["Amt"]["_Ccy"]
    rows = rows.withColumn("__currency", currency)
    whole = e["Amt"]["_VALUE"].isNotNull() & F.col("__currency").isNotNull()
    if incomplete == "raise":
        rows = rows.withColumn("__currency", F.when(whole, F.col("__currency")).otherwise(F.raise_error(F.concat(F.lit("an entry has no amount or currency: "), F.col("_entry").cast("string"))).cast("string")))
        whole = F.col("__currency").isNotNull()
    rows = rows.where(whole & e["CdtDbtInd"].isNotNull())

    def first(path) -> Column:
        """The first value that any detail has."""
        return F.try_element_at(F.filter(F.transform("__d", path), lambda x: x.isNotNull()), F.lit(1))

    def address(party: str) -> Column:
        line = first(lambda d: F.try_element_at(d["RltdPties"][party]["PstlAdr"]["AdrLine"], F.lit(1)))
        return text_of(F.coalesce(line, first(lambda d: d["RltdPties"][party]["PstlAdr"]["StrtNm"])))

    free_text = F.concat_ws("", F.filter(F.flatten(F.transform("__d", lambda d: F.coalesce(d["RmtInf"]["Ustrd"], F.array()))), lambda x: x.isNotNull()))
    read = plain_amount(e["Amt"]["_VALUE"])
    amount = required(read, e["Amt"]["_VALUE"], "Amt") if strict else read
    faults = [] if strict else [F.coalesce(unreadable(read, e["Amt"]["_VALUE"], "Amt"), F.when(F.trim(e["Amt"]["_VALUE"]) == "", "Amt is empty")).alias("_fault")]
    cover = mask if redact_pii else (lambda c: c)
    return rows.select(
        signed_by_indicator(amount, e["CdtDbtInd"]).cast(MONEY_SQL).alias("Amount"), F.col("__currency").alias("Currency"), e["CdtDbtInd"].alias("DrCr"),
        text_of(first(lambda d: d["RltdPties"]["Dbtr"]["Nm"])).alias("Debtor"), text_of(first(lambda d: d["RltdPties"]["Cdtr"]["Nm"])).alias("Creditor"), free_text.alias("Reference"),
        _date(e["ValDt"]).alias("ValDt"), _date(e["BookgDt"]).alias("BookgDt"), "AccountId",
        cover(address("Dbtr")).alias("DebtorAddress"), cover(address("Cdtr")).alias("CreditorAddress"), "_file", "stmt_index", "_stmt_id", "_entry", *faults,
    ).withColumnRenamed("stmt_index", "_stmt_index")


def balances(stmts: DataFrame, strict: bool = True) -> DataFrame:
    """One row a balance; incomplete ones are left out, and a statement that has neither account, balance nor entry raises.  Without ``strict`` such a statement has none, and unreadable amounts are null."""
    if "_kind" in stmts.columns:
        rows = stmts.where("_kind <> 'Ntry'" if strict else "_kind = 'Bal'")
        if strict:
            rows = rows.where(F.when(F.col("_kind") == "Hollow", F.raise_error(F.lit("a statement has neither account, balance nor entry")).cast("boolean")).otherwise(F.col("_kind") == "Bal"))
        rows = parsed_once(rows, "xml", _BALANCE, "b").select("_file", F.col("stmt_index").alias("_stmt_index"), "AccountId", F.col("_at").alias("_balance"), "b")
        return _balances(rows, strict)
    s = F.col("stmt")
    hollow = s["Acct"].isNull() & s["Bal"].isNull() & s["Ntry"].isNull() & (s["Id"].isNotNull() | s["CreDtTm"].isNotNull())
    whole = stmts.withColumn("__b", s["Bal"] if not strict else F.when(hollow, F.raise_error(F.lit("a statement has neither account, balance nor entry")).cast(f"array<{_BALANCE}>")).otherwise(s["Bal"]))
    flat = whole.select("_file", F.col("stmt_index").alias("_stmt_index"), account_id(s).alias("AccountId"), "__b")
    return _balances(flat.select("_file", "_stmt_index", "AccountId", F.posexplode("__b").alias("_balance", "b")), strict)


def _balance(b: Column, strict: bool) -> tuple[Column, Column, Column, Column]:
    """(whether it is whole, its code, amount and day)."""
    day = F.coalesce(b["Dt"]["Dt"], b["Dt"]["DtTm"])
    whole = b["Amt"]["_VALUE"].isNotNull() & b["Amt"]["_Ccy"].isNotNull() & b["CdtDbtInd"].isNotNull() & day.isNotNull()
    code = F.coalesce(b["Tp"]["CdOrPrtry"]["Cd"], F.concat(F.lit("Proprietary: "), b["Tp"]["CdOrPrtry"]["Prtry"]), F.lit("N/A"))
    read = plain_amount(b["Amt"]["_VALUE"])
    return whole, code, signed_by_indicator(required(read, b["Amt"]["_VALUE"], "Amt") if strict else read, b["CdtDbtInd"]), day


def _balances(rows: DataFrame, strict: bool) -> DataFrame:
    b = F.col("b")
    whole, code, amount, day = _balance(b, strict)
    rows = rows.where(whole)
    return rows.select(amount.cast(MONEY_SQL).alias("Amount"), b["Amt"]["_Ccy"].alias("Currency"), code.alias("Code"), balance_description(code).alias("Description"), b["CdtDbtInd"].alias("DrCr"), day.alias("Date"), "AccountId", "_file", "_stmt_index", "_balance")


def stats(stmts: DataFrame) -> DataFrame:
    """One row a statement: all its entries counted, those with amount and indicator summed, and how many of them are transactions.

    Sums run over the statement's own array, so nothing is shuffled but the
    partial sums of large files' parts.
    """
    if "_kind" in stmts.columns:
        return _sums(stmts).select("StatementId", "AccountId", "StatementCreated", "NumTransactions", "NetAmount", "num_parsed", "_file", "_stmt_index")
    e = F.coalesce("stmt.Ntry", F.array().cast(f"array<{_ENTRY}>"))
    signed = F.transform(F.filter(e, lambda x: x["Amt"]["_VALUE"].isNotNull() & x["CdtDbtInd"].isNotNull()), lambda x: signed_by_indicator(required(plain_amount(x["Amt"]["_VALUE"]), x["Amt"]["_VALUE"], "Amt"), x["CdtDbtInd"]))
    net = F.aggregate(signed, F.lit(0).cast(MONEY_SQL), lambda a, x: (a + x).cast(MONEY_SQL))
    good = F.filter(e, lambda x: x["Amt"]["_VALUE"].isNotNull() & x["Amt"]["_Ccy"].isNotNull() & x["CdtDbtInd"].isNotNull())
    s = F.col("stmt")
    return stmts.select(text_of(s["Id"]).alias("StatementId"), account_id(s).alias("AccountId"), text_of(s["CreDtTm"]).alias("StatementCreated"), F.size(e).alias("NumTransactions"), net.alias("NetAmount"), F.size(good).alias("num_parsed"), "_file", F.col("stmt_index").alias("_stmt_index"))


def _sums(parts: DataFrame) -> DataFrame:
    """``stats`` of large files' parts, with the first currency and balances of each statement, in one pass."""
    kind, e, b = F.col("_kind"), F.col("e"), F.col("b")
    rows = runs_parsed(parsed_once(parts, F.when(kind == "Bal", F.col("xml")), _BALANCE, "b"), F.when(kind == "Ntry", F.col("xml")), "Ntry", _ENTRY, "e", "_at")
    value, side = e["Amt"]["_VALUE"], e["CdtDbtInd"]
    good = value.isNotNull() & e["Amt"]["_Ccy"].isNotNull() & side.isNotNull()
    amount = F.when(value.isNotNull() & side.isNotNull(), signed_by_indicator(required(plain_amount(value), value, "Amt"), side))
    whole, code, balance, _ = _balance(b, True)
    last = lambda c: text_of(F.max(F.when(kind.isin("Stmt", "Hollow"), F.col(c))))
    booked = lambda c: F.min_by(F.when(whole, balance.cast(MONEY_SQL)), F.when(whole & (code == c), F.col("_at")))
    return rows.groupBy("_file", F.col("stmt_index").alias("_stmt_index")).agg(
        last("_stmt_id").alias("StatementId"), last("AccountId").alias("AccountId"), last("_created").alias("StatementCreated"), F.count(F.when(kind == "Ntry", 1)).cast("int").alias("NumTransactions"),
        F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY_SQL).alias("NetAmount"), F.count(F.when(good, 1)).cast("int").alias("num_parsed"), F.min_by(e["Amt"]["_Ccy"], F.when(good, F.col("_at"))).alias("currency"),
        booked("OPBD").alias("opening_balance"), booked("CLBD").alias("closing_balance"), F.max(kind == "Hollow").alias("hollow"),
    )


def summary(stmts: DataFrame) -> DataFrame:
    """One row a file: its first statement's figures, first currency, first opening and closing balance."""
    if "_kind" in stmts.columns:
        at = F.col("_stmt_index")
        figures = (("AccountId", "account_id"), ("StatementCreated", "statement_date"), ("NumTransactions", "transaction_count"), ("NetAmount", "total_amount"))
        account = F.when(F.col("hollow"), F.raise_error(F.lit("a statement has neither account, balance nor entry")).cast("string")).otherwise(F.col("AccountId"))
        out = _sums(stmts).withColumn("AccountId", account).groupBy("_file").agg(*(F.min_by(c, at).alias(n) for c, n in figures), *(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("currency", "opening_balance", "closing_balance")))
        return out.withColumn("currency", F.coalesce("currency", F.lit("Unknown")))
    place = F.struct("_stmt_index")
    first = stats(stmts).groupBy("_file").agg(*(F.min_by(c, place).alias(n) for c, n in (("AccountId", "account_id"), ("StatementCreated", "statement_date"), ("NumTransactions", "transaction_count"), ("NetAmount", "total_amount"))))
    currency = transactions(stmts).groupBy("_file").agg(F.min_by("Currency", F.struct("_stmt_index", "_entry")).alias("currency"))
    at = F.struct("_stmt_index", "_balance")
    code = lambda c: F.min_by("Amount", F.when(F.col("Code") == c, at))
    booked = balances(stmts).groupBy("_file").agg(code("OPBD").alias("opening_balance"), code("CLBD").alias("closing_balance"))
    return first.join(currency, "_file", "left").join(booked, "_file", "left").withColumn("currency", F.coalesce("currency", F.lit("Unknown")))


def statement_balances(stmts: DataFrame, strict: bool = True) -> DataFrame:
    """(_file, _stmt_index, account_id, currency, opening_balance, closing_balance) for the golden rule."""
    b = balances(stmts, strict)
    pick = lambda c: F.min_by("Amount", F.when(F.col("Code") == c, F.col("_balance")))
    return b.groupBy("_file", "_stmt_index", F.col("AccountId").alias("account_id"), F.upper("Currency").alias("currency")).agg(pick("OPBD").alias("opening_balance"), pick("CLBD").alias("closing_balance"))


def statements_with_balances(stmts: DataFrame) -> DataFrame:
    """Statement figures with a map of their account's balances, code -> amount and description; of several with one code the last counts."""
    w = Window.partitionBy("AccountId", "Code").orderBy(F.desc("_file"), F.desc("_stmt_index"), F.desc("_balance"))
    last = balances(stmts).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    by_code = last.groupBy("AccountId").agg(F.map_from_entries(F.collect_list(F.struct("Code", F.struct("Amount", "Description")))).alias("balances"))
    return stats(stmts).join(by_code, "AccountId", "left")


def read_folder(spark: SparkSession, folder: str, redact_pii: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, statements, transactions) of a folder's CAMT files; a malformed file is told of in ``files`` and leaves the others alone."""
    stmts = parts(spark, folder, strict=False)
    bad = F.max(F.col("error").isNotNull())
    ends = stmts.where("error is not null or _kind in ('Stmt', 'Hollow')")
    files = ends.groupBy("_file").agg(F.when(bad, "Failed: malformed XML").otherwise("Success").alias("status"), F.when(bad, 0).otherwise(F.count("_kind")).alias("statements")).orderBy("_file")
    good = stmts.where("error is null").join(ends.where("error is not null").select("_file").distinct(), "_file", "left_anti")
    return files, statements_with_balances(good), transactions(good, redact_pii)
