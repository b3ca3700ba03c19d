"""PAIN.001 payment initiations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import MONEY_SQL, plain_amount, required
from ..functions.text import mask
from .xml import parse_documents, parsed_once, read_documents

_AGENT = "struct<FinInstnId:struct<BIC:string,BICFI:string>>"
_PARTY = "struct<Nm:string,PstlAdr:struct<Ctry:string,AdrLine:array<string>>>"
_ACCOUNT = "struct<Id:struct<IBAN:string,Othr:struct<Id:string>>>"
_TRANSFER = f"struct<PmtId:struct<EndToEndId:string>,Amt:struct<InstdAmt:struct<_VALUE:string,_Ccy:string>>,CdtrAgt:{_AGENT},Cdtr:{_PARTY},CdtrAcct:{_ACCOUNT},RmtInf:struct<Ustrd:array<string>>>"
_PAYMENT = f"struct<PmtInfId:string,PmtMtd:string,BtchBookg:string,NbOfTxs:string,CtrlSum:string,ReqdExctnDt:string,Dbtr:{_PARTY},DbtrAcct:{_ACCOUNT},DbtrAgt:{_AGENT},ChrgBr:string,CdtTrfTxInf:array<{_TRANSFER}>>"
_OWN = ("PmtInfId", "PmtMtd", "NbOfTxs", "CtrlSum", "ReqdExctnDt", "Dbtr", "DbtrAcct", "DbtrAgt", "ChrgBr")
HEADER = "struct<MsgId:string,CreDtTm:string,NbOfTxs:string,InitgPty:struct<Nm:string>>"
DOCUMENT = f"GrpHdr {HEADER}, PmtInf array<{_PAYMENT}>"
_PART = f"GrpHdr {HEADER}, PmtInf {_PAYMENT}, CdtTrfTxInf array<{_TRANSFER}>"


def initiations(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """One row a file: header and payments."""
    return read_documents(spark, paths, "CstmrCdtTrfInitn", DOCUMENT, strict)


def initiations_from_text(texts: DataFrame, xml: str = "xml", name: str = "_file", strict: bool = True) -> DataFrame:
    body = F.regexp_extract(F.col(xml), r"(?s)(<(?:\w+:)?CstmrCdtTrfInitn\b.*</(?:\w+:)?CstmrCdtTrfInitn>)", 1)
    missing = F.raise_error(F.lit("missing CstmrCdtTrfInitn")).cast("string")
    return parse_documents(texts, F.when(body == "", missing).otherwise(body), DOCUMENT, [name], strict).withColumnRenamed(name, "_file")


def parts(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """Files of any size, a transfer a row; the functions below take it in place of ``initiations``."""
    from .large import listed, pain_parts

    return pain_parts(listed(spark, paths), strict)


def _rows(docs: DataFrame) -> DataFrame:
    if "_transfers" in docs.columns:  # the parts of large files
        runs = parsed_once(docs.where("_transfer is not null"), "xml", _PART, "x").select("_file", F.col("x.GrpHdr").alias("h"), "_payment", F.col("x.PmtInf").alias("p"), F.col("_transfer").alias("__first"), F.col("x.CdtTrfTxInf").alias("__run"))
        rows = runs.select("_file", "h", "_payment", "p", "__first", F.posexplode("__run").alias("__pos", "t"))
        return rows.select("_file", "h", "_payment", "p", (F.col("__first") + F.col("__pos")).alias("_transfer"), "t")
    payments = docs.select("_file", F.col("GrpHdr").alias("h"), F.posexplode("PmtInf").alias("_payment", "p"))
    # the payment without its transfers, so that exploded rows don't each carry them all
    flat = payments.select("_file", "h", "_payment", F.struct(*(F.col(f"p.{c}").alias(c) for c in _OWN)).alias("p"), F.col("p.CdtTrfTxInf").alias("__transfers"))
    return flat.select("_file", "h", "_payment", "p", F.posexplode("__transfers").alias("_transfer", "t"))


def payments(docs: DataFrame, redact_pii: bool = False) -> DataFrame:
    """One row a credit transfer with its payment's and the header's fields, all text.

    ``NbOfTxs`` is the header's, ``PmtNbOfTxs`` the payment's.
    """
    return project(_rows(docs), redact_pii)


def project(rows: DataFrame, redact_pii: bool = False) -> DataFrame:
    """The same from transfers ``t`` beside their payment ``p`` and header ``h``."""
    cover = mask if redact_pii else (lambda c: c)
    c = F.col
    return rows.select(
        c("p.PmtInfId"), c("p.PmtMtd"), c("h.NbOfTxs").alias("NbOfTxs"), c("p.NbOfTxs").alias("PmtNbOfTxs"), c("p.CtrlSum"), c("p.ReqdExctnDt"), c("p.ChrgBr"),
        cover(c("p.Dbtr.Nm")).alias("DbtrNm"), cover(F.coalesce("p.DbtrAcct.Id.IBAN", "p.DbtrAcct.Id.Othr.Id")).alias("DbtrIBAN"), F.coalesce("p.DbtrAgt.FinInstnId.BIC", "p.DbtrAgt.FinInstnId.BICFI").alias("DbtrBIC"),
        c("t.PmtId.EndToEndId").alias("EndToEndId"), c("t.Amt.InstdAmt._VALUE").alias("InstdAmt"), c("t.Amt.InstdAmt._Ccy").alias("Currency"),
        F.coalesce("t.CdtrAgt.FinInstnId.BIC", "t.CdtrAgt.FinInstnId.BICFI").alias("CdtrBIC"), cover(c("t.Cdtr.Nm")).alias("CdtrNm"), cover(c("t.CdtrAcct.Id.IBAN")).alias("CdtrIBAN"),
        F.try_element_at("t.RmtInf.Ustrd", F.lit(1)).alias("RmtInf"), c("h.MsgId").alias("MsgId"), c("h.CreDtTm").alias("CreDtTm"), cover(c("h.InitgPty.Nm")).alias("InitgPty"),
        "_file", "_payment", "_transfer",
    )


def transfers(docs: DataFrame, redact_pii: bool = False) -> DataFrame:
    """The shorter projection: creditor, exact amount, reference, address, debtor, execution date."""
    c = F.col
    address = F.concat_ws(" ", "t.Cdtr.PstlAdr.AdrLine")
    amount = c("t.Amt.InstdAmt._VALUE")
    return _rows(docs).select(
        c("t.Cdtr.Nm").alias("Name"), required(plain_amount(amount), amount, "InstdAmt").cast(MONEY_SQL).alias("Amount"), c("t.Amt.InstdAmt._Ccy").alias("Currency"),
        F.concat_ws(" ", "t.RmtInf.Ustrd").alias("Reference"), F.coalesce("t.CdtrAcct.Id.IBAN", "t.CdtrAcct.Id.Othr.Id").alias("CreditorAccount"), c("t.Cdtr.PstlAdr.Ctry").alias("Country"),
        (mask(address) if redact_pii else address).alias("Address"), c("p.Dbtr.Nm").alias("debtor_name"), F.coalesce("p.DbtrAcct.Id.IBAN", "p.DbtrAcct.Id.Othr.Id").alias("debtor_account"), c("p.ReqdExctnDt").alias("execution_date"),
        "_file", "_payment", "_transfer",
    )


def counts(docs: DataFrame) -> DataFrame:
    """(_file, batches_count, total_payments_count) from the arrays' sizes."""
    if "_transfers" in docs.columns:
        return docs.where("_transfers is not null").select("_file", F.col("_payments").alias("batches_count"), F.col("_transfers").alias("total_payments_count"))
    batches = F.coalesce(F.col("PmtInf"), F.array().cast(f"array<{_PAYMENT}>"))
    n = F.aggregate(F.transform(batches, lambda p: F.coalesce(F.size(p["CdtTrfTxInf"]), F.lit(0))), F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))
    return docs.select("_file", F.size(batches).alias("batches_count"), n.alias("total_payments_count"))


def summary(docs: DataFrame) -> DataFrame:
    """One row a file; the count is the header's, the total runs over all currencies."""
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    at = F.struct("_payment", "_transfer")
    filled = F.nullif(F.col("InstdAmt"), F.lit(""))
    amount = F.when(filled.isNotNull(), required(plain_amount(filled), filled, "InstdAmt"))
    if "_transfers" in docs.columns:
        heads = parsed_once(docs.where("_transfers is not null"), "xml", _PART, "x").select("_file", "x.GrpHdr")
    else:
        heads = docs
    sums = payments(docs).groupBy("_file").agg(F.sum(amount).cast(MONEY_SQL).alias("total_amount"), F.min_by("Currency", F.when(filled.isNotNull(), at)).alias("currency"))
    head = heads.select("_file", unknown("GrpHdr.InitgPty.Nm").alias("account_id"), unknown("GrpHdr.CreDtTm").alias("statement_date"), F.when(F.col("GrpHdr.NbOfTxs").rlike(r"^\d+$"), F.col("GrpHdr.NbOfTxs").try_cast("int")).alias("n"), unknown("GrpHdr.MsgId").alias("message_id"))
    return head.join(sums, "_file", "left").select("_file", "account_id", "statement_date", F.coalesce("n", F.lit(0)).alias("transaction_count"), F.coalesce("total_amount", F.lit(0).cast(MONEY_SQL)).alias("total_amount"), F.coalesce("currency", F.lit("Unknown")).alias("currency"), "message_id", F.col("account_id").alias("initiating_party"))
