"""Readers and scans on real files: the driver's orders written as files of a folder, some of them spoilt, and read from there."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import TX_SQL, load, transactions
from ..operators import payload, review
from ..sources import archives, camt, flat, large, pain001, registry
from .files import MONEY, ORDER, _abs, _pain, _texts, camt_pieces, streamed
from .streams import shared_folder

#: Every so manyth account's file is spoilt.
_BAD = "cast(substr(account_id, 6) as int) % 10 = 3"


def write_files(pieces: DataFrame, folder: str, suffix: str = "") -> str:
    """``folder`` with one file for each ``_file`` of some pieces, a line each: a few dozen files, as they are renamed one by one."""
    spark = pieces.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    parts = path(f"{folder}-parts-{uuid.uuid4().hex}")
    # a name that may be null would be wrapped, and the rows sorted again by it alone
    rows = pieces.select(F.coalesce(F.concat("_file", F.lit(suffix)), F.lit("")).alias("name"), *ORDER)
    rows.repartition("name").sortWithinPartitions("name", *ORDER).select("name", "text").write.partitionBy("name").text(parts.toString())
    system = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    for place in system.listStatus(parts):
        if place.isDirectory():
            (one,) = [f.getPath() for f in system.listStatus(place.getPath()) if f.getPath().getName().startswith("part-")]
            system.rename(one, path(f"{folder}/{place.getPath().getName().removeprefix('name=')}"))
    system.delete(parts, True)
    return folder


def _name(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+)$", 1)


def _spoil(pieces: DataFrame) -> DataFrame:
    """Pieces of which every tenth account's end in the middle of their text."""
    bad = F.expr(_BAD.replace("account_id", "_file"))
    size = F.length("text").cast("bigint")
    total = pieces.where(bad).groupBy("_file").agg(F.sum(size).alias("total"))
    before = F.sum(size).over(Window.partitionBy("_file").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    rows = pieces.where(bad).withColumn("before", before).join(F.broadcast(total), "_file")  # a row an account
    left = F.expr("cast(total div 2 - before as int)")
    return pieces.where(~bad).unionByName(rows.where(left > 0).select("_file", "place", "idx", F.substr("text", F.lit(1), left).alias("text")))


def camt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of statements by its reader, one scan."""
    folder = write_files(camt_pieces(transactions(spark, sf_dir)), shared_folder(spark), ".xml")
    out = registry.read_statement(spark, f"{folder}/*.xml", "camt")
    return out.select(F.col("Reference").cast("bigint").alias("idx"), F.col("AccountId").alias("account_id"), F.col("Amount").cast(MONEY).alias("amount"), F.to_date("BookgDt").alias("booking_date"), F.regexp_replace(_name(F.col("_file")), ".xml$", "").alias("file"))


def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters, quotes and line breaks within quotes, beside a file without any."""
    folder = shared_folder(spark)
    tx = transactions(spark, sf_dir)
    words = F.concat(F.lit('first line,\nsecond "line"; '), "priority", F.lit("\n\nlast "), F.col("idx").cast("string"))
    for name, rows, text in (("a", tx.where("idx % 2 = 0"), words), ("b", tx.where("idx % 2 = 1"), F.col("priority"))):
        rows.select(F.col("booking_date").cast("string").alias("Date"), text.alias("Description"), F.col("amount").cast("string").alias("Amount"), F.col("idx").alias("Id")).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    out = flat.csv_transactions(spark, [f"{folder}/a", f"{folder}/b"])
    return out.select(F.col("transaction_id").cast("bigint").alias("idx"), F.col("amount").cast(MONEY).alias("amount"), "date", "description")


def mt940_long_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of over 10,000 characters, of one transaction in ten, from files."""
    narrative = F.concat(F.expr("repeat(concat(priority, '+'), case when idx % 10 = 0 then 1200 else 1 end)"), F.col("idx").cast("string"))
    line = F.concat(F.lit(":61:"), F.date_format("booking_date", "yyMMdd"), F.when(F.col("amount") < 0, "D").otherwise("C"), F.replace(_abs(), F.lit("."), F.lit(",")), F.lit("NTRF"), F.col("idx").cast("string"), F.lit("\n:86:"), narrative)
    files = _texts(spark, sf_dir, line.alias("line"), F.concat(F.lit(":20:X\n:25:"), "account_id", F.lit("\n:60F:C200101"), "currency", F.lit("0,00")), F.lit(":62F:C200131EUR1,00"))
    folder = write_files(files, shared_folder(spark), ".sta")
    out = registry.read_statement(spark, f"{folder}/*.sta", "mt940")
    return out.select(F.substring("transaction_id", 5, 20).cast("bigint").alias("idx"), "account_id", F.length("description").alias("n"), F.md5(F.col("description").cast("binary")).alias("digest"))


def _spoilt(spark: SparkSession, sf_dir: str) -> str:
    """Good and malformed statements, a copy of some under later names, a CSV with a bad amount and one without amounts, and a text that is no statement."""
    tx = transactions(spark, sf_dir)
    files = _spoil(camt_pieces(tx))
    again = camt_pieces(tx.where("account_id in ('ACCT-1', 'ACCT-2')"))
    named = lambda df, name: df.withColumn("_file", name)
    odd = spark.createDataFrame([("bad.csv", 0, None, "Date,Description,Amount\n2024-01-01,x,1.00\n2024-01-02,y,1..5"), ("none.csv", 0, None, "Date,Description\n2024-01-01,x"), ("notes.txt", 0, None, "no statement at all")], "_file string, place int, idx bigint, text string")
    return write_files(named(files, F.concat("_file", F.lit(".xml"))).unionByName(named(again, F.concat(F.lit("Z"), "_file", F.lit(".xml")))).unionByName(odd), shared_folder(spark))


def scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder that give no rows."""
    found = registry.scan(spark, _spoilt(spark, sf_dir))
    return found.failures.select(_name(F.col("_file")).alias("file"))


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a spoilt folder's good files; of a statement that two files hold the first one's are new."""
    found = registry.scan(spark, _spoilt(spark, sf_dir))
    return found.transactions.select(_name(F.col("_file")).alias("file"), F.col("amount").cast(MONEY).alias("amount"), F.col("booking_date").cast("date").alias("booking_date"), F.col("source_index").cast("int").alias("source_index"), "is_new")


def scan_folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.scan(spark, _spoilt(spark, sf_dir)).totals()


def scan_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balances that a scan holds against each other from file to file."""
    found = registry.scan(spark, _spoilt(spark, sf_dir))
    return found.balances.select(_name(F.col("_file")).alias("file"), "account_id", F.col("opening_balance").cast(MONEY).alias("opening_balance"), F.col("closing_balance").cast(MONEY).alias("closing_balance"))


def parse_files_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of several files by itself, malformed and missing ones among them."""
    folder = _spoilt(spark, sf_dir)
    _, status = registry.parse_files(spark, [f"{folder}/{n}" for n in ("ACCT-5.xml", "ACCT-3.xml", "ACCT-13.xml", "gone.xml", "bad.csv", "ACCT-1.xml")])
    return status.select(_name(F.col("_file")).alias("file"), "path_idx", "status")


def camt_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_files(_spoil(camt_pieces(transactions(spark, sf_dir))), shared_folder(spark), ".xml")
    files, _, _ = camt.read_folder(spark, folder)
    return files.select(_name(F.col("_file")).alias("file"), F.split("status", ":")[0].alias("status"), "statements")


def zip_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements out of ZIP archives, and why a member gives none."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, stream in large.streams(batches, True):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                with archive.open(f"{name}.xml", "w", force_zip64=True) as member:
                    while piece := stream.read():
                        member.write(piece)
                archive.writestr("readme.txt", "not read")
                archive.writestr("empty.xml", "")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data.getvalue()])], names=["path", "content"])

    files = streamed(camt_pieces(transactions(spark, sf_dir))).mapInArrow(packed, "path string, content binary")
    # text of like entries packs by more than the guard's ratio
    members = archives.camt_parts(files, max_ratio=1e9)
    rows = camt.transactions(members.where("error is null"))
    good = rows.groupBy("_file").agg(F.count("*").alias("n"), F.sum("Amount").cast(MONEY).alias("total"))
    bad = members.where("error is not null").groupBy("_file").agg(F.min("member").alias("refused"), F.min("error").alias("error"))
    return good.join(bad, "_file").withColumnRenamed("_file", "account_id")


def _summaries(spark: SparkSession, folder: str, name: str) -> DataFrame:
    out = registry.FORMATS[name].summary(spark, folder)
    return out.select("account_id", F.col("transaction_count").cast("bigint").alias("n"), F.col("total_amount").cast(MONEY).alias("total"), "currency")


def ofx_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<STMTTRN>\n<TRNTYPE>X\n<DTPOSTED>"), F.date_format("booking_date", "yyyyMMdd"), F.lit("\n<TRNAMT>"), F.col("amount").cast("string"), F.lit("\n<FITID>"), F.col("idx").cast("string"), F.lit("\n</STMTTRN>"))
    files = _texts(spark, sf_dir, line, F.concat(F.lit("<OFX><CURDEF>"), "currency", F.lit("\n<ACCTID>"), "account_id", F.lit("\n<BANKTRANLIST>")), F.lit("</BANKTRANLIST></OFX>"))
    return _summaries(spark, write_files(files, shared_folder(spark), ".ofx"), "ofx")


def mt940_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit(":61:"), F.date_format("booking_date", "yyMMdd"), F.when(F.col("amount") < 0, "D").otherwise("C"), F.replace(_abs(), F.lit("."), F.lit(",")), F.lit("NTRF"), F.col("idx").cast("string"))
    files = _texts(spark, sf_dir, line, F.concat(F.lit(":20:X\n:25:"), "account_id", F.lit("\n:60F:C200101"), "currency", F.lit("0,00")), F.concat(F.lit(":62F:D200131"), "currency", F.lit("12,50")))
    folder = write_files(files, shared_folder(spark), ".mt940")
    out = registry.FORMATS["mt940"].summary(spark, folder)
    return out.select("account_id", F.col("transaction_count").cast("bigint").alias("n"), F.col("total_amount").cast(MONEY).alias("total"), "currency", F.col("opening_balance").cast(MONEY).alias("opening_balance"), F.col("closing_balance").cast(MONEY).alias("closing_balance"))


def csv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an account, with a running balance of its row numbers."""
    row = F.concat_ws(",", F.col("booking_date").cast("string"), "priority", F.col("amount").cast("string"), "currency", "account_id", F.col("idx").cast("string"))
    files = _texts(spark, sf_dir, row, F.lit("Date,Details,Amount,Currency,Account,Balance"))
    folder = write_files(files, shared_folder(spark), ".csv")
    out = registry.FORMATS["csv"].summary(spark, folder)
    return out.select("account_id", F.col("transaction_count").cast("bigint").alias("n"), F.col("total_amount").cast(MONEY).alias("total"), "currency", F.col("opening_balance").cast(MONEY).alias("opening_balance"), F.col("closing_balance").cast(MONEY).alias("closing_balance"))


def pain_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pain001.payments(_pain(spark, sf_dir), redact_pii=True)
    return out.select(F.col("EndToEndId").cast("bigint").alias("idx"), F.col("DbtrIBAN").alias("account"), F.col("CdtrNm").alias("creditor"), F.col("InitgPty").alias("party"), F.col("Currency").alias("currency"))


def pain_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pain001.transfers(_pain(spark, sf_dir))
    return out.select(F.col("Name").alias("name"), F.col("Amount").cast(MONEY).alias("amount"), F.col("Currency").alias("currency"), "debtor_account", F.col("_transfer").alias("place"))


def pain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pain001.counts(_pain(spark, sf_dir)).withColumnRenamed("_file", "account_id")


def bbox_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that lie on their page, of boxes made from the events' numbers."""
    e = load(spark, sf_dir, "events")
    part = lambda k: (F.col("event_id") % k).cast("double") / (k - 2)
    box = F.struct(part(7).alias("x0"), part(11).alias("y0"), part(13).alias("x1"), part(17).alias("y1"), F.when(F.col("event_id") % 19 != 0, (F.col("event_id") % 5 - 1).cast("int")).alias("page_index"))
    return e.select("event_id", payload.valid_box(box).alias("valid"))


def statement_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a statement that isn't verified; of a verified one those of low confidence."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "toxic", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 100) / 100.0).alias("confidence"))
    return review.needs_review(lab.where("toxic = 1"), 0.5, "discrepancy").unionByName(review.needs_review(lab.where("toxic = 0"), 0.5, "verified")).select("doc_id", "toxic")


_GOOD = f"not ({_BAD})"
_SIDES = """, f as (select * exclude (file), account_id || '.xml' as file from tx where {good} union all select * exclude (file), 'Z' || account_id || '.xml' from tx where account_id in ('ACCT-1', 'ACCT-2'))"""
_PER = TX_SQL + "select account_id, count(*) as n, sum(amount)::decimal(38,2) as total, arg_min(currency, idx) as currency{more} from tx group by 1"
SQL = {
    "camt_files": TX_SQL + "select idx, account_id, amount::decimal(38,2) as amount, booking_date, account_id as file from tx",
    "csv_quoted": TX_SQL + "select idx, amount::decimal(38,2) as amount, booking_date::varchar as date, case when idx % 2 = 0 then 'first line,' || chr(10) || 'second \"line\"; ' || priority || chr(10) || chr(10) || 'last ' || idx else priority end as description from tx",
    "mt940_long_narrative": TX_SQL + ", n as (select idx, account_id, repeat(priority || '+', case when idx % 10 = 0 then 1200 else 1 end) || idx as d from tx) select idx, account_id, length(d)::int as n, md5(d) as digest from n",
    "scan_quarantine": TX_SQL + f"select distinct account_id || '.xml' as file from tx where {_BAD} union all select unnest(['bad.csv', 'none.csv', 'notes.txt'])",
    "scan_folder": TX_SQL + _SIDES.format(good=_GOOD) + " select file, amount::decimal(38,2) as amount, booking_date, (row_number() over (partition by file order by idx) - 1)::int as source_index, not starts_with(file, 'Z') as is_new from f",
    "scan_folder_totals": TX_SQL + _SIDES.format(good=_GOOD) + " select count(*) filter (not starts_with(file, 'Z')) as total_unique, count(*) filter (starts_with(file, 'Z')) as total_skipped, count(distinct file) as file_count from f",
    "scan_balances": TX_SQL + _SIDES.format(good=_GOOD) + " select file, account_id, 100::decimal(38,2) as opening_balance, (100 + sum(amount))::decimal(38,2) as closing_balance from f group by 1, 2",
    "parse_files_status": "select * from (values ('ACCT-5.xml', 0, 'SUCCESS'), ('ACCT-3.xml', 1, 'FAILED'), ('ACCT-13.xml', 2, 'FAILED'), ('gone.xml', 3, 'FAILED'), ('bad.csv', 4, 'FAILED'), ('ACCT-1.xml', 5, 'SUCCESS')) as t(file, path_idx, status)",
    "camt_folder": TX_SQL + f"select distinct account_id || '.xml' as file, case when {_BAD} then 'Failed' else 'Success' end as status, case when {_BAD} then 0 else 1 end::bigint as statements from tx",
    "zip_transactions": TX_SQL + "select account_id, count(*) as n, sum(amount)::decimal(38,2) as total, 'empty.xml' as refused, 'empty' as error from tx group by 1",
    "ofx_summary": _PER.format(more=""),
    "mt940_summary": _PER.format(more=", 0::decimal(38,2) as opening_balance, -12.50::decimal(38,2) as closing_balance"),
    "csv_summary": _PER.format(more=", min(idx)::decimal(38,2) as opening_balance, max(idx)::decimal(38,2) as closing_balance"),
    "pain_masked": TX_SQL + "select idx, '***REDACTED***' as account, '***REDACTED***' as creditor, '***REDACTED***' as party, currency from tx",
    "pain_transfers": TX_SQL + "select priority as name, abs(amount)::decimal(38,2) as amount, currency, account_id as debtor_account, (row_number() over (partition by account_id order by idx) - 1)::int as place from tx",
    "pain_counts": TX_SQL + "select account_id, 1 as batches_count, count(*)::int as total_payments_count from tx group by 1",
    "bbox_valid": """with b as (select event_id, (event_id % 7) / 5.0::double as x0, (event_id % 11) / 9.0::double as y0, (event_id % 13) / 11.0::double as x1, (event_id % 17) / 15.0::double as y1, case when event_id % 19 <> 0 then event_id % 5 - 1 end as p from events)
        select event_id, coalesce(x0 <= 1 and y0 <= 1 and x1 <= 1 and y1 <= 1 and x0 <= x1 and y0 <= y1 and p >= 0, false) as valid from b""",
    "statement_review": "select doc_id, toxic from labels where toxic = 1 or (toxic = 0 and doc_id % 4 <> 0 and doc_id % 100 < 50)",
}

QUERIES = {
    f.__name__: f
    for f in (
        camt_files, csv_quoted, mt940_long_narrative, scan_quarantine, scan_folder, scan_folder_totals, scan_balances, parse_files_status, camt_folder, zip_transactions,
        ofx_summary, mt940_summary, csv_summary, pain_masked, pain_transfers, pain_counts, bbox_valid, statement_review,
    )
}
