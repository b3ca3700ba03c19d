"""OFX/QFX, MT940 and delimited text."""

from __future__ import annotations

import csv
import re
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exceptions import FormatError
from ..functions import fold_header, locale_amount, signed_difference
from ..functions.amounts import MONEY_SQL, required, unreadable
from ..functions.dates import short_year_date
from .large import parsed

# ---- whole files


def whole_files(spark: SparkSession, paths) -> DataFrame:
    """(_file, value): each file's text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")


def _streamed(files: DataFrame, units: Callable, names: list[str], schema: str) -> DataFrame:
    """(_file, *names) of files (path), whole texts (_file, value) or ordered pieces (_file, text), read as streams in constant memory."""
    source = files.where("value is not null").select("_file", F.col("value").alias("text")) if "value" in files.columns else files
    return parsed(source, units, names, schema).drop("error")


# ---- OFX

#: A transaction ends at the first of these after its tag; one that none of them ends is none.
_OFX_TAGS = (b"DTPOSTED", b"MEMO", b"NAME", b"TRNAMT", b"FITID", b"TRNTYPE")
_OFX_LEAF = re.compile(rb"(?i)<(" + b"|".join(_OFX_TAGS) + rb")>([^<\r\n]+)")
_OFX_MARK = re.compile(rb"(?i)<STMTTRN>|</STMTTRN>|</BANKTRANLIST>")


def ofx_tag(text: Column, tag: str) -> Column:
    """Trimmed value of a leaf's first occurrence; null if it has none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i)<{tag}>([^<\r\n]+)", 1)), F.lit(""))


class _Blocks:
    """(currency, account_id, entry, *tags) of an OFX file: the first values that it has of the former two, wherever they stand, and the first of each tag within a transaction."""

    @staticmethod
    def head(stream: BinaryIO, tags: tuple[bytes, ...] = (b"CURDEF", b"ACCTID")) -> list[str | None]:
        """The first value of each tag; reads no further than to the last of them."""
        seek = {t: re.compile(rb"(?i)<" + t + rb">([^<\r\n]+)") for t in tags}
        found: dict[bytes, bytes] = {}
        rest = b""
        while len(found) < len(tags):
            data = stream.read(1 << 16)
            text = rest + data
            for t, pattern in seek.items():
                if t not in found and (hit := pattern.search(text)) and (hit.end() < len(text) or not data):
                    found[t] = hit[1]
            if not data:
                break
            at = text.rfind(b"<")
            rest = text[at:] if at >= 0 and (len(text) - at < 32 or any(p.match(text, at) for p in seek.values())) else b""
        return [found[t].decode("utf-8", "replace").strip(" ") or None if t in found else None for t in tags]

    def rows(self, stream: BinaryIO) -> Iterator[tuple]:
        if not (hasattr(stream, "seekable") and stream.seekable()):
            spool = tempfile.SpooledTemporaryFile(1 << 24)
            while data := stream.read(1 << 16):
                spool.write(data)
            stream = spool
            stream.seek(0)
        currency, account = self.head(stream)
        stream.seek(0)
        held, entry, rest = None, 0, b""  # the parts of the block that is open
        while True:
            data = stream.read(1 << 16)
            text, at = rest + data, 0
            for hit in _OFX_MARK.finditer(text):
                if held is not None:
                    held.append(text[at : hit.start()])
                    found: dict[bytes, bytes] = {}
                    for tag, value in _OFX_LEAF.findall(b"".join(held)):
                        found.setdefault(tag.upper(), value)
                    yield currency, account, entry, *(found[t].decode("utf-8", "replace").strip(" ") or None if t in found else None for t in _OFX_TAGS)
                    entry += 1
                held, at = [] if hit[0][1:2] != b"/" else None, hit.end()
            if not data:
                return
            cut = text.rfind(b"<", at)
            cut = cut if cut >= len(text) - 16 and cut >= 0 else len(text)  # what may be the start of a tag
            if held is not None:
                held.append(text[at:cut])
            rest = text[cut:]


def ofx_transactions(files: DataFrame, strict: bool = True) -> DataFrame:
    """(date, description, amount, currency, account_id, transaction_id, transaction_type), dates as yyyyMMdd."""
    tags = [t.decode() for t in _OFX_TAGS]
    rows = _streamed(files, _Blocks, ["currency", "account_id", "_entry", *tags], ", ".join(["currency string, account_id string, _entry int", *(f"{t} string" for t in tags)]))
    raw = F.col("TRNAMT")
    amount = required(locale_amount(raw), raw, "TRNAMT") if strict else locale_amount(raw)
    faults = [] if strict else [F.when(raw.isNull(), "TRNAMT is missing").otherwise(unreadable(locale_amount(raw), raw, "TRNAMT")).alias("_fault")]
    return rows.select(F.substring("DTPOSTED", 1, 8).alias("date"), F.coalesce("MEMO", "NAME").alias("description"), amount.alias("amount"), "currency", "account_id", F.col("FITID").alias("transaction_id"), F.col("TRNTYPE").alias("transaction_type"), "_file", "_entry", *faults)


# ---- MT940

_MT_BALANCE = r"^:(60F|62F):([CD])(\d{6})([A-Z]{3})([0-9,]+)$"
_MT_ENTRY = r"^:61:(\d{6})(?:\d{4})?([CD])([0-9,]+)(.*)$"


#: The same for Python: Java's $ also stands before a last line break of any kind.
_MT_CURRENCY = re.compile("^:6[02]F:[CD][0-9]{6}([A-Z]{3})[0-9,]+[\r\x85\u2028\u2029]?\\Z")


class _Lines:
    """(line, text, account_id, currency, entry) of an MT940 file's lines that begin with ``only``."""

    only = ""

    def lines(self, stream: BinaryIO) -> Iterator[tuple[int, str]]:
        held: list[bytes] = []  # of the line that isn't whole yet
        n = 0
        while data := stream.read(1 << 16):
            first, *more = data.split(b"\n")
            held.append(first)
            for part in more:
                yield n, b"".join(held).removesuffix(b"\r").decode("utf-8", "replace").strip(" ")
                n, held = n + 1, [part]
        yield n, b"".join(held).decode("utf-8", "replace").strip(" ")

    def rows(self, stream: BinaryIO) -> Iterator[tuple]:
        account = currency = None
        entry = 0
        for n, text in self.lines(stream):
            if text.startswith(":25:"):
                account = text[4:].strip(" ")
            elif text.startswith(":61:"):
                entry += 1
            elif hit := _MT_CURRENCY.match(text):
                currency = hit[1]
            if text.startswith(self.only):
                yield n, text, account, currency, entry


class _Tagged(_Lines):
    only = ":6"


class _Statement(_Lines):
    """(entry, text, account_id, currency, description) of an MT940 file's :61: lines: the last :86: before the next one describes it."""

    def rows(self, stream: BinaryIO) -> Iterator[tuple]:
        account = currency = found = None
        entry = 0
        for _, text in self.lines(stream):
            if text.startswith(":25:"):
                account = text[4:].strip(" ")
            elif text.startswith(":61:"):
                if found:
                    yield *found, description
                entry, description = entry + 1, None
                found = entry, text, account, currency
            elif text.startswith(":86:"):
                description = text[4:].strip(" ")
            elif hit := _MT_CURRENCY.match(text):
                currency = hit[1]
        if found:
            yield *found, description


def mt940_lines(files: DataFrame, tagged: bool = False) -> DataFrame:
    """(_file, line, text, account_id, currency, entry): account and currency carried forward, ``entry`` the number of :61: lines so far, readable or not.  ``tagged`` for those of entries and balances alone."""
    return _streamed(files, _Tagged if tagged else _Lines, ["line", "text", "account_id", "currency", "entry"], "line int, text string, account_id string, currency string, entry int")


def mt940_transactions(files: DataFrame, strict: bool = True) -> DataFrame:
    """(date, amount, transaction_id, account_id, currency, description) of the readable :61: lines; the last :86: before the next one is the description.  Dates are this century's."""
    rows = _streamed(files, _Statement, ["entry", "text", "account_id", "currency", "description"], "entry int, text string, account_id string, currency string, description string")
    grouped = rows.where(F.col("text").rlike(_MT_ENTRY))
    part = lambda k: F.regexp_extract("text", _MT_ENTRY, k)
    amount = required(locale_amount(part(3)), part(3), ":61:") if strict else locale_amount(part(3))
    faults = [] if strict else [unreadable(locale_amount(part(3)), part(3), ":61:").alias("_fault")]
    return grouped.select(short_year_date(part(1)).alias("date"), F.when(part(2) == "D", -amount).otherwise(amount).cast(MONEY_SQL).alias("amount"), F.trim(part(4)).alias("transaction_id"), "account_id", "currency", "description", "_file", (F.col("entry") - 1).cast("int").alias("_entry"), *faults)


def mt940_unread(files: DataFrame) -> DataFrame:
    """(_file, line, text) of the :61: lines that the pattern doesn't take."""
    return mt940_lines(files, True).where(F.col("text").startswith(":61:") & ~F.col("text").rlike(_MT_ENTRY)).select("_file", "line", "text")


def mt940_balances(files: DataFrame) -> DataFrame:
    """(_file, account_id, currency, opening_balance, closing_balance), negative for D."""
    rows = mt940_lines(files, True).where(F.col("text").rlike(_MT_BALANCE))
    part = lambda k: F.regexp_extract("text", _MT_BALANCE, k)
    value = F.when(part(2) == "D", -locale_amount(part(5))).otherwise(locale_amount(part(5)))
    pick = lambda tag: F.max_by("v", F.when(F.col("tag") == tag, F.col("line")))
    tagged = rows.withColumns({"v": value.cast(MONEY_SQL), "tag": part(1)})
    return tagged.groupBy("_file").agg(F.max_by("account_id", "line").alias("account_id"), F.max_by("currency", "line").alias("currency"), pick("60F").alias("opening_balance"), pick("62F").alias("closing_balance"))


# ---- delimited text

SYNONYMS: dict[str, str] = {
    "date": "date bookingdate transactiondate valuedate buchungstag dateoperation datevaleur fecha fechaoperacion fechavalor",
    "description": "description details memo narrative payee name verwendungszweck libelle concepto descripcion",
    "amount": "amount transactionamount betrag value sum montant importe",
    "debit": "debit withdrawal outflow soll cargo adeudo debito",
    "credit": "credit deposit inflow haben abono ingreso credito",
    "balance": "balance runningbalance solde saldo",
    "currency": "currency ccy devise divisa moneda",
    "account_id": "account accountnumber iban compte cuenta",
    "transaction_id": "id transactionid reference ref referencia",
}
_LOGICAL = {name: set(words.split()) for name, words in SYNONYMS.items()}


def sniff(head: str) -> str:
    """The delimiter of a header line."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=head.count)


def map_headers(headers: list[str]) -> dict[str, str]:
    """Logical name -> the first column in file order that means it."""
    out: dict[str, str] = {}
    for name, words in _LOGICAL.items():
        hit = next((h for h in headers if fold_header(h) in words), None)
        if hit is not None:
            out[name] = hit
    return out


def csv_project(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Logical columns of text columns under any of the known headers; ``_file`` and ``_row`` go along."""
    found = map_headers([c for c in raw.columns if not c.startswith("_")])
    if "amount" not in found and not {"debit", "credit"} & found.keys():
        raise FormatError(f"no amount among the columns {raw.columns}")
    text = lambda n: F.nullif(F.trim(raw[f"`{found[n]}`"]), F.lit(""))
    read = lambda n: required(locale_amount(text(n)), text(n), n) if strict else locale_amount(text(n))
    filled = lambda n: F.when(text(n).isNotNull(), read(n)) if n in found else F.lit(None).cast(MONEY_SQL)
    amount = F.when(text("amount").isNull(), F.lit(0).cast(MONEY_SQL)).otherwise(read("amount")) if "amount" in found else signed_difference(filled("credit"), filled("debit"))
    faults = [] if strict else [F.coalesce(*(unreadable(locale_amount(text(n)), text(n), n) for n in ("amount", "credit", "debit") if n in found and (n == "amount" or "amount" not in found))).alias("_fault")]
    plain = [(text(n) if n in found else F.lit(None).cast("string")).alias(n) for n in ("date", "description")]
    rest = [(text(n) if n in found else F.lit(None).cast("string")).alias(n) for n in ("currency", "balance", "account_id", "transaction_id")]
    return raw.select(*plain, amount.cast(MONEY_SQL).alias("amount"), *rest, *(c for c in raw.columns if c.startswith("_")), *faults)


def csv_files(spark: SparkSession, paths) -> DataFrame:
    """(_file, head, torn): each file's header line, and whether a line break stands within quotes."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(listed).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("at"), "value")
    odd = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return lines.groupBy("_file").agg(F.first(F.when(F.col("at") == 0, F.col("value")), ignorenulls=True).alias("head"), F.max(odd % 2 == 1).alias("torn"))


def csv_parts(spark: SparkSession, paths, strict: bool = True) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(rows, [(file, error)]) of delimited files.  Files of one header are scanned together, whatever their number; those with line breaks within quotes are not split."""
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in csv_files(spark, paths).orderBy("_file").collect():  # one small row a file
        groups.setdefault((r["head"] or "", r["torn"]), []).append(r["_file"])
    parts, faults = [], []
    for (head, torn), files in sorted(groups.items()):
        raw = spark.read.csv([unquote(f) for f in files], sep=sniff(head.lstrip("\ufeff")), header=True, inferSchema=False, multiLine=torn, escape='"', enforceSchema=False)
        try:
            parts.append(csv_project(raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id()), strict))
        except FormatError as e:
            faults += [(f, str(e)) for f in files]
    if strict and faults:
        raise FormatError(faults[0][1])
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, faults


def csv_transactions(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """Rows of delimited files."""
    out, _ = csv_parts(spark, paths, strict)
    if out is None:
        raise FormatError("no delimited file has a header")
    return out


def flat_summary(tx: DataFrame, order: str) -> DataFrame:
    """One row a file: first account and currency, last date, count, sum, first and last balance (where there is one)."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    balance = [F.min_by("balance", order).alias("opening"), F.max_by("balance", order).alias("closing")] if "balance" in tx.columns else [F.lit(None).cast("string").alias("opening"), F.lit(None).cast("string").alias("closing")]
    out = tx.groupBy("_file").agg(first("account_id").alias("account_id"), F.max_by(F.col("date").cast("string"), F.when(F.col("date").isNotNull(), F.col(order))).alias("statement_date"), F.count("*").alias("transaction_count"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SQL).alias("total_amount"), first("currency").alias("currency"), *balance)
    return out.withColumns({"opening_balance": F.when(F.col("opening").isNotNull(), locale_amount(F.col("opening"))), "closing_balance": F.when(F.col("closing").isNotNull(), locale_amount(F.col("closing")))}).drop("opening", "closing")
