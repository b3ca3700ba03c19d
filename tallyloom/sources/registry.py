"""Formats by name, their detection, and the scan of whole folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exceptions import FormatError
from ..operators.normalize import normalize
from . import camt, flat, large, pain001

EXTENSIONS = (".xml", ".csv", ".ofx", ".qfx", ".mt940", ".sta", ".pdf")


Checked = tuple[DataFrame | None, DataFrame | None]


@dataclass(frozen=True)
class Format:
    """``read``: paths to bronze rows; ``summary``: paths to one row a file; ``checked``: paths to bronze rows that tell what is wrong with them in ``_fault``, and (_file, error) of files that give no rows."""

    name: str
    read: Callable[..., DataFrame]
    summary: Callable[[SparkSession, list[str]], DataFrame]
    balances: Callable[..., DataFrame] | None = None
    checked: Callable[[SparkSession, list[str]], Checked] | None = None


FORMATS: dict[str, Format] = {}


def register(fmt: Format) -> None:
    """Add a format, or replace the one of its name."""
    FORMATS[fmt.name] = fmt


def _malformed(parts: DataFrame) -> DataFrame:
    return parts.where("error is not null").select("_file", F.lit("malformed XML").alias("error"))


def _camt_checked(spark: SparkSession, paths: list[str]) -> Checked:
    parts = camt.parts(spark, paths, strict=False)
    return camt.transactions(parts, strict=False), _malformed(parts)


def _pain_checked(spark: SparkSession, paths: list[str]) -> Checked:
    parts = pain001.parts(spark, paths, strict=False)
    return pain001.payments(parts), _malformed(parts)


def _csv_checked(spark: SparkSession, paths: list[str]) -> Checked:
    rows, faults = flat.csv_parts(spark, paths, strict=False)
    return rows, spark.createDataFrame(faults, "_file string, error string") if faults else None


register(Format("camt", lambda s, p, redact_pii=False: camt.transactions(camt.parts(s, p), redact_pii), lambda s, p: camt.summary(camt.parts(s, p)), lambda s, p, strict=True: camt.statement_balances(camt.parts(s, p, strict), strict), _camt_checked))
register(Format("pain001", lambda s, p, redact_pii=False: pain001.payments(pain001.parts(s, p), redact_pii), lambda s, p: pain001.summary(pain001.parts(s, p)), checked=_pain_checked))
register(Format("csv", lambda s, p, redact_pii=False: flat.csv_transactions(s, p), lambda s, p: flat.flat_summary(flat.csv_transactions(s, p), "_row"), checked=_csv_checked))
for _name in ("ofx", "qfx"):
    register(Format(_name, lambda s, p, redact_pii=False: flat.ofx_transactions(large.listed(s, p)), lambda s, p: flat.flat_summary(flat.ofx_transactions(large.listed(s, p)), "_entry"), checked=lambda s, p: (flat.ofx_transactions(large.listed(s, p), strict=False), None)))


def _mt940_summary(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = large.listed(spark, paths)
    rows = flat.flat_summary(flat.mt940_transactions(files), "_entry").drop("opening_balance", "closing_balance", "account_id", "currency")
    return flat.mt940_balances(files).join(rows, "_file", "full")


register(Format("mt940", lambda s, p, redact_pii=False: flat.mt940_transactions(large.listed(s, p)), _mt940_summary, lambda s, p, strict=True: flat.mt940_balances(large.listed(s, p)), lambda s, p: (flat.mt940_transactions(large.listed(s, p), strict=False), None)))


def detect(path: Column, content: Column) -> Column:
    """The format of a file by its suffix and text, null if it is none of them."""
    suffix, body = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)), F.lower(content)
    has = lambda *words: F.greatest(*(F.contains(body, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(body, F.lit(words[0]))
    return (
        F.when(suffix == ".csv", "csv").when(suffix.isin(".ofx"), "ofx").when(suffix == ".qfx", "qfx").when(suffix.isin(".mt940", ".sta"), "mt940")
        .when((suffix == ".xml") & has("cstmrcdttrfinitn", "pain.001"), "pain001").when((suffix == ".xml") & has("bktocstmrstmt", "camt."), "camt")
        .when(has("<ofx>", "<banktranlist>"), "ofx").when(has(":20:") & has(":61:"), "mt940")
    )


#: What ``detect`` looks for in a text.
_WORDS = (b"cstmrcdttrfinitn", b"pain.001", b"bktocstmrstmt", b"camt.", b"<ofx>", b"<banktranlist>", b":20:", b":61:")


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with the words that they have, and %PDF at their beginning; read in constant memory."""
    for batch in batches:
        words = []
        for path in batch.column(0).to_pylist():
            found: set[bytes] = set()
            with large.open_stream(path) as stream:
                data = stream.read(1 << 20)
                head, rest = data[:4].decode("latin-1") if data[:4] == b"%PDF" else "", b""
                while data:
                    text = rest + data.lower()
                    found |= {w for w in _WORDS if w not in found and w in text}
                    rest, data = text[-max(map(len, _WORDS)) :], stream.read(1 << 20)
            words.append(" ".join([head, *(w.decode() for w in _WORDS if w in found)]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, type=pa.string())], names=["_file", "path", "size", "words"])


#: Suffixes that settle a file's format by themselves.
_SETTLED = {"csv": "csv", "ofx": "ofx", "qfx": "qfx", "mt940": "mt940", "sta": "mt940"}


def file_index(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """(_file, path, format, size): each file's format.  Only files that their suffix doesn't settle are opened."""
    reader = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    name, suffix = F.col("_metadata.file_path").alias("_file"), F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    # without its content a file is listed and not read
    listed = reader().load(paths).select(name, "path", F.col("length").alias("size"), suffix.alias("suffix"))
    by_suffix = F.create_map(*(F.lit(x) for pair in _SETTLED.items() for x in pair))
    settled = listed.where(F.col("suffix").isin(*_SETTLED)).select("_file", "path", F.try_element_at(by_suffix, F.col("suffix")).alias("format"), "size")
    others = sorted(r["path"] for r in listed.where(~F.col("suffix").isin(*_SETTLED)).select("path").collect())  # the reader takes its paths from the driver
    if not others:
        return settled
    looked = reader().load(others).select(name, "path", F.col("length").alias("size")).mapInArrow(_look, "_file string, path string, size bigint, words string")
    looked = looked.select("_file", "path", F.when(F.col("words").startswith("%PDF"), F.lit("pdf")).otherwise(detect(F.col("path"), F.col("words"))).alias("format"), "size")
    return settled.unionByName(looked)


def detect_format(spark: SparkSession, path: str) -> str:
    found = file_index(spark, path, recursive=False).first()
    if found is None or found["format"] is None:
        raise FormatError(f"unknown format: {path}")
    return found["format"]


def read_statement(spark: SparkSession, path: str | list[str], format_name: str | None = None, redact_pii: bool = False) -> DataFrame:
    """Bronze rows of a file, or of many of one format."""
    name = format_name or detect_format(spark, path if isinstance(path, str) else path[0])
    if name not in FORMATS:
        raise FormatError(f"unsupported format: {name}")
    return FORMATS[name].read(spark, path, redact_pii=redact_pii)


def parse_files(spark: SparkSession, paths: list[str], format_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(silver rows of all good files, one row a file: _file, path_idx, format, status, error).

    Files of one format are one scan; a file that is missing, of unknown format
    or malformed, or that has an unreadable amount, fails alone and gives no rows.
    """
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    places, there = [], []
    for k, p in enumerate(dict.fromkeys(paths)):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        places.append((k, p, system.makeQualified(path).toUri().toString()))
        if system.exists(path):
            there.append(p)
    if not there:
        raise FormatError("none of the files is there")
    index = file_index(spark, there, recursive=False).withColumn("format", F.coalesce(F.lit(format_name), "format"))
    rows, failed = read_index(spark, index)
    order = spark.createDataFrame(places, "path_idx int, __path string, __key string").withColumn("__key", key("__key"))
    known = index.select(key("_file").alias("__key"), "_file", "format")
    listed = order.join(known, "__key", "left").join(failed, "_file", "left")
    error = F.when(F.col("_file").isNull(), "no such file").otherwise(F.col("error"))
    status = listed.select(F.coalesce("_file", "__path").alias("_file"), "path_idx", "format", F.when(error.isNotNull(), "FAILED").otherwise("SUCCESS").alias("status"), error.alias("error"))
    return rows, status.orderBy("path_idx")


def _by_format(index: DataFrame, names: list[str]) -> list[tuple[str, list[str]]]:
    """Paths by format; readers take their paths from the driver."""
    found: dict[str, list[str]] = {}
    for r in index.where(F.col("format").isin(*names)).select("format", "path").collect():
        found.setdefault(r["format"], []).append(r["path"])
    return [(n, sorted(p)) for n, p in sorted(found.items())]


def read_index(spark: SparkSession, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(silver rows of the good files in an index, (_file, error) of the others), one scan for each format."""
    parts = []
    failed = index.where(~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False))).select("_file", F.concat(F.lit("unsupported format: "), F.coalesce("format", F.lit("unknown"))).alias("error"))
    for name, paths in _by_format(index, list(FORMATS)):
        bronze, faults = FORMATS[name].checked(spark, paths) if FORMATS[name].checked else (FORMATS[name].read(spark, paths), None)
        if faults is not None:
            failed = failed.unionByName(faults)
        if bronze is not None:
            silver = normalize(bronze, strict=False).withColumn("_format", F.lit(name))
            fault = F.coalesce("_fault", "_reject") if "_fault" in silver.columns else F.col("_reject")
            parts.append(silver.withColumn("_fault", fault).drop("_reject"))
    if not parts:
        raise FormatError("no statement among the files")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    failed = failed.unionByName(out.where("_fault is not null").select("_file", F.col("_fault").alias("error"))).groupBy("_file").agg(F.min("error").alias("error"))
    return out.drop("_fault").join(failed.select("_file"), "_file", "left_anti"), failed


@dataclass(frozen=True)
class Scan:
    """``transactions`` have dedup_key and is_new; ``failures`` are the files that give no rows, with the reason; ``balances`` and ``continuity`` go over the files in order."""

    transactions: DataFrame
    failures: DataFrame
    balances: DataFrame | None
    continuity: DataFrame | None

    def totals(self) -> DataFrame:
        """(total_unique, total_skipped, file_count)."""
        count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
        return self.transactions.agg(count(F.col("is_new")).alias("total_unique"), count(~F.col("is_new")).alias("total_skipped"), F.count_distinct("_file").alias("file_count"))


def scan(spark: SparkSession, folder: str, seen: DataFrame | None = None) -> Scan:
    """A folder and all below it: every statement read, rows that an earlier file or ``seen`` has marked, balances checked from file to file."""
    from ..operators import dedup, verification

    index = file_index(spark, folder)
    tx, failures = read_index(spark, index)
    order = [F.col(c) for c in ("_stmt_index", "_payment", "_transfer", "_row", "_entry") if c in tx.columns]
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("_file").orderBy(*order)) - 1).cast("int")
    keyed = dedup.first_file_wins(tx.withColumn("source_index", place))
    if seen is not None:
        old = seen.select("dedup_key", F.lit(True).alias("__old")).distinct()
        keyed = keyed.join(old, "dedup_key", "left").withColumn("is_new", F.col("is_new") & F.col("__old").isNull()).drop("__old")
    balances = None
    for name, paths in _by_format(index, [n for n, f in FORMATS.items() if f.balances]):
        part = FORMATS[name].balances(spark, paths, strict=False).join(failures.select("_file"), "_file", "left_anti")
        balances = part if balances is None else balances.unionByName(part, allowMissingColumns=True)
    continuity = None
    if balances is not None:
        ordered = balances.withColumn("_stmt_index", F.coalesce("_stmt_index", F.lit(0)) if "_stmt_index" in balances.columns else F.lit(0))
        continuity = verification.verify_continuity(ordered, ["_file", "_stmt_index"], ["account_id", "currency"], label="_file")
    return Scan(keyed, failures, balances, continuity)
