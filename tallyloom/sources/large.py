"""Statement and payment files of any size, read in constant memory.

A file is parsed as a stream inside its task and gives one row an entry (or
credit transfer) as soon as that ends, with what the file says above it; neither
the file nor a statement is ever held.  The rows are then read as the other
readers read theirs, so both give the same columns.  The same goes for texts
that come in pieces, a row a piece, as none need hold a whole document.

Defined results: a malformed file raises, or without ``strict`` gives, after the
rows before the fault, one row whose ``error`` is set.  Document types and
entities are refused.  An empty folder gives no row.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import unquote, urlparse
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exceptions import FormatError
from . import camt, pain001

#: Bytes parsed at once, rows sent on at once, and units that stand together at most.
_CHUNK, _ROWS, _RUN = 1 << 16, 1000, 50

#: Bytes that tell a text's encoding; an encoding that expat reads as it is cut here; names with a prefix.
_HEAD = 256
_DECLARED = re.compile(rb"""^(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)""")
_PREFIXED = re.compile(rb"</?[^\s<>/:=\"']+:|\s[^\s<>/:=\"']+:[^\s<>/:=\"']+\s*=")

Row = tuple


class _Units:
    """Elements ``unit`` below ``parent`` as XML text; ``take`` gets the leaves outside of them, ``emit`` each unit.

    Most units are cut out of the text as they stand there, once a parser
    without handlers has found it well-formed, and the parser below gets an
    empty element in their place.  What the cut doesn't know how to read
    (comments, other encodings, prefixes, attributes of a unit) it leaves to
    that parser, which copies units by itself.
    """

    def __init__(self, unit: str, parent: str, keep: tuple[str, ...] = ()):
        self.unit, self.parent, self.keep = unit, parent, keep
        self.open, self.close, self.mark = f"<{unit}>".encode(), f"</{unit}>".encode(), f'<{unit} _cut=""/>'.encode()
        self.runs: deque[list[bytes]] = deque()  # what was cut out, until its marks are met
        self.path: list[str] = []
        self.parts: list[str] | None = None  # of the element that is being copied
        self.depth = 0
        self.text: list[str] = []
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._chars
        self.parser.StartDoctypeDeclHandler = self._refuse

    def _refuse(self, *_) -> None:
        raise FormatError("document types and entities are refused")

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        run = self.runs.popleft() if name == self.unit and "_cut" in attributes and self.runs else None
        if run and self.parts is not None:  # within something that is copied
            self.parts.append("".join(map(self._whole, run))[: -len(self.close)])
            self.depth += 1
            return
        if self.parts is None:
            above = self.path[-1] if self.path else ""
            self.path.append(name)
            self.text = []
            if run:
                if above == self.parent:
                    self.emit_all([self._whole(body) for body in run])
            elif name == self.unit and above == self.parent or name in self.keep:
                self.parts, self.depth = [], 0
            else:
                self.enter(name)
        if self.parts is not None:
            own = "".join(f" {k.rpartition(':')[2]}={quoteattr(v)}" for k, v in attributes.items() if not k.startswith("xmlns"))
            self.parts.append(f"<{name}{own}>")
            self.depth += 1

    def _chars(self, text: str) -> None:
        if self.parts is not None:
            self.parts.append(escape(text))
        else:
            self.text.append(text)

    def _end(self, name: str) -> None:
        if self.parts is not None:
            self.depth -= 1
            self.parts.append(f"</{name.rpartition(':')[2]}>")
            if self.depth:
                return
            xml, self.parts = "".join(self.parts), None
            if self.path[-1] == self.unit:
                self.emit(xml)
            else:
                self.kept(self.path[-1], xml)
        else:
            self.take(self.path, "".join(self.text).strip())
        self.path.pop()
        self.text = []

    def enter(self, name: str) -> None: ...

    def take(self, path: list[str], text: str) -> None: ...

    def kept(self, name: str, xml: str) -> None: ...

    def emit(self, xml: str) -> None: ...

    def emit_all(self, units: list[str]) -> None:
        """Units with nothing between them."""
        for xml in units:
            self.emit(xml)

    def _whole(self, body: bytes) -> str:
        return (self.open + body + self.close).decode()

    def rows(self, stream: BinaryIO) -> Iterator[Row]:
        self.done: list[Row] = []
        check = expat.ParserCreate()
        check.StartDoctypeDeclHandler = self._refuse
        rest, raw, last = b"", None, b""  # what isn't parsed yet; whether the rest of the text is left to the parser
        fault = None
        while fault is None:
            data = stream.read(_CHUNK)
            try:
                check.Parse(data, not data)
            except (expat.ExpatError, FormatError) as e:
                fault, raw = e, True
            rest += data
            if raw is None and (len(rest) >= _HEAD or not data):
                declared = _DECLARED.match(rest[:_HEAD])
                raw = b"\0" in rest[:4] or rest[:2] in (b"\xff\xfe", b"\xfe\xff") or bool(declared and declared[1].lower() not in (b"utf-8", b"us-ascii"))
                raw = raw or b"<!" in rest or b"<?" in rest.removeprefix(b"\xef\xbb\xbf")[2:]
            elif raw is False:
                raw = b"<!" in last + data or b"<?" in last + data
            last = data[-1:]
            try:
                if raw or not data:
                    self.parser.Parse(rest, not data)
                    rest = b""
                elif raw is False:
                    rest = self._cut(rest)
            except (expat.ExpatError, FormatError) as e:
                fault = fault or e
            yield from self.done
            self.done.clear()
            if not data:
                break
        if fault is not None:
            raise fault

    def _cut(self, text: bytes) -> bytes:
        """Parses what is whole in ``text``, its units cut out, and gives the rest."""
        *whole, rest = text.split(self.close)
        out: list[bytes] = []
        run: list[bytes] | None = None
        for piece in whole:
            gap, found, body = piece.partition(self.open)
            if not found or b":" in body and _PREFIXED.search(body):
                out += (piece, self.close)
                run = None
            elif run is not None and len(run) < _RUN and not gap.strip():
                run.append(body)
            else:
                run = [body]
                self.runs.append(run)
                out += (gap, self.mark)
        at = rest.find(self.open)
        if at < 0:  # no unit has begun, but for what may be the start of its tag
            at = max(rest.rfind(b"<"), 0) if rest.rfind(b"<") > len(rest) - len(self.close) else len(rest)
        out.append(rest[:at])
        self.parser.Parse(b"".join(out))
        return rest[at:]


class _Entries(_Units):
    """(stmt_index, account, stmt_id, currency, entry, xml) of a statement file."""

    def __init__(self) -> None:
        super().__init__("Ntry", "Stmt")
        self.stmt = -1

    def enter(self, name: str) -> None:
        if name == "Stmt":
            self.stmt, self.entry = self.stmt + 1, -1
            self.found: dict[str, str] = {}

    def take(self, path: list[str], text: str) -> None:
        if "Stmt" in path[-5:-1]:
            at = ".".join(path[len(path) - path[::-1].index("Stmt") :])
            if at in ("Id", "CreDtTm", "Acct.Id.IBAN", "Acct.Id.Othr.Id", "Acct.Ccy"):
                self.found.setdefault(at, text)

    def emit(self, xml: str) -> None:
        get = self.found.get
        self.entry += 1
        self.done.append((self.stmt, get("Acct.Id.IBAN", get("Acct.Id.Othr.Id", "")), get("Id"), get("Acct.Ccy"), self.entry, xml))


class _Parts(_Entries):
    """(stmt_index, account, stmt_id, created, currency, kind, at, xml) of a statement file: its entries (a run of them a row, ``at`` the first's number), balances, and last each statement, hollow or not."""

    def __init__(self) -> None:
        super().__init__()
        self.keep = ("Bal",)

    def enter(self, name: str) -> None:
        super().enter(name)
        if name == "Stmt":
            self.balance, self.account = -1, False
        elif name == "Acct" and self.path[-2:-1] == ["Stmt"]:
            self.account = True

    def _add(self, kind: str, at: int | None, xml: str | None) -> None:
        get = self.found.get
        self.done.append((self.stmt, get("Acct.Id.IBAN", get("Acct.Id.Othr.Id", "")), get("Id"), get("CreDtTm"), get("Acct.Ccy"), kind, at, xml))

    def take(self, path: list[str], text: str) -> None:
        super().take(path, text)
        if path[-1] == "Stmt":
            hollow = not self.account and self.balance < 0 and self.entry < 0 and bool(self.found.keys() & {"Id", "CreDtTm"})
            self._add("Hollow" if hollow else "Stmt", None, None)

    def kept(self, name: str, xml: str) -> None:
        if self.path[-2:-1] == ["Stmt"]:
            self.balance += 1
            self._add("Bal", self.balance, xml)

    def emit(self, xml: str) -> None:
        self.emit_all([xml])

    def emit_all(self, units: list[str]) -> None:
        self._add("Ntry", self.entry + 1, f"<x>{''.join(units)}</x>")
        self.entry += len(units)


class _Transfers(_Units):
    """(payment, transfer, header, payment's own fields, xml) of a payment file; the latter three as XML."""

    def __init__(self) -> None:
        super().__init__("CdtTrfTxInf", "PmtInf", ("GrpHdr", *pain001._OWN))
        self.payment, self.header = -1, "<GrpHdr></GrpHdr>"

    def enter(self, name: str) -> None:
        if name == "PmtInf":
            self.payment, self.transfer = self.payment + 1, -1
            self.own: list[str] = []

    def kept(self, name: str, xml: str) -> None:
        if name == "GrpHdr":
            self.header = xml
        else:
            self.own.append(xml)

    def emit(self, xml: str) -> None:
        self.transfer += 1
        self.done.append((self.payment, self.transfer, self.header, f"<PmtInf>{''.join(self.own)}</PmtInf>", xml))


class _Initiation(_Transfers):
    """(payment, transfer, payments, transfers, xml) of a payment file: its transfers, a run of them a row with header and payment as one XML, and last the file's header and its counts."""

    def __init__(self) -> None:
        super().__init__()
        self.transfers = 0

    def take(self, path: list[str], text: str) -> None:
        if path[-1] == "CstmrCdtTrfInitn":
            self.done.append((None, None, self.payment + 1, self.transfers, f"<x>{self.header}</x>"))

    def emit(self, xml: str) -> None:
        self.emit_all([xml])

    def emit_all(self, units: list[str]) -> None:
        self.done.append((self.payment, self.transfer + 1, None, None, f"<x>{self.header}<PmtInf>{''.join(self.own)}</PmtInf>{''.join(units)}</x>"))
        self.transfer += len(units)
        self.transfers += len(units)


def open_stream(path: str) -> BinaryIO:
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_stream(at)


class _Pieces:
    """A text that comes in pieces, as a stream."""

    def __init__(self, pieces: Iterator[tuple[str, bytes]], name: str, first: bytes):
        self.pieces, self.name, self.ready, self.next = pieces, name, first, None

    def read(self, _: int = 0) -> bytes:
        while not self.ready and self.next is None:
            name, data = next(self.pieces, (None, b""))
            if name == self.name:
                self.ready = data
            else:
                self.next = (name, data)
        out, self.ready = self.ready, b""
        return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(name, the bytes of its pieces that lie together)."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        runs, at = pc.run_end_encode(batch.column(0)), 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            part = texts.slice(at, end - at)
            _, offsets, data = part.buffers()
            ends = memoryview(offsets).cast("q")
            yield name, bytes(memoryview(data)[ends[part.offset] : ends[part.offset + len(part)]]) if data else b""
            at = end


def streams(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[tuple[str, BinaryIO]]:
    if not pieces:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_stream(path) as stream:
                    yield path, stream
        return
    runs = _runs(batches)
    found = next(runs, (None, b""))
    while found[0] is not None:
        stream = _Pieces(runs, *found)
        yield found[0], stream
        while stream.read():  # what a fault has left unread
            pass
        found = stream.next


def listed(spark: SparkSession, paths) -> DataFrame:
    """(path): files to be read where they are parsed; large ones are a task each, as the reader packs them by size."""
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))


def in_order(pieces: DataFrame, by: list[str], name: str = "_file", text: str = "text") -> DataFrame:
    """(_file, text) of pieces in the order of ``by``, those of a document together; null pieces are left out."""
    rows = pieces.where(F.col(name).isNotNull() & F.col(text).isNotNull())
    return rows.repartition(name).sortWithinPartitions(name, *by).select(F.col(name).alias("_file"), F.col(text).alias("text"))


def batched(rows: Iterator[Row], names: list[str], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a schema of ints and strings."""
    kinds = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    while some := list(islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*some), kinds)], names=names)


def parsed(source: DataFrame, units: Callable, names: list[str], schema: str, strict: bool = True) -> DataFrame:
    """(_file, *names, error) of files (path) or of ordered pieces (_file, text); ``units().rows`` makes rows of a stream."""
    pieces, full = "text" in source.columns, f"_file string, {schema}, error string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for path, stream in streams(batches, pieces):
            try:
                for row in units().rows(stream):
                    yield path, *row, None
            except (expat.ExpatError, FormatError) as e:
                if strict:
                    raise FormatError(f"{path}: {e}") from e
                yield path, *(None,) * len(names), f"malformed XML: {e}"

    return source.mapInArrow(lambda batches: batched(rows(batches), ["_file", *names, "error"], full), full)


def _parsed(spark: SparkSession, paths, units: Callable[[], _Units], names: list[str], schema: str, strict: bool) -> DataFrame:
    return parsed(listed(spark, paths), units, names, schema, strict)


def statement_parts(stream: BinaryIO) -> Iterator[Row]:
    """PARTS of a statement file."""
    return _Parts().rows(stream)


PARTS = ["stmt_index", "AccountId", "_stmt_id", "_created", "__ccy", "_kind", "_at", "xml"]
PARTS_SCHEMA = "stmt_index int, AccountId string, _stmt_id string, _created string, __ccy string, _kind string, _at int, xml string"


def camt_parts(source: DataFrame, strict: bool = True) -> DataFrame:
    """The parts of statements from files (path) or ordered pieces (_file, text), as ``camt`` takes them in place of whole statements; without ``strict`` the rows of malformed files are followed by one with an ``error``."""
    return parsed(source, _Parts, PARTS, PARTS_SCHEMA, strict)


def pain_parts(source: DataFrame, strict: bool = True) -> DataFrame:
    """The same of payment files, as ``pain001`` takes them in place of whole files."""
    return parsed(source, _Initiation, ["_payment", "_transfer", "_payments", "_transfers", "xml"], "_payment int, _transfer int, _payments int, _transfers int, xml string", strict)


def camt_entries(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(_file, stmt_index, AccountId, _stmt_id, __ccy, _entry, xml, error): one row an entry."""
    names = ["stmt_index", "AccountId", "_stmt_id", "__ccy", "_entry", "xml"]
    return _parsed(spark, paths, _Entries, names, "stmt_index int, AccountId string, _stmt_id string, __ccy string, _entry int, xml string", strict)


def camt_transactions(spark: SparkSession, paths, redact_pii: bool = False, statement_currency: bool = False, incomplete: str = "raise") -> DataFrame:
    """The columns of ``camt.transactions``; an entry without amount or currency raises unless ``incomplete`` is "skip"."""
    rows = camt_entries(spark, paths)
    entry = F.from_xml("xml", camt._ENTRY, {"mode": "FAILFAST", "ignoreNamespace": "true"})
    return camt.project(rows.withColumn("e", entry).drop("xml", "error"), redact_pii, statement_currency, incomplete=incomplete)


def pain_rows(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(_file, _payment, _transfer, header, payment, xml, error): one row a credit transfer."""
    names = ["_payment", "_transfer", "header", "payment", "xml"]
    return _parsed(spark, paths, _Transfers, names, "_payment int, _transfer int, header string, payment string, xml string", strict)


def pain_payments(spark: SparkSession, paths, redact_pii: bool = False) -> DataFrame:
    """The columns of ``pain001.payments``."""
    options = {"mode": "FAILFAST", "ignoreNamespace": "true"}
    read = lambda c, kind: F.from_xml(c, kind, options)
    rows = pain_rows(spark, paths).select("_file", read("header", pain001.HEADER).alias("h"), "_payment", read("payment", pain001._PAYMENT).alias("p"), "_transfer", read("xml", pain001._TRANSFER).alias("t"))
    return pain001.project(rows, redact_pii)
