"""Files of any size in constant memory, and what earlier readers got wrong."""

from __future__ import annotations

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F
from test_files import TWO, document, entry, statement

from tallyloom.sources import camt, flat, large, pain001, scan
from tallyloom.sources.registry import parse_files

PAIN = """<Document xmlns="urn:x"><CstmrCdtTrfInitn><GrpHdr><MsgId>M &amp; N</MsgId><NbOfTxs>3</NbOfTxs><InitgPty><Nm>Ada</Nm></InitgPty></GrpHdr>
<PmtInf><PmtInfId>P1</PmtInfId><Dbtr><Nm>Deb</Nm></Dbtr><DbtrAcct><Id><IBAN>DE1</IBAN></Id></DbtrAcct>
<CdtTrfTxInf><PmtId><EndToEndId>E1</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">1.50</InstdAmt></Amt><Cdtr><Nm>A &lt;B&gt;</Nm></Cdtr><RmtInf><Ustrd>x</Ustrd><Ustrd>y</Ustrd></RmtInf></CdtTrfTxInf>
<CdtTrfTxInf><PmtId><EndToEndId>E2</EndToEndId></PmtId></CdtTrfTxInf></PmtInf>
<PmtInf><PmtInfId>P2</PmtInfId><CdtTrfTxInf><Amt><InstdAmt Ccy="USD">2</InstdAmt></Amt></CdtTrfTxInf></PmtInf></CstmrCdtTrfInitn></Document>"""


def plain(df):
    return sorted((tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


def test_streamed_entries_equal_the_reader(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TWO)
    (tmp_path / "b.xml").write_text(TWO.replace("<Stmt>", "<ns:Stmt>").replace("</Stmt>", "</ns:Stmt>").replace("<Document", '<Document xmlns:ns="urn:n"').replace("Rent", "R &amp; &lt;b&gt;"))
    path = str(tmp_path / "*.xml")
    got, want = large.camt_transactions(spark, path, incomplete="skip"), camt.transactions(camt.statements(spark, path))
    clean = lambda df: plain(df.withColumn("_file", F.regexp_extract("_file", "([^/]+)$", 1)))
    assert got.columns == want.columns and clean(got) == clean(want) and want.count() == 6
    with pytest.raises(Exception, match="no amount or currency"):
        large.camt_transactions(spark, path).collect()
    assert large.camt_entries(spark, str(tmp_path), strict=False).where("error is not null").count() == 0


def test_streamed_payments_equal_the_reader(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAIN)
    path = str(tmp_path / "p.xml")
    for redact in (False, True):
        got, want = large.pain_payments(spark, path, redact), pain001.payments(pain001.initiations(spark, path), redact)
        clean = lambda df: plain(df.drop("_file"))
        assert got.columns == want.columns and clean(got) == clean(want) and got.count() == 3


def test_malformed_files_and_document_types(spark, tmp_path):
    (tmp_path / "cut.xml").write_text(TWO[: TWO.index("US2") + 300])
    (tmp_path / "dtd.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]>' + document("").split("?>")[1])
    rows = large.camt_entries(spark, str(tmp_path / "*.xml"), strict=False).collect()
    assert len([r for r in rows if r["error"] is None]) == 3 and sorted(r["error"][:12] for r in rows if r["error"]) == ["malformed XM"] * 2
    with pytest.raises(Exception, match="refused"):
        large.camt_entries(spark, str(tmp_path / "dtd.xml")).collect()


def test_memory_does_not_grow_with_the_file(tmp_path):
    """One statement of 10,000 and of 50,000 entries: the first row comes at once, and both take the same."""
    peaks = []
    for n in (10_000, 50_000):
        path = tmp_path / f"{n}.xml"
        with path.open("w") as f:
            head, tail = document(statement("DE1", "@", "1", "1")).split("@")
            f.write(head)
            for k in range(n):
                f.write(entry(f"{k}.50", "CRDT"))
            f.write(tail)
        tracemalloc.start()
        began, first, count = time.monotonic(), None, 0
        with path.open("rb") as stream:
            for _ in large._Entries().rows(stream):
                first = first or time.monotonic() - began
                count += 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == n and first < 0.5
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 3_000_000


def test_line_breaks_within_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Description,Amount\n2026-01-01,"two\nlines; and ""quotes""",1.00\n2026-01-02,plain,2.00\n')
    (tmp_path / "b.csv").write_text("Date;Description;Amount\n2026-01-03;other;3,00\n")
    rows = flat.csv_transactions(spark, str(tmp_path / "*.csv")).collect()
    assert sorted((str(r["amount"].normalize()), r["description"]) for r in rows) == [("1", 'two\nlines; and "quotes"'), ("2", "plain"), ("3", "other")]


def test_long_narratives_are_whole(spark, tmp_path):
    long = "x" * 30_000
    (tmp_path / "a.sta").write_text(f":20:X\n:25:{'9' * 1500}\n:60F:C200101EUR0,00\n:61:200102C1,00NTRF1\n:86:{long}\n")
    row = flat.mt940_transactions(flat.whole_files(spark, str(tmp_path / "a.sta"))).first()
    assert row["description"] == long and row["account_id"] == "9" * 1500


def test_one_malformed_file_fails_alone(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TWO)
    (tmp_path / "bad.xml").write_text(TWO[:700])
    found = scan(spark, str(tmp_path))
    assert found.transactions.count() == 3 and [r["_file"].rpartition("/")[2] for r in found.failures.collect()] == ["bad.xml"]
    rows, status = parse_files(spark, [str(tmp_path / "a.xml"), str(tmp_path / "bad.xml"), str(tmp_path / "none.xml")])
    assert rows.count() == 3 and [r["status"] for r in status.collect()] == ["SUCCESS", "FAILED", "FAILED"]
