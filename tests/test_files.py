"""Readers on small files of known content."""

from __future__ import annotations

import datetime
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import normalize, verification
from tallyloom.sources import archives, camt, detect_format, flat, pain001, pages, read_statement, scan
from tallyloom.sources.registry import parse_files

NS = ' xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"'


def entry(amount, side, ccy="EUR", text="Rent", extra=""):
    return f'<Ntry><Amt Ccy="{ccy}">{amount}</Amt><CdtDbtInd>{side}</CdtDbtInd><BookgDt><Dt>2026-03-20</Dt></BookgDt><ValDt><DtTm>2026-03-21T00:00:00</DtTm></ValDt><NtryDtls><TxDtls><RltdPties><Dbtr><Nm>JANE</Nm><PstlAdr><StrtNm>High Street</StrtNm></PstlAdr></Dbtr></RltdPties><RmtInf><Ustrd>{text}</Ustrd><Ustrd>!</Ustrd></RmtInf></TxDtls></NtryDtls>{extra}</Ntry>'


def balance(code, amount, ccy="EUR"):
    return f'<Bal><Tp><CdOrPrtry><Cd>{code}</Cd></CdOrPrtry></Tp><Amt Ccy="{ccy}">{amount}</Amt><CdtDbtInd>CRDT</CdtDbtInd><Dt><Dt>2026-03-20</Dt></Dt></Bal>'


def statement(account, entries, opening, closing, ccy="EUR"):
    return f"<Stmt><Id>S-{account}</Id><CreDtTm>2026-03-22T00:00:00</CreDtTm><Acct><Id><IBAN>{account}</IBAN></Id></Acct>{balance('OPBD', opening, ccy)}{balance('CLBD', closing, ccy)}{entries}</Stmt>"


def document(statements, ns=NS):
    return f'<?xml version="1.0"?><Document{ns}><BkToCstmrStmt><GrpHdr><MsgId>M</MsgId></GrpHdr>{statements}</BkToCstmrStmt></Document>'


TWO = document(
    statement("DE1", entry("1250.50", "CRDT") + entry("500.25", "DBIT") + "<Ntry><Amt>7.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Ntry>", "10000.00", "10750.25")
    + statement("US2", entry("99.99", "DBIT", "USD"), "2500.00", "2400.01", "USD")
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.xml").write_text(TWO)
    (tmp_path / "b.ofx").write_text("<OFX><CURDEF>EUR\n<ACCTID>BE4455\n<BANKTRANLIST><STMTTRN>\n<TRNTYPE>CREDIT\n<DTPOSTED>20260320120000\n<TRNAMT>1250.50\n<FITID>O-1\n<MEMO>Salary\n</STMTTRN><STMTTRN>\n<TRNTYPE>DEBIT\n<DTPOSTED>20260321\n<TRNAMT>-80.25\n<FITID>O-2\n<NAME>Market\n</BANKTRANLIST></OFX>")
    (tmp_path / "c.mt940").write_text(":20:X\n:25:NL91\n:28C:1/1\n:60F:C260320EUR1000,00\n:61:2603200320C1250,50NTRFNONREF//M-1\n:86:Salary payment\n:61:260321D80,25NMSC//M-2\n:86:Groceries\nmore\n:61:260322RD1,00X\n:86:Reversal\n:62F:C260321EUR2170,25\n")
    (tmp_path / "d.csv").write_text("Buchungstag;Verwendungszweck;Betrag;CCY;IBAN;Ref\n2026-03-20;Miete;-1.234,56;EUR;DE1;R1\n2026-03-21;Gehalt;3.500,00;EUR;DE1;R2\n2026-03-22;Kaffee;-4,50;EUR;DE1;R3\n", encoding="utf-8")
    (tmp_path / "e.txt").write_text("nothing of the kind")
    return tmp_path


def test_camt(spark, folder):
    stmts = camt.statements(spark, str(folder / "a.xml"))
    rows = camt.transactions(stmts).orderBy("_stmt_index", "_entry").collect()
    assert [(r["Amount"], r["Currency"], r["AccountId"]) for r in rows] == [(Decimal("1250.5"), "EUR", "DE1"), (Decimal("-500.25"), "EUR", "DE1"), (Decimal("-99.99"), "USD", "US2")]
    assert rows[0]["Reference"] == "Rent!" and rows[0]["Debtor"] == "JANE" and rows[0]["Creditor"] == "" and rows[0]["ValDt"].startswith("2026-03-21") and rows[0]["DebtorAddress"] == "High Street"
    assert camt.transactions(stmts, redact_pii=True).first()["DebtorAddress"] == "***REDACTED***"
    stats = camt.stats(stmts).orderBy("_stmt_index").collect()
    assert [(r["NumTransactions"], r["num_parsed"], r["NetAmount"]) for r in stats] == [(3, 2, Decimal("757.25")), (1, 1, Decimal("-99.99"))]
    assert camt.balances(stmts).where("Description = 'Opening Booked balance'").count() == 2
    out = verification.verify_by(normalize.normalize(camt.transactions(stmts)), camt.statement_balances(stmts), ["account_id", "currency"])
    assert {r["status"] for r in out.collect()} == {"verified"}
    summary = camt.summary(stmts).first()
    assert (summary["account_id"], summary["transaction_count"], summary["currency"], summary["closing_balance"]) == ("DE1", 3, "EUR", Decimal("10750.25"))
    assert camt.split_statements(spark, str(folder / "a.xml")).count() == 2
    assert camt.statements_with_balances(stmts).where("AccountId = 'US2'").first()["balances"]["CLBD"]["Amount"] == Decimal("2400.01")


def test_camt_without_namespace_and_prefixed(spark, tmp_path):
    (tmp_path / "n.xml").write_text(document(statement("GB1", entry("250.00", "CRDT", "GBP"), "100.00", "350.00", "GBP"), ns=""))
    assert camt.transactions(camt.statements(spark, str(tmp_path / "n.xml"))).first()["Amount"] == 250


@pytest.mark.parametrize("bad", [document(statement("X", entry("12..34", "CRDT"), "1", "2")), TWO[:-60]])
def test_camt_errors(spark, tmp_path, bad):
    (tmp_path / "x.xml").write_text(bad)
    with pytest.raises(Exception):  # noqa: B017
        camt.transactions(camt.statements(spark, str(tmp_path / "x.xml"))).collect()


def test_camt_from_text_refuses_entities(spark):
    texts = spark.createDataFrame([("m", TWO)], "_file string, xml string")
    assert camt.transactions(camt.statements_from_text(texts)).count() == 3
    evil = spark.createDataFrame([("m", "<!DOCTYPE x><BkToCstmrStmt><!ENTITY a></BkToCstmrStmt>")], "_file string, xml string")
    with pytest.raises(Exception):  # noqa: B017
        camt.statements_from_text(evil).collect()


def test_pain(spark, tmp_path):
    one = '<CdtTrfTxInf><PmtId><EndToEndId>E{0}</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">{0}.00</InstdAmt></Amt><CdtrAgt><FinInstnId><BIC>BIC</BIC></FinInstnId></CdtrAgt><Cdtr><Nm>Bo</Nm></Cdtr><RmtInf><Ustrd>x</Ustrd></RmtInf></CdtTrfTxInf>'
    pay = "".join(f"<PmtInf><PmtInfId>P{k}</PmtInfId><NbOfTxs>1</NbOfTxs><Dbtr><Nm>Ada</Nm></Dbtr><DbtrAcct><Id><IBAN>NL1</IBAN></Id></DbtrAcct>{one.format(k)}</PmtInf>" for k in (150, 300))
    (tmp_path / "p.xml").write_text(f"<Document><CstmrCdtTrfInitn><GrpHdr><MsgId>1</MsgId><NbOfTxs>9</NbOfTxs><InitgPty><Nm>John</Nm></InitgPty></GrpHdr>{pay}</CstmrCdtTrfInitn></Document>")
    docs = pain001.initiations(spark, str(tmp_path / "p.xml"))
    rows = pain001.payments(docs).orderBy("_payment").collect()
    assert [(r["InstdAmt"], r["DbtrIBAN"], r["NbOfTxs"], r["PmtNbOfTxs"]) for r in rows] == [("150.00", "NL1", "9", "1"), ("300.00", "NL1", "9", "1")]
    assert pain001.payments(docs, redact_pii=True).first()["DbtrNm"] == "***REDACTED***"
    s = pain001.summary(docs).first()
    assert (s["transaction_count"], s["total_amount"], s["initiating_party"]) == (9, 450, "John")
    c = pain001.counts(docs).first()
    assert (c["batches_count"], c["total_payments_count"]) == (2, 2)
    assert pain001.transfers(docs).first()["debtor_account"] == "NL1"
    assert detect_format(spark, str(tmp_path / "p.xml")) == "pain001"
    tx = normalize.normalize(pain001.payments(docs)).first()
    assert tx["account_id"] == "NL1" and tx["transaction_id"].startswith("E") and tx["booking_date"] is None


def test_ofx(spark, folder):
    rows = read_statement(spark, str(folder / "b.ofx")).orderBy("_entry").collect()
    assert [(r["date"], r["description"], r["amount"], r["transaction_id"]) for r in rows] == [("20260320", "Salary", Decimal("1250.5"), "O-1"), ("20260321", "Market", Decimal("-80.25"), "O-2")]


def test_mt940(spark, folder):
    files = flat.whole_files(spark, str(folder / "c.mt940"))
    rows = flat.mt940_transactions(files).orderBy("_entry").collect()
    assert [(r["date"], r["amount"], r["description"], r["account_id"], r["currency"]) for r in rows] == [(datetime.date(2026, 3, 20), Decimal("1250.5"), "Salary payment", "NL91", "EUR"), (datetime.date(2026, 3, 21), Decimal("-80.25"), "Groceries", "NL91", "EUR")]
    assert rows[0]["transaction_id"] == "NTRFNONREF//M-1"
    assert [r["text"] for r in flat.mt940_unread(files).collect()] == [":61:260322RD1,00X"]
    b = flat.mt940_balances(files).first()
    assert (b["opening_balance"], b["closing_balance"]) == (1000, Decimal("2170.25"))
    out = verification.verify_balance(flat.mt940_transactions(files), "1000.00", "2170.25").first()
    assert out["status"] == "verified"


@pytest.mark.parametrize(
    ("text", "amounts"),
    [
        ("Date,Description,Amount,Currency,Balance,Account,Reference\n2026-03-20,Pay,2500.00,EUR,5000.00,007,R1\n2026-03-21,Rent,-1200.00,EUR,3800.00,007,R2\n", ["2500", "-1200"]),
        ("Booking Date;Details;Credit;Debit;CCY;Running Balance;IBAN;Ref\n2026-03-20;a;1250.50;;EUR;1;X;1\n2026-03-21;b;;200.25;EUR;2;X;2\n", ["1250.5", "-200.25"]),
        ("Date opération;Libellé;Débit;Crédit;Devise;Référence\n20/03/2026;Loyer;1 234,56;;EUR;F1\n21/03/2026;Salaire;;3 500,00;EUR;F2\n", ["-1234.56", "3500"]),
        ("Fecha;Concepto;Importe;Moneda;Cuenta;Referencia\n2026-03-20;x;-4,50;EUR;1;2\n", ["-4.5"]),
    ],
)
def test_csv(spark, tmp_path, text, amounts):
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    rows = read_statement(spark, str(tmp_path / "f.csv")).orderBy("_row").collect()
    assert [r["amount"] for r in rows] == [Decimal(a) for a in amounts]
    s = flat.flat_summary(flat.csv_transactions(spark, str(tmp_path / "f.csv")), "_row").first()
    assert s["transaction_count"] == len(amounts)


def test_csv_keeps_leading_zeros_and_refuses_bad_amounts(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Date,Description,Amount,Account\n2026-03-20,a,12..34,007\n")
    with pytest.raises(Exception):  # noqa: B017
        read_statement(spark, str(tmp_path / "g.csv")).collect()
    rows = flat.csv_transactions(spark, str(tmp_path / "g.csv"), strict=False).collect()
    assert rows[0]["account_id"] == "007" and rows[0]["amount"] is None


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", TWO)
        z.writestr("bomb.xml", "0" * 2_000_000)
        z.writestr("empty.xml", "")
        z.writestr("n.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = {(r["member"]): r for r in archives.read_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert rows["a.xml"]["error"] is None and rows["bomb.xml"]["error"] == "compression ratio too high" and rows["empty.xml"]["error"] == "empty"
    assert rows[None]["error"].startswith("not an archive")
    good = archives.read_archives(spark, str(tmp_path / "z.zip")).where("error is null")
    assert camt.transactions(camt.statements_from_text(good)).count() == 3


def test_scan(spark, folder):
    (folder / "z.xml").write_text(TWO)  # the same statement once more
    found = scan(spark, str(folder))
    totals = found.totals().first()
    assert totals["file_count"] == 5 and totals["total_skipped"] == 3 and totals["total_unique"] == 3 + 2 + 2 + 3
    assert found.failures.count() == 1
    seen = found.transactions.where("is_new").select("dedup_key")
    assert scan(spark, str(folder), seen).totals().first()["total_unique"] == 0
    status = {r["account_id"]: r["status"] for r in found.continuity.collect()}
    assert status["DE1"] == "discrepancy"  # opens at 10000 again


def test_parse_files(spark, folder):
    names = [str(folder / n) for n in ("c.mt940", "a.xml", "e.txt")]
    tx, status = parse_files(spark, names)
    assert tx.count() == 5
    assert [r["status"] for r in status.collect()] == ["SUCCESS", "SUCCESS", "FAILED"]


def test_pages(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF one  page")
    rows = pages.extract_pages(spark, str(tmp_path / "p.pdf"), lambda data: [data.decode(), "x"]).first()
    assert rows["pages"] == ["%PDF one page", "x"]

    def broken(data):
        raise ValueError("no text layer")

    assert pages.extract_pages(spark, str(tmp_path / "p.pdf"), broken).first()["error"] == "no text layer"
    images = pages.render_pages(spark, str(tmp_path / "p.pdf"), lambda data, most: [b"img"] * 9)
    assert images.count() == 5
    assert pages.render_strips(images, lambda i, top, bottom: i + str(bottom > top).encode()).where(F.col("image") == F.lit(b"imgTrue")).count() == 20
