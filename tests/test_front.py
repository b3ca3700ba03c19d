"""Front doors and streams."""

from __future__ import annotations

import io
import json

import pytest
from test_files import TWO, document, entry, statement

from tallyloom import api, cli, validation
from tallyloom.exceptions import InputError, PayloadError
from tallyloom.ingest import smart_ingest, vision_messages, warn_if_data_leaves
from tallyloom.sources import camt
from tallyloom.streaming import ingest as streams

ONE = document(statement("DE1", entry("1250.50", "CRDT") + entry("500.25", "DBIT", text="Food"), "10000.00", "10750.25"))
ANSWER = '{"opening_balance": "0", "closing_balance": "5", "transactions": [{"booking_date": "2026-01-01", "description": "Coffee", "amount": "5", "confidence": 0.9}]}'


@pytest.fixture
def xml(tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(ONE)
    return path


def test_deterministic(spark, xml):
    result = smart_ingest(spark, str(xml))
    assert (result.source_method, result.source_format, result.warnings) == ("deterministic", "camt", []) and result.transactions.count() == 2
    assert result.verification.first()["status"] == "verified"
    assert smart_ingest(spark, str(xml), opening_balance="1", closing_balance="2").verification.first()["status"] == "discrepancy"


def test_models(spark, tmp_path):
    pdf = tmp_path / "p.pdf"
    pdf.write_bytes(b"%PDF")
    words = "Statement of account, Coffee 5.00, closing balance 5.00, thank you"
    out = smart_ingest(spark, str(pdf), read_pages=lambda d: ["first", words], extract=lambda prompt: "```json\n" + ANSWER + "\n```")
    row = out.transactions.first()
    assert out.source_method == "llm" and row["source_page"] == 1 and "Coffee" in row["raw_source_text"] and out.verification.first()["status"] == "verified"
    seen = smart_ingest(spark, str(pdf), read_pages=lambda d: [""], look=lambda prompt, images: ANSWER, render=lambda d, n: [b"png"])
    assert seen.source_method == "vision" and any(w.startswith("LOW_TEXT_DENSITY: extracted 0 chars") for w in seen.warnings)
    with pytest.raises(PayloadError):
        smart_ingest(spark, str(pdf), read_pages=lambda d: [""])
    assert vision_messages("p", [b"x"])[0]["content"][1]["image_url"]["url"].endswith("eA==")
    assert warn_if_data_leaves("https://models.example") and not warn_if_data_leaves("http://localhost:1")


def test_validation(tmp_path, xml):
    assert validation.check_input(str(xml), blocked=()) == xml.resolve()
    for bad in ("../a.xml", "/x/${HOME}.xml", "a‮.xml", str(tmp_path / "a.exe"), str(tmp_path / "none.xml")):
        with pytest.raises(InputError):
            validation.check_input(bad, blocked=())
    with pytest.raises(InputError, match="/root"):
        validation.check_path("/root/a.xml")
    (tmp_path / "z.csv").write_bytes(b"PK\x03\x04")
    with pytest.raises(InputError, match="binary"):
        validation.check_input(str(tmp_path / "z.csv"), blocked=())
    with pytest.raises(InputError, match="size"):
        validation.check_input(str(xml), max_bytes=10, blocked=())
    assert validation.safe_filename('a<b>:"c".xml ') == "a_b___c_.xml" and validation.safe_filename("..") == "unnamed_file" and len(validation.safe_filename("x" * 300 + ".csv")) == 255
    (tmp_path / "out").mkdir()
    (tmp_path / "l.xml").symlink_to(tmp_path / "out")
    with pytest.raises(InputError):
        validation.check_input(str(tmp_path / "l.xml"), blocked=())


def test_cli(spark, xml, tmp_path, capsys):
    assert cli.run(spark, ["--type", "camt", "--input", str(xml), "--output", str(tmp_path / "s.csv")]) == 0
    assert "750.25" in (tmp_path / "s.csv").read_text()
    assert cli.run(spark, ["--type", "camt", "--streaming", "--input", str(xml)]) == 0
    shown = capsys.readouterr().out
    assert "***REDACTED***" in shown and "JANE" not in shown
    assert cli.run(spark, ["--type", "camt", "--streaming", "--show-pii", "--input", str(xml)]) == 0 and "JANE" in capsys.readouterr().out
    assert cli.run(spark, ["--type", "ingest", "--input", str(xml), "--output", str(tmp_path / "i.csv")]) == 0
    assert (tmp_path / "i.csv").read_text().startswith("transaction_hash,source_method")
    assert cli.run(spark, ["--type", "camt", "--input", str(tmp_path / "no.xml")]) == 1


def test_cli_review(spark, tmp_path):
    rows = [{"amount": "5", "booking_date": "2026-01-01", "description": "x", "confidence": 0.1}, {"amount": "1", "description": "y"}]
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "transactions": rows, "verification": {"status": "discrepancy", "opening_balance": "0", "closing_balance": "5"}}))
    (tmp_path / "e.jsonl").write_text('{"row_index": 1, "action": "delete"}\n{"row_index": 0, "action": "edit", "description": "better"}\n')
    assert cli.run(spark, ["--type", "review", "--input", str(tmp_path / "r.json"), "--edits", str(tmp_path / "e.jsonl")]) == 0
    result = json.loads((tmp_path / "r.json").read_text())
    assert result["verification"]["status"] == "verified" and result["transactions"][0]["description"] == "better" and len(result["transactions"]) == 1
    assert result["audit_trail"][-1] == {"action": "reverify", "status_before": "discrepancy", "status_after": "verified"}


def test_api(spark):
    app = api.application(spark)

    def call(method, route, body=b"", name="a.xml"):
        got = []
        out = app({"REQUEST_METHOD": method, "PATH_INFO": route, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body), "HTTP_X_FILENAME": name}, lambda status, headers: got.append(status))
        return got[0][:3], json.loads(b"".join(out))

    assert call("GET", "/health") == ("200", {"status": "ok"})
    status, body = call("POST", "/ingest", ONE.encode())
    assert status == "200" and body["transaction_count"] == 2 and body["verification"]["status"] == "verified" and "actual_delta" not in body["verification"]
    assert call("POST", "/ingest", b"PK\x03\x04")[0] == "400" and call("POST", "/ingest", b"")[0] == "400" and call("POST", "/ingest", b"hello", "a.txt")[0] == "422" and call("GET", "/x")[0] == "404"


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.xml").write_text(TWO)
    streams.to_csv(streams.camt_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    want = camt.transactions(camt.statements(spark, str(folder)))
    key = lambda df: sorted((float(r["Amount"]), r["Currency"], r["Reference"]) for r in df.collect())
    assert key(got) == key(want)


def test_idempotent_stream(spark, tmp_path):
    from tallyloom.operators.normalize import normalize

    folder = tmp_path / "in"
    folder.mkdir()
    seen = streams.SeenKeys(spark, str(tmp_path / "seen"))

    def ingest(state):
        tx = normalize(streams.camt_stream(spark, str(folder)))
        sink = lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{state}-{n}"))
        streams.deduplicated(tx, seen, sink, ["_file"], ["_stmt_index", "_entry"], str(tmp_path / state)).start().awaitTermination()

    (folder / "a.xml").write_text(ONE)
    ingest("s1")
    assert seen.frame().count() == 2
    (folder / "b.xml").write_text(TWO)  # has one row of the first
    ingest("s1")
    assert seen.frame().count() == 4
    ingest("s1")
    assert seen.frame().count() == 4


def test_strips_and_rules_and_folders(spark, tmp_path):
    from tallyloom.ingest import vision_strips
    from tallyloom.operators.enrichment import load_rules

    strips = spark.createDataFrame([("f", 0, k, b"png%d" % k) for k in range(3)], "_file string, page int, strip int, image binary")
    other = ANSWER.replace("Coffee", "Tea").replace('"opening_balance": "0"', '"opening_balance": null')
    rows, balances = vision_strips(strips, lambda prompt, images: other if images[0] == b"png0" else ANSWER)
    assert sorted(r["description"] for r in rows.collect()) == ["Coffee", "Tea"] and balances.first()["opening_balance"] == 0
    (tmp_path / "rules.json").write_text(json.dumps({"default": "Other", "rules": [{"pattern": "a", "account": "A"}, {"pattern": "b"}, {"pattern": "c", "account": "C"}]}))
    table, default = load_rules(spark, str(tmp_path / "rules.json"))
    assert default == "Other" and [r["account"] for r in table.orderBy("ord").collect()] == ["A", "C"]
    folder = tmp_path / "camt"
    folder.mkdir()
    (folder / "a.xml").write_text(ONE)
    (folder / "b.xml").write_text(ONE[:-80])
    files, statements, tx = camt.read_folder(spark, str(folder))
    assert [r["status"] for r in files.collect()] == ["Success", "Failed: malformed XML"] and tx.where("_file like '%a.xml'").count() == 2 and statements.count() >= 1
