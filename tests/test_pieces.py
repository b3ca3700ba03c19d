"""Documents that no task holds: cut from streams, built from pieces, equal to those read whole."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from test_files import TWO, balance, document, entry, statement
from test_large import PAIN, plain

from tallyloom.plans import files, folders
from tallyloom.sources import archives, camt, flat, large, pain001

ONE = entry("1.50", "CRDT")
ODD = {
    "comment": document(statement("A", ONE + "<!-- <Ntry> --> " + ONE + ONE, "1", "2")),
    "cdata": document(statement("A", ONE + ONE.replace("Rent", "<![CDATA[</Ntry><Ntry>]]>") + ONE, "1", "2")),
    "prefix": document(statement("A", ONE + ONE.replace("<Amt ", "<n:Amt ").replace("</Amt>", "</n:Amt>") + ONE, "1", "2"), ' xmlns:n="urn:n"'),
    "attribute": document(statement("A", ONE + ONE.replace("<Ntry>", "<Ntry a='>'>") + "<Ntry/>" + ONE.replace("</Ntry>", "</Ntry >"), "1", "2")),
    "elsewhere": document(statement("A", ONE, "1", "2") + f"<Rpt>{ONE}</Rpt>" + statement("B", f" {ONE}\n{ONE}", "1", "2")),
    "late": document("<Stmt><Id>S</Id>" + ONE + balance("CLBD", "3") + ONE + "</Stmt>"),
    "many": document(statement("A", ONE * 700, "1", "2")),
}


class Bites(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def __init__(self, data: bytes, n: int):
        super().__init__(data)
        self.n = n

    def read(self, _=-1):
        return super().read(self.n)


def copied(data: bytes, units):
    """The rows of a parser that copies every unit."""
    unit = units()
    unit.open = b"<none>"
    return list(unit.rows(io.BytesIO(data)))


@pytest.mark.parametrize("name", ODD)
@pytest.mark.parametrize("bite", [1, 7, 300, 1 << 16])
def test_cut_entries_equal_copied_ones(name, bite):
    data = ODD[name].encode()
    if len(data) // bite > 50_000:
        bite = 97
    clean = lambda rows: [(*r[:-1], r[-1].replace(" a='>'", "").replace(' a="&gt;"', "").replace("\n", "")) for r in rows]
    assert clean(large._Entries().rows(Bites(data, bite))) == clean(copied(data, large._Entries))


def test_other_encodings_are_read():
    text = TWO.replace('<?xml version="1.0"?>', '<?xml version="1.0" encoding="{}"?>').replace("JANE", "ÄNNE")
    for encoding in ("utf-16", "iso-8859-1", "utf-8"):
        rows = list(large._Entries().rows(io.BytesIO(text.replace("{}", encoding).encode(encoding))))
        assert len(rows) == 4 and "ÄNNE" in rows[0][-1]


def test_parts_equal_whole_statements(spark, tmp_path):
    for name in ("elsewhere", "late", "many"):
        (tmp_path / f"{name}.xml").write_text(ODD[name])
    (tmp_path / "two.xml").write_text(TWO)
    path = str(tmp_path / "*.xml")
    whole, parts = camt.statements(spark, path), camt.parts(spark, path)
    for f in (camt.transactions, camt.balances, camt.stats, camt.summary, camt.statement_balances):
        assert f(parts).columns == f(whole).columns and plain(f(parts)) == plain(f(whole)), f.__name__
    (tmp_path / "p.xml").write_text(PAIN)
    docs, parts = pain001.initiations(spark, str(tmp_path / "p.xml")), pain001.parts(spark, str(tmp_path / "p.xml"))
    for f in (pain001.payments, pain001.counts, pain001.summary):
        assert plain(f(parts)) == plain(f(docs)), f.__name__
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "hollow.xml").write_text(document("<Stmt><Id>S</Id></Stmt>"))
    with pytest.raises(Exception, match="neither account"):
        camt.balances(camt.parts(spark, str(tmp_path / "h"))).collect()
    with pytest.raises(Exception, match="neither account"):
        camt.summary(camt.parts(spark, str(tmp_path / "h"))).collect()


def test_no_document_is_a_row(spark, sf_dir):
    """Neither an account's lines nor its statement come together in one row, from tables to results."""
    queries = files.QUERIES | {n: folders.QUERIES[n] for n in ("pain_masked", "pain_transfers", "pain_counts", "zip_transactions")}
    for name, query in queries.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "regexp_extract_all" not in plan, name


def test_large_member_of_an_archive(spark, tmp_path):
    n = 11_000_000 // len(ONE)
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", document(statement("A", ONE * n, "1", "2")))
        z.writestr("b.xml", TWO[:900])
        z.writestr("empty.xml", "")
    found = archives.camt_parts(spark.read.format("binaryFile").load(str(tmp_path / "z.zip")).select("path", "content"), max_ratio=1e9)
    assert camt.transactions(found.where("member = 'a.xml' and error is null")).count() == n > 0
    assert {r["member"]: r["error"][:13] for r in found.where("error is not null").collect()} == {"b.xml": "malformed XML", "empty.xml": "empty"}
    guarded = archives.camt_parts(spark.read.format("binaryFile").load(str(tmp_path / "z.zip")).select("path", "content"))
    assert guarded.where("member = 'a.xml'").first()["error"] == "compression ratio too high"


def test_ofx_head_may_come_last(spark):
    text = "<STMTTRN><TRNAMT>1.00\n<NAME>a<STMTTRN><trnamt>2\n<MEMO>b\n<NAME>c</STMTTRN></BANKTRANLIST><STMTTRN><TRNAMT>9<CURDEF>\n<CURDEF> EUR \n<CURDEF>USD<ACCTID>7"
    one = spark.createDataFrame([("f", text)], "_file string, value string")
    bits = spark.createDataFrame([("f", k, c) for k, c in enumerate(text)], "_file string, k int, text string")
    for source in (one, large.in_order(bits, ["k"])):
        rows = flat.ofx_transactions(source).orderBy("_entry").collect()
        assert [(int(r["amount"]), r["description"], r["currency"], r["account_id"]) for r in rows] == [(1, "a", "EUR", "7"), (2, "b", "EUR", "7")]


def test_mt940_pieces_and_line_ends(spark):
    text = ":25: A \r\n:60F:C200101EUR0,00\r\n:86:before\r\n:61:200102C1,00N1\r\n:86:x\r\n:86: y \r\n:61:bad\r\n:86:z\r\n:62F:C200101USD0,00\r\n:61:200103D2,50N2"
    bits = spark.createDataFrame([("f", k, c) for k, c in enumerate(text)], "_file string, k int, text string")
    rows = flat.mt940_transactions(large.in_order(bits, ["k"])).orderBy("_entry").collect()
    assert [(r["_entry"], str(r["amount"].normalize()), r["description"], r["account_id"], r["currency"]) for r in rows] == [(0, "1", "y", "A", "EUR"), (2, "-2.5", None, "A", "USD")]
    lines = flat.mt940_lines(spark.createDataFrame([("f", text)], "_file string, value string")).collect()
    assert len(lines) == 10 and lines[-1]["entry"] == 3 and flat.mt940_unread(large.in_order(bits, ["k"])).first()["text"] == ":61:bad"


def test_written_files_keep_their_order(spark, tmp_path):
    rows = spark.range(30_000).select(F.concat(F.lit("long name of an account "), (F.col("id") % 7).cast("string")).alias("_file"), F.lit(1).alias("place"), (30_000 - F.col("id")).alias("idx"), F.col("id").cast("string").alias("text"))
    folder = folders.write_files(rows.repartition(5), str(tmp_path / "out"), ".txt")
    for k in range(7):
        lines = (tmp_path / "out" / f"long name of an account {k}.txt").read_text().split()
        assert len(lines) > 4000 and lines == sorted(lines, key=int, reverse=True), folder
