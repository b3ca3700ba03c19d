"""Command line: read a statement, ingest a file, review a result."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exceptions import StatementError
from .ingest import smart_ingest
from .operators import privacy, review, verification
from .operators.normalize import with_identity
from .sinks import export
from .sources import camt, pain001
from .validation import check_input, check_output

CONSOLE_ROWS = 100


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description="Read, ingest and review account statements.")
    p.add_argument("--type", required=True, choices=["camt", "pain001", "ingest", "review"])
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--max-size", type=int, default=100, help="MB")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--show-pii", action="store_true", help="names and accounts in plain text")
    p.add_argument("--streaming", action="store_true", help="read as a stream")
    p.add_argument("--review-below", type=float, help="also review rows of less confidence")
    p.add_argument("--edits", help="JSON lines of row_index, action, description, amount, instead of questions")
    return p


def _emit(df: DataFrame, output: str | None, show_pii: bool) -> None:
    if output:
        rows = df.select(*export.exact_text(df))
        with check_output(output).open("w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(rows.columns)
            out.writerows(["" if v is None else v for v in r] for r in rows.toLocalIterator())  # a partition at a time
        return
    shown = df if show_pii else privacy.mask_by_name(df, parties=True)
    print(shown.limit(CONSOLE_ROWS).toPandas().to_string(index=False))


def _review(spark: SparkSession, args: argparse.Namespace) -> None:
    """Apply answers to the rows that need a look, and verify again."""
    path = check_input(args.input)
    result = json.loads(path.read_text())
    if result.get("schema_version", 1) != export.SCHEMA_VERSION:
        raise StatementError("unsupported schema_version")
    rows = result["transactions"]
    for k, r in enumerate(rows):
        r.setdefault("source_index", k)
    names = ("source_index", "amount", "currency", "booking_date", "value_date", "description", "reference", "transaction_id", "account_id", "source_page", "source_method", "confidence")
    kinds = "source_index int, amount string, currency string, booking_date string, value_date string, description string, reference string, transaction_id string, account_id string, source_page int, source_method string, confidence double"
    tx = spark.createDataFrame([tuple(float(r[n]) if n == "confidence" and r.get(n) is not None else r.get(n) for n in names) for r in rows], kinds)
    tx = with_identity(tx.withColumns({"amount": F.col("amount").cast("decimal(38,10)"), "booking_date": F.col("booking_date").cast("date"), "value_date": F.col("value_date").cast("date")}))
    before = (result.get("verification") or {}).get("status")
    open_rows = review.needs_review(tx, args.review_below if args.review_below is not None else -1.0, before)
    edits = []
    if args.edits:
        edits = [json.loads(line) for line in Path(args.edits).read_text().splitlines() if line.strip()]
    else:
        for r in open_rows.orderBy("source_index").collect():
            print(f"[{r['source_index']}] {r['booking_date']} {r['amount']} {r['description']!r}: (a)ccept, (e)dit, (s)kip, (d)elete, (q)uit")
            answer = (sys.stdin.readline() or "q").strip().lower()[:1]
            if answer == "q":
                break
            edit = {"row_index": r["source_index"], "action": {"a": "accept", "e": "edit", "d": "delete"}.get(answer, "skip")}
            if answer == "e":
                edit |= {"description": input("description: ") or None, "amount": input("amount: ") or None}
            edits.append(edit)
    frame = spark.createDataFrame([(e["row_index"], e["action"], e.get("description"), e.get("amount")) for e in edits], "source_index int, action string, description string, amount string")
    after, trail = review.apply_edits(tx, frame)
    balances = result.get("verification") or {}
    check = verification.verify_transactions(after, balances.get("opening_balance"), balances.get("closing_balance")).first().asDict()
    result["transactions"] = [json.loads(r) for r in after.orderBy("source_index").select(F.to_json(F.struct(*export.exact_text(after)), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"]]
    result["verification"] = {k: str(v) if v is not None else None for k, v in check.items()}
    result["audit_trail"] = [*result.get("audit_trail", []), *(r.asDict() for r in trail.orderBy("row_index").collect()), {"action": "reverify", "status_before": before, "status_after": check["status"]}]
    (Path(args.output) if args.output else path).write_text(json.dumps(result, indent=2, default=str))
    print(f"{len(edits)} answers; {before} -> {check['status']}")


def run(spark: SparkSession, argv: list[str]) -> int:
    args = arguments().parse_args(argv)
    try:
        path = str(check_input(args.input, args.max_size << 20))
        if args.type == "review":
            _review(spark, args)
        elif args.type == "ingest":
            result = smart_ingest(spark, path)
            _emit(export.ingest_projection(result.transactions), args.output, True)
        elif args.type == "camt":
            stmts = camt.statements(spark, path)
            _emit(camt.transactions(stmts, not args.show_pii, True) if args.streaming else camt.stats(stmts), args.output, args.show_pii)
        else:
            docs = pain001.initiations(spark, path)
            _emit(pain001.payments(docs, args.streaming and not args.show_pii), args.output, args.show_pii)
    except (StatementError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
