"""HTTP front door: POST /ingest and GET /health, as a WSGI application of the standard library's kind."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .exceptions import StatementError
from .ingest import smart_ingest
from .sinks.export import exact_text
from .validation import content_fault, safe_filename

MAX_UPLOAD, CHUNK = 25 << 20, 1 << 20


def application(spark: SparkSession) -> Callable[[dict, Callable], Iterable[bytes]]:
    """The application over a session.  The body is the file, its name is in X-Filename."""

    def answer(start: Callable, status: str, body: dict) -> list[bytes]:
        start(status, [("Content-Type", "application/json")])
        return [json.dumps(body, default=str).encode()]

    def app(environ: dict, start: Callable) -> Iterable[bytes]:
        route = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/")
        if route == ("GET", "/health"):
            return answer(start, "200 OK", {"status": "ok"})
        if route != ("POST", "/ingest"):
            return answer(start, "404 Not Found", {"detail": "no such route"})
        name = safe_filename(environ.get("HTTP_X_FILENAME", ""))
        left, parts, size = int(environ.get("CONTENT_LENGTH") or 0), [], 0
        while left > 0 and (part := environ["wsgi.input"].read(min(CHUNK, left))):
            left -= len(part)
            size += len(part)
            if size > MAX_UPLOAD:
                return answer(start, "413 Content Too Large", {"detail": "the file is too large"})
            parts.append(part)
        data = b"".join(parts)
        if not data or name == "unnamed_file":
            return answer(start, "400 Bad Request", {"detail": "a named file is needed"})
        if fault := content_fault(data[:1024]):
            return answer(start, "400 Bad Request", {"detail": fault})
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder, name)
            path.write_bytes(data)
            try:
                result = smart_ingest(spark, str(path))
                rows = [json.loads(r["j"]) for r in result.transactions.select(F.to_json(F.struct(*exact_text(result.transactions))).alias("j")).collect()]
                check = result.verification.first().asDict() if result.verification is not None else None
            except StatementError as e:
                return answer(start, "422 Unprocessable Content", {"detail": str(e)})
        if check:
            check = {k: v for k, v in check.items() if k not in ("expected_delta", "actual_delta")}
        return answer(start, "200 OK", {"source_method": result.source_method, "source_format": result.source_format, "transaction_count": len(rows), "transactions": rows, "verification": check, "warnings": result.warnings})

    return app
