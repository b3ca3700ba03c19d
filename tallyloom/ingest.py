"""From a file of any kind to verified rows: by its format, by a text model, or by a vision model.

Models are functions that the caller brings: ``extract(prompt) -> answer`` and
``look(prompt, images) -> answer``.  Nothing here opens a connection.
"""

from __future__ import annotations

import base64
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exceptions import FormatError, PayloadError
from .operators import payload, verification
from .operators.dedup import merge_strips
from .operators.normalize import normalize
from .sources import pages as page_source
from .sources.registry import FORMATS, file_index

log = logging.getLogger(__name__)

_WARNED: set[str] = set()


def extraction_prompt(text: str) -> str:
    return (
        "List every transaction of this bank statement in date order as one JSON object with account_id, currency, opening_balance, closing_balance and transactions; "
        "each transaction has booking_date and value_date (YYYY-MM-DD), description, amount (text, negative for debits), currency, reference, confidence (0 to 1). Use null for what isn't there.\n\n" + text
    )


def vision_messages(prompt: str, images: list[bytes]) -> list[dict]:
    """A chat message of text and PNGs."""
    parts: list[dict] = [{"type": "text", "text": prompt}]
    parts += [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(i).decode()}} for i in images]
    return [{"role": "user", "content": parts}]


def model_settings(model: str | None = None, api_base: str | None = None, prefix: str = "STATEMENTS") -> tuple[str | None, str | None]:
    """A model and its address: as given, else from the environment."""
    return model or os.environ.get(f"{prefix}_MODEL"), api_base or os.environ.get(f"{prefix}_API_BASE")


def warn_if_data_leaves(api_base: str | None) -> bool:
    """Say once for each address that statements are sent there; True if it isn't this machine."""
    remote = not api_base or not any(h in api_base for h in ("localhost", "127.0.0.1", "[::1]"))
    if remote and (api_base or "") not in _WARNED:
        _WARNED.add(api_base or "")
        log.warning("statement data leaves this machine: %s", api_base or "the provider's default address")
    return remote


@dataclass(frozen=True)
class IngestResult:
    """``transactions`` and the one-row ``verification`` are frames; ``trail`` tells of later edits."""

    source_method: str
    source_format: str
    transactions: DataFrame
    verification: DataFrame | None
    warnings: list[str] = field(default_factory=list)
    trail: DataFrame | None = None


def smart_ingest(spark: SparkSession, path: str, *, opening_balance: str | None = None, closing_balance: str | None = None, extract: Callable[[str], str] | None = None, look: Callable[[str, list[bytes]], str] | None = None, read_pages: Callable[[bytes], list[str]] | None = None, render: Callable[[bytes, int], list[bytes]] | None = None) -> IngestResult:
    """One file by the first way that works.

    Balances that the file itself states are used where none are given.
    """
    warnings: list[str] = []
    found = file_index(spark, path, recursive=False).first()
    if found is None:
        raise FormatError(f"no such file: {path}")
    fmt = found["format"]
    if fmt in FORMATS:
        try:
            tx = normalize(FORMATS[fmt].read(spark, path), source=path)
            opening, closing = opening_balance, closing_balance
            if FORMATS[fmt].balances and opening is None and closing is None:
                stated = FORMATS[fmt].balances(spark, path).limit(2).collect()
                if len(stated) == 1:
                    opening, closing = (str(v) if v is not None else None for v in (stated[0]["opening_balance"], stated[0]["closing_balance"]))
            tx.select(F.count("amount")).collect()  # a bad row fails here and not later
            check = verification.verify_transactions(tx, opening, closing) if opening is not None and closing is not None else None
            return IngestResult("deterministic", fmt, tx, check, warnings)
        except Exception as e:  # the other ways are left
            warnings.append(f"the {fmt} reader failed: {e}")
    else:
        warnings.append("no statement format matched; going on to the text and vision models")
    if read_pages is None:
        raise FormatError(f"no reader takes {path}: {'; '.join(warnings)}")
    pages = page_source.extract_pages(spark, path, read_pages).first()
    if pages["error"]:
        raise PayloadError(f"no text from {path}: {pages['error']}")
    text = "\n".join(pages["pages"])
    if len(text.strip()) < page_source.MIN_TEXT:
        warnings.append(f"LOW_TEXT_DENSITY: extracted {len(text.strip())} chars (threshold {page_source.MIN_TEXT}). Routing to vision model.")
        if look is None or render is None:
            raise PayloadError("a vision model and a renderer are needed for this file")
        images = [bytes(r["image"]) for r in page_source.render_pages(spark, path, render).orderBy("page").collect()]
        method, answer = "vision", look(extraction_prompt(""), images)
    else:
        if extract is None:
            raise PayloadError("a text model is needed for this file")
        method, answer = "llm", extract(extraction_prompt(text))
    answers = spark.createDataFrame([(path, answer, text)], "source string, answer string, source_text string")
    rows = payload.payload_rows(answers, method=method, by=["source"], source_text="source_text")
    tx = traced(rows, spark.createDataFrame([(path, pages["pages"])], "source string, pages array<string>"), "source")
    head = payload.parse_payload(answer)
    opening = opening_balance if opening_balance is not None else head.get("opening_balance")
    closing = closing_balance if closing_balance is not None else head.get("closing_balance")
    return IngestResult(method, fmt or "unknown", tx, verification.verify_transactions(tx, opening, closing), warnings)


def traced(tx: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """``tx`` with the page on which its description stands, where it has none."""
    from .functions.text import first_page_with

    joined = tx.join(pages, key, "left")
    return joined.withColumn("source_page", F.coalesce("source_page", first_page_with(F.col("description"), F.col("pages")))).drop("pages")


def vision_strips(strips: DataFrame, look: Callable[[str, list[bytes]], str]) -> tuple[DataFrame, DataFrame]:
    """(rows, balances) of page strips (_file, page, strip, image), each shown to the model by the executors.

    Rows that two strips show count once; the first strip that states a
    balance supplies it.
    """
    prompt = extraction_prompt("")
    ask = F.udf(lambda image: look(prompt, [bytes(image)]), "string")
    answers = strips.select("_file", "page", "strip", ask("image").alias("answer"))
    rows = payload.payload_rows(answers, method="vision", by=["_file", "page", "strip"]).withColumn("source_page", F.coalesce("source_page", "page"))
    at = F.struct("page", "strip", "source_index")
    balances = rows.groupBy("_file").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("opening_balance", "closing_balance")))
    return merge_strips(rows, ["_file"], ["page", "strip", "source_index"]), balances
