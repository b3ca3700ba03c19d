"""Answers of a model: JSON in prose, and its rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize_description, transaction_hash
from ..functions.amounts import MONEY_SQL, plain_amount
from ..functions.dates import iso_date

_FENCED = re.compile(r"`{3}(?:json)?\s*(\{.*?\})\s*`{3}", re.DOTALL)

BOX = "struct<x0:double,y0:double,x1:double,y1:double,page_index:int>"
ROW = f"struct<booking_date:string,value_date:string,description:string,amount:string,currency:string,reference:string,confidence:double,page:int,bbox:{BOX}>"
PAYLOAD = f"struct<account_id:string,currency:string,opening_balance:string,closing_balance:string,transactions:array<{ROW}>>"


def parse_payload(text: str) -> dict:
    """The first JSON object in an answer, fenced or not; what follows it doesn't count."""
    fenced = _FENCED.search(text or "")
    body = fenced.group(1) if fenced else text or ""
    at = body.find("{")
    if at < 0:
        raise ValueError("the answer has no JSON object")
    payload, _ = json.JSONDecoder().raw_decode(body[at:])
    if not isinstance(payload, dict):
        raise ValueError("the answer isn't an object")
    return payload


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The JSON object of each answer, null where there is none."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(parse_payload(t)) if t is not None else None
        except ValueError:
            return None

    return text.map(one).astype("object")


def message_content(response: Column) -> Column:
    """The text of a chat completion."""
    return F.get_json_object(response, "$.choices[0].message.content")


def valid_box(box: Column) -> Column:
    """A box within the page, with its corners in order, on a page."""
    inside = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        inside = inside & box[c].between(0.0, 1.0)
    return F.coalesce(inside & (box["x0"] <= box["x1"]) & (box["y0"] <= box["y1"]) & (box["page_index"] >= 0), F.lit(False))


def payload_rows(answers: DataFrame, text: str = "answer", method: str = "llm", by: list[str] | None = None, source_text: str | None = None) -> DataFrame:
    """Silver-like rows of each answer; an unreadable answer, amount, date, confidence or box raises."""
    from ..functions.text import context_slice

    parsed = answers.withColumn("__p", F.from_json(json_object(text), PAYLOAD))
    rows = parsed.withColumn("__p", F.coalesce("__p", F.raise_error(F.lit("an answer has no JSON object")).cast(PAYLOAD))).select(*(by or []), *([source_text] if source_text else []), "__p", F.posexplode("__p.transactions").alias("source_index", "t"))
    fail = lambda what, kind: F.raise_error(F.lit(f"an answer's {what} is not valid")).cast(kind)
    t = lambda c: F.col(f"t.{c}")
    date = lambda c: F.when(F.coalesce(t(c), F.lit("")) != "", F.coalesce(iso_date(t(c)), fail(c, "date")))
    amount = F.coalesce(plain_amount(t("amount")), fail("amount", MONEY_SQL))
    confidence = F.when(t("confidence").isNotNull(), F.when(t("confidence").between(0.0, 1.0), t("confidence")).otherwise(fail("confidence", "double")))
    box = F.when(t("bbox").isNotNull(), F.when(valid_box(t("bbox")), t("bbox")).otherwise(fail("bbox", BOX)))
    out = rows.withColumns({
        "account_id": F.col("__p.account_id"), "currency": F.upper(F.coalesce(F.nullif(t("currency"), F.lit("")), F.col("__p.currency"))), "amount": amount,
        "booking_date": date("booking_date"), "value_date": date("value_date"), "description": t("description"), "reference": t("reference"),
        "source_method": F.lit(method), "confidence": confidence, "source_bbox": box, "source_page": t("page"),
        "opening_balance": plain_amount(F.col("__p.opening_balance")), "closing_balance": plain_amount(F.col("__p.closing_balance")),
        "raw_source_text": context_slice(t("description"), F.col(source_text)) if source_text else F.lit(None).cast("string"),
    }).drop("__p", "t")
    none = F.lit(None).cast("string")
    out = out.withColumn("normalized_description", normalize_description(F.col("description")))
    return out.withColumn("transaction_hash", transaction_hash(F.col("booking_date"), F.col("value_date"), F.col("normalized_description"), F.col("amount"), none, F.col("reference")))
