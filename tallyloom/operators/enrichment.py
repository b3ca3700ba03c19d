"""Accounts and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = tuple("Bank Fees|Cash Advance|Community|Food and Drink|Healthcare|Interest|Payment|Recreation|Service|Shops|Tax|Transfer|Travel".split("|"))
NO_RESULT = "LLM did not return a result for this row"
#: Rules up to which they become one CASE expression instead of a join.
INLINE_RULES = 500


def map_accounts(description: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Account of the first rule whose pattern is found, whatever the case; the default if none is."""
    out = None
    for pattern, account in rules:
        hit = F.coalesce(description, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(hit, F.lit(account)) if out is None else out.when(hit, F.lit(account))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def load_rules(spark, path: str) -> tuple[DataFrame, str]:
    """(rules in order, the default account) of a JSON file {"default": ..., "rules": [{"pattern", "account"}]}; entries that aren't rules are left out."""
    raw = spark.read.schema("default string, rules array<struct<pattern:string,account:string>>").option("multiLine", True).json(path)
    rules = raw.select(F.posexplode("rules").alias("ord", "r")).select("ord", "r.pattern", "r.account").where("pattern is not null and account is not null")
    first = raw.select("default").first()
    return rules, (first["default"] if first else None) or "Expenses:Uncategorized"


def map_accounts_by(tx: DataFrame, rules: DataFrame, default: str, index: str = "idx", text: str = "description") -> DataFrame:
    """``tx`` with account, from rules (ord, pattern, account) in a table.

    Rules are configuration: up to INLINE_RULES they are read to the driver and
    become a CASE, in one pass without a join; more are crossed with the
    distinct descriptions only.
    """
    given = rules.orderBy("ord").limit(INLINE_RULES + 1).collect()
    if len(given) <= INLINE_RULES:
        return tx.withColumn("account", map_accounts(F.col(text), [(r["pattern"], r["account"]) for r in given], default))
    texts = tx.select(text).distinct()
    hit = F.expr(f"coalesce({text}, '') rlike concat('(?i)', pattern)")
    found = texts.crossJoin(rules).where(hit).groupBy(text).agg(F.min_by("account", "ord").alias("account")).withColumnRenamed(text, "__text")
    return tx.join(found, tx[text].eqNullSafe(F.col("__text")), "left").drop("__text").withColumn("account", F.coalesce("account", F.lit(default)))


def valid_category(category: Column, schema: tuple[str, ...] = CATEGORIES) -> Column:
    """The schema's own spelling of a category, or null."""
    known = F.create_map(*(x for c in schema for x in (F.lit(c.lower()), F.lit(c))))
    return F.try_element_at(known, F.lower(F.trim(category)))


def attach_categories(tx: DataFrame, results: DataFrame, index: str = "idx", schema: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``tx`` with category, is_business_expense, enrichment_confidence and rationale from results (index, pos, category, is_business_expense, confidence, rationale); of several for one row the last counts."""
    fields = ("category", "is_business_expense", "confidence", "rationale")
    last = results.groupBy(F.col("index").alias("__index")).agg(F.max_by(F.struct(*fields), "pos").alias("__r"))
    joined = tx.drop("category", "is_business_expense", "enrichment_confidence", "rationale").join(last, tx[index] == F.col("__index"), "left")
    confidence = F.col("__r.confidence").cast("double")
    return joined.withColumns({
        "category": valid_category(F.col("__r.category"), schema), "is_business_expense": F.col("__r.is_business_expense").cast("boolean"),
        "enrichment_confidence": F.when(confidence.between(0.0, 1.0) & ~F.isnan(confidence), confidence),
        "rationale": F.when(F.col("__r").isNull(), F.lit(NO_RESULT)).otherwise(F.col("__r.rationale")),
    }).drop("__index", "__r")


def prompt_row(number: Column, booking_date: Column, amount: Column, description: Column) -> Column:
    """One line of a categorizer's prompt."""
    from ..functions import amount_key, sanitize_prompt

    date = F.coalesce(booking_date.cast("string"), F.lit("????-??-??"))
    key = amount_key(amount)
    padded = F.when(F.length(key) < 10, F.lpad(key, 10, " ")).otherwise(key)
    return F.concat(number.cast("string"), F.lit(". "), date, F.lit(" "), padded, F.lit(" "), F.substring(sanitize_prompt(description), 1, 80))


def chunks(tx: DataFrame, by: list[str], order: list[str], size: int = 25) -> DataFrame:
    """``tx`` with chunk and chunk_index, for a model that takes ``size`` rows at once."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return tx.withColumn("__n", n).withColumn("chunk", F.floor(F.col("__n") / size).cast("int")).withColumn("chunk_index", (F.col("__n") % size).cast("int")).drop("__n")


def categorize(tx: DataFrame, complete, by: list[str], order: list[str], size: int = 25, schema: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``tx`` with categories from ``complete`` (prompt -> JSON text), called for each chunk on the executors.

    A chunk whose answer can't be used keeps its rows, without a category and
    with the reason as rationale.
    """
    import pandas as pd

    from .payload import parse_payload

    base = chunks(tx, by, order, size).drop("category", "is_business_expense", "enrichment_confidence", "rationale")
    rows = base.withColumn("__line", prompt_row(F.col("chunk_index"), F.col("booking_date"), F.col("amount"), F.col("description")))
    known = {c.lower(): c for c in schema}
    kinds = base.schema.add("category", "string").add("is_business_expense", "boolean").add("enrichment_confidence", "double").add("rationale", "string")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_index")
        found, reason = {}, NO_RESULT
        try:
            payload = parse_payload(complete("Categories: " + ", ".join(schema) + "\n" + "\n".join(frame["__line"])))
            for entry in payload["results"]:
                found[int(entry["index"])] = entry
        except Exception as e:  # the answer is advice: rows stay without it
            reason = f"categorization failed: {e}"
        out = frame.drop(columns="__line")
        own = [found.get(int(k)) for k in frame["chunk_index"]]
        text = lambda e, k: e[k] if e and isinstance(e.get(k), str) else None
        number = lambda e: float(e["confidence"]) if e and isinstance(e.get("confidence"), (int, float)) and not isinstance(e["confidence"], bool) and 0 <= e["confidence"] <= 1 else None
        out["category"] = [known.get(text(e, "category").strip().lower()) if text(e, "category") else None for e in own]
        out["is_business_expense"] = pd.array([e.get("is_business_expense") if e and isinstance(e.get("is_business_expense"), bool) else None for e in own], dtype="boolean")
        out["enrichment_confidence"] = pd.array([number(e) for e in own], dtype="Float64")
        out["rationale"] = [reason if e is None else (None if e.get("rationale") is None else str(e["rationale"])) for e in own]
        return out

    return rows.groupBy(*by, "chunk").applyInPandas(one, kinds)
