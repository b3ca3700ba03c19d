"""Parsing, masking, mapping, tracing and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import TX_SQL, load, transactions
from ..functions import context_slice as slice_of
from ..functions import flexible_date, locale_amount, sanitize_prompt, sanitize_source_name
from ..functions.text import first_page_with
from ..operators import enrichment, evaluation, privacy, review
from ..operators.normalize import normalize, split_rejects
from ..sinks import export, ledger
from ..sources import pages as page_source
from ..sources.flat import ofx_tag
from ..sources.registry import detect

MONEY = "decimal(38,2)"


def _price_text() -> Column:
    """Order prices as text in five conventions, the last of them no number."""
    cents = F.format_string("%.2f", F.col("o_totalprice"))
    grouped = F.format_number(F.col("o_totalprice"), 2)
    european = F.translate(grouped, ",.", ".,")
    kind = (F.col("o_orderkey") % 5).cast("int")
    return F.when(kind == 0, cents).when(kind == 1, grouped).when(kind == 2, european).when(kind == 3, F.replace(cents, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("12.."), cents))


_PRICE = """p as (select o_orderkey, printf('%.2f', o_totalprice) as cents, format('{:,.2f}', o_totalprice) as grouped from orders),
 x as (select o_orderkey, case (o_orderkey % 5)::int when 0 then cents when 1 then grouped when 2 then translate(grouped, ',.', '.,') when 3 then replace(cents, '.', ',') else '12..' || cents end as raw,
   case when o_orderkey % 5 = 4 then null else cents::decimal(38,2) end as amount from p)"""


def parse_locale_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("raw", _price_text())
    return o.select("o_orderkey", "raw", locale_amount(F.col("raw"), MONEY).alias("amount"))


def amount_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    cents = F.format_string("%.2f", "o_totalprice")
    plain = F.when(F.col("o_orderkey") % 5 == 4, F.concat(F.lit("12.."), cents)).otherwise(cents)
    _, bad = split_rejects(normalize(o.select(plain.alias("amount"), F.col("o_orderkey").alias("_key")), strict=False))
    return bad.select(F.col("_key").alias("o_orderkey"), F.col("_reject").alias("reason"))


def parse_multi_format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    kind = (F.col("o_orderkey") % 5).cast("int")
    text = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "yyyyMMdd")).when(kind == 2, F.date_format(d, "dd/MM/yyyy")).when(kind == 3, F.date_format(d, "yyyy/MM/dd")).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00+02:00")))
    return load(spark, sf_dir, "orders").select("o_orderkey", flexible_date(F.when(F.col("o_orderkey") % 7 == 0, F.lit("soon")).otherwise(text)).alias("day"))


def coalesce_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    every = lambda n, c: F.when(F.col("idx") % n == 0, F.lit("")).otherwise(c)
    records = tx.select(
        every(2, F.col("description")).alias("Reference"), F.col("priority").alias("Memo"), F.col("amount").cast("string").alias("Amount"), F.lower("currency").alias("Currency"),
        F.col("account_id").alias("AccountId"), F.col("booking_date").cast("string").alias("BookgDt"), every(3, F.col("value_date").cast("string")).alias("ValDt"), F.col("booking_date").cast("string").alias("date"),
        every(5, F.lit("Ada")).alias("Creditor"), F.lit("Bo").alias("Debtor"), F.col("idx").alias("_key"),
    )
    out = normalize(records)
    return out.select(F.col("_key").alias("idx"), "account_id", "currency", F.col("amount").cast(MONEY).alias("amount"), "booking_date", "value_date", "description", "reference", "counterparty", "source_method")


def pii_mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("account_nation"))
    return privacy.mask_by_name(c)


def pii_mask_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("DbtrNm"))
    return privacy.mask_filled(c, privacy.PAYMENT_COLUMNS).withColumnRenamed("DbtrNm", "debtor")


RULES = [("PROMO", "Expenses:Promotion"), ("econ|small", "Expenses:Economy"), ("^st", "Expenses:Standard"), ("brass$", "Expenses:Brass")]


def account_map_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", enrichment.map_accounts(F.col("p_type"), RULES, "Expenses:Other").alias("account"))


def account_map_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(k, p, a) for k, (p, a) in enumerate([("the", "A"), ("que", "B"), ("der", "C")])], "ord int, pattern string, account string")
    return enrichment.map_accounts_by(load(spark, sf_dir, "documents"), rules, "none", "doc_id", "text").select("doc_id", "account")


def category_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a model's answers for documents: some twice, some out of schema, some without confidence."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    lab = load(spark, sf_dir, "labels")
    name = F.element_at(F.array(F.lit(" travel "), F.lit("BANK FEES"), F.lit("Nonsense")), (F.col("doc_id") % 3 + 1).cast("int"))
    answer = lambda pos, c: lab.select(F.col("doc_id").alias("index"), F.lit(pos).alias("pos"), c.alias("category"), (F.col("toxic") == 1).alias("is_business_expense"), (F.col("quality") * 0.75 + F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("confidence"), F.lit("because").alias("rationale"))
    results = answer(0, name).unionByName(answer(1, F.lit("Transfer")).where(F.col("index") % 5 == 0))
    out = enrichment.attach_categories(docs, results)
    return out.select("idx", "lang", "category", "is_business_expense", F.col("enrichment_confidence").cast("decimal(10,4)").alias("enrichment_confidence"), "rationale")


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    chunked = enrichment.chunks(tx, ["file"], ["idx"])
    return chunked.select("idx", "chunk", "chunk_index", enrichment.prompt_row(F.col("chunk_index"), F.col("booking_date"), F.col("amount"), F.col("description")).alias("line"))


def page_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of its three thirds holds a document's own middle words."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n"))
    third = F.greatest((F.col("n") / 3).cast("int"), F.lit(1))
    pages = F.array(F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, F.col("n")))
    needle = F.upper(F.substring("text", (F.col("n") / 2).cast("int"), F.lit(8)))
    return d.select("doc_id", first_page_with(F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(needle), pages).alias("page"))


def context_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", slice_of(F.when(F.col("lang") == "en", "THE ").otherwise("de "), F.col("text")).alias("context"))


def prompt_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", sanitize_prompt(F.concat(F.lit("[system] ``` [Inst]\t"), F.col("text"))).alias("clean"), sanitize_source_name(F.concat("source", F.lit("\t‮"), F.col("doc_id").cast("string"))).alias("name"))


def low_density_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", page_source.route(F.col("text")).alias("route"), page_source.density_warning(F.col("text")).alias("warning"))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".CSV", ".ofx", ".qfx", ".sta", ".xml", ".xml", ".txt", ".html"))), (F.col("page_id") % 8 + 1).cast("int")))
    body = F.concat(F.when(F.col("page_id") % 16 == 4, "<CstmrCdtTrfInitn>").when(F.col("page_id") % 16 == 5, "<BkToCstmrStmt>").when(F.col("page_id") % 16 == 6, "<OFX>").otherwise(""), F.col("html"))
    return p.select("page_id", detect(name, body).alias("format"))


def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", ofx_tag(F.col("html"), "title").alias("title"), ofx_tag(F.col("html"), "h1").alias("h1"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<p>(.*?)</p>"), F.lit(1))).alias("n_paragraphs"))


def json_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


def confidence_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    c = (F.from_json("props", "k int")["k"] / 80.0)
    return e.select("event_id", F.when(c.between(0.0, 1.0), c.cast("decimal(10,4)")).alias("confidence"))


def _with_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    quoted = F.concat(F.lit('say "'), F.col("description"), F.lit('" \\ now\nnext'))
    return tx.withColumns({"category": F.when(F.col("idx") % 4 == 0, "Food and/Drink"), "counterparty": F.col("priority"), "description": F.when(F.col("idx") % 6 == 0, F.lit(None)).when(F.col("idx") % 6 == 1, quoted).otherwise(F.col("description")), "currency": F.when(F.col("idx") % 9 == 0, F.lit(None)).otherwise(F.col("currency")), "booking_date": F.when(F.col("idx") % 10 == 0, F.lit(None).cast("date")).otherwise(F.col("booking_date"))})


def hledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_category(spark, sf_dir).select("idx", ledger.hledger_entry().alias("entry"))


def beancount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_category(spark, sf_dir).select("idx", ledger.beancount_entry().alias("entry"))


def ingest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir).withColumns({"transaction_hash": F.md5(F.col("idx").cast("string").cast("binary")), "source_method": F.lit("deterministic"), "source_page": F.when(F.col("idx") % 2 == 0, (F.col("idx") % 7).cast("int")), "confidence": F.lit(None).cast("double")})
    return export.ingest_projection(tx)


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest result a file, as JSON in pages and read again: its version, count and warnings."""
    tx = transactions(spark, sf_dir)
    rows = export.paged(tx.select("file", "idx", F.col("amount").cast("string").alias("amount")), ["file", "idx", "amount"])
    per = rows.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "amount"))).alias("transactions"))
    text = per.select("file", export.result_json(F.lit("deterministic"), F.concat(F.lit("f"), F.col("file").cast("string")), F.col("transactions"), F.struct(F.lit("verified").alias("status")), F.array(F.lit("w")), F.array().cast("array<string>")).alias("json"))
    back = export.load_result(text, "transactions array<struct<idx:bigint,amount:string>>, verification struct<status:string>, warnings array<string>, audit_trail array<string>")
    pages = back.select("schema_version", "source_format", F.size("transactions").alias("n"), F.aggregate("transactions", F.lit(0).cast(MONEY), lambda a, t: (a + t["amount"].cast("decimal(18,2)")).cast(MONEY)).alias("total"), F.size("warnings").alias("n_warnings"), F.col("verification.status").alias("status"))
    keys = ["schema_version", "source_format", "n_warnings", "status"]  # of the file, the same on all of its pages
    return pages.groupBy(*keys).agg(F.sum("n").cast("int").alias("n"), F.sum("total").cast(MONEY).alias("total")).select("schema_version", "source_format", "n", "total", "n_warnings", "status")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderstatus").alias("status"))
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    return o.unionByName(e, allowMissingColumns=True)


def low_confidence_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 100) / 100.0).alias("confidence"))
    return review.needs_review(lab, 0.5).select("doc_id")


def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of edits and deletions of one row in seven."""
    from ..operators.normalize import with_identity

    none = F.lit(None).cast("string")
    tx = with_identity(transactions(spark, sf_dir).withColumns({"transaction_id": none, "source_index": F.col("idx"), "amount": F.col("amount").cast("decimal(38,10)")}))
    edits = tx.where("idx % 7 < 2").select("source_index", F.when(F.col("idx") % 7 == 0, "edit").otherwise("delete").alias("action"), F.lit("new words").alias("description"), F.lit("1.50").alias("amount"))
    after, trail = review.apply_edits(tx, edits)
    return trail.select("row_index", "action", "deleted_hash", F.col("after_hash"))


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The truth of an account's orders, and what an extractor that errs found of it."""
    tx = transactions(spark, sf_dir, coarse=True)
    w = Window.partitionBy("account_id").orderBy("idx")
    e = tx.select(F.col("account_id").alias("case_name"), (F.row_number().over(w) - 1).cast("int").alias("pos"), "amount", "booking_date", "description")
    a = e.where("pos % 5 <> 0").withColumns({"amount": F.when(F.col("pos") % 7 == 0, F.col("amount") + 100).otherwise(F.col("amount")), "booking_date": F.when(F.col("pos") % 3 == 0, F.date_add("booking_date", 1)).otherwise(F.col("booking_date"))})
    return e, a, tx.select(F.col("account_id").alias("case_name")).distinct()


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, cases = _extracted(spark, sf_dir)
    return evaluation.score(e, a, evaluation.match_rows(e, a), cases)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and worst of scores made from labels by language."""
    lab = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    p = evaluation.ratio(F.sum("quality"), F.count("*"))
    s = lab.groupBy(F.col("source").alias("case_name")).agg(p.alias("precision"), evaluation.ratio(F.sum("toxic"), F.count("*")).alias("recall"))
    out = evaluation.summarize(s.withColumn("f1", evaluation.f1(F.col("precision"), F.col("recall"))))
    return out.select("case_count", "worst_case", *(F.col(c).cast("decimal(12,6)").alias(c) for c in ("mean_f1", "mean_precision", "mean_recall", "worst_f1")))


_KEY = "case when instr(amount::varchar, '.') > 0 then rtrim(rtrim(amount::varchar, '0'), '.') else amount::varchar end"
_NEG = "case when instr((-amount)::varchar, '.') > 0 then rtrim(rtrim((-amount)::varchar, '0'), '.') else (-amount)::varchar end"
_LEDGER = TX_SQL + """, q as (select idx, amount, case when idx % 4 = 0 then 'Expenses:Food:and:Drink' else 'Expenses:Uncategorized' end as contra, priority as payee,
  case when idx % 6 = 0 then 'Unknown' when idx % 6 = 1 then 'say "' || description || '" \\ now next' else description end as d,
  case when idx % 9 = 0 then 'EUR' else currency end as c, case when idx % 10 = 0 then '1970-01-01' else booking_date::varchar end as day from tx)"""

SQL = {
    "parse_locale_amount": f"with {_PRICE} select o_orderkey, raw, amount from x",
    "amount_quarantine": f"with {_PRICE} select o_orderkey, 'amount is not a number: ' || raw as reason from x where amount is null",
    "parse_multi_format_date": "select o_orderkey, case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) end as day from orders",
    "coalesce_normalize": TX_SQL + """select idx, account_id, currency, amount::decimal(38,2) as amount, booking_date, case when idx % 3 = 0 then booking_date else value_date end as value_date,
        case when idx % 2 = 0 then priority else description end as description, case when idx % 2 = 0 then null else description end as reference, case when idx % 5 = 0 then 'Bo' else 'Ada' end as counterparty, 'deterministic' as source_method from tx""",
    "pii_mask_columns": "select c_custkey, '***REDACTED***' as c_name, c_mktsegment, '***REDACTED***' as account_nation from customer",
    "pii_mask_filled": "select c_custkey, case c_custkey % 3 when 0 then '' when 1 then '***REDACTED***' end as debtor from customer",
    "account_map_static": "select p_partkey, case when regexp_matches(p_type, '(?i)PROMO') then 'Expenses:Promotion' when regexp_matches(p_type, '(?i)econ|small') then 'Expenses:Economy' when regexp_matches(p_type, '(?i)^st') then 'Expenses:Standard' when regexp_matches(p_type, '(?i)brass$') then 'Expenses:Brass' else 'Expenses:Other' end as account from part",
    "account_map_rules": "select doc_id, case when regexp_matches(text, '(?i)the') then 'A' when regexp_matches(text, '(?i)que') then 'B' when regexp_matches(text, '(?i)der') then 'C' else 'none' end as account from documents",
    "category_attach": """select d.doc_id as idx, lang, case when l.doc_id is null then null when l.doc_id % 5 = 0 then 'Transfer' when l.doc_id % 3 = 0 then 'Travel' when l.doc_id % 3 = 1 then 'Bank Fees' end as category,
        case when l.doc_id is not null then toxic = 1 end as is_business_expense, case when quality * 0.75 + case when toxic = 1 then 1 else 0 end <= 1 then (quality * 0.75 + case when toxic = 1 then 1 else 0 end)::decimal(10,4) end as enrichment_confidence,
        case when l.doc_id is null then 'LLM did not return a result for this row' else 'because' end as rationale from documents d left join labels l using (doc_id)""",
    "prompt_rows": TX_SQL + f""", n as (select *, row_number() over (partition by file order by idx) - 1 as n, {_KEY} as k from tx) select idx, (n // 25)::int as chunk, (n % 25)::int as chunk_index,
        (n % 25) || '. ' || booking_date || ' ' || case when length(k) < 10 then lpad(k, 10, ' ') else k end || ' ' || description[:80] as line from n""",
    "page_trace": """with t as (select doc_id, text, length(text) as n, greatest(length(text) // 3, 1)::int as h from documents), p as (select doc_id, lower(case when doc_id % 10 = 0 then '' else substr(text, (n // 2)::int, 8) end) as w,
        lower(substr(text, 1, h)) as a, lower(substr(text, h + 1, h)) as b, lower(substr(text, 2 * h + 1, n)) as c from t)
        select doc_id, case when w = '' then null when contains(a, w) then 0 when contains(b, w) then 1 when contains(c, w) then 2 end::int as page from p""",
    "context_slice": """with n as (select doc_id, text, case when lang = 'en' then 'the ' else 'de ' end as w from documents), a as (select *, instr(lower(text), w) as i from n)
        select doc_id, case when i > 0 then trim(substr(text, greatest(i - 80, 1), i + length(w) + 80 - greatest(i - 80, 1))) end as context from a""",
    "prompt_sanitize": "select doc_id, replace(regexp_replace(regexp_replace('[system] ``` [Inst]' || text, '[\\x00-\\x09\\x0b-\\x1f]', '', 'g'), '\\[(SYSTEM|INST)', '(\\1', 'gi'), '```', '') as clean, source || '??' || doc_id as name from documents",
    "low_density_route": "select doc_id, case when length(trim(text)) < 50 then 'vision' else 'llm' end as route, case when length(trim(text)) < 50 then 'LOW_TEXT_DENSITY: extracted ' || length(trim(text)) || ' chars (threshold 50). Routing to vision model.' end as warning from documents",
    "detect_format": """select page_id, case (page_id % 8)::int when 0 then 'csv' when 1 then 'ofx' when 2 then 'qfx' when 3 then 'mt940'
        else case when page_id % 16 = 4 or (page_id % 8 in (4, 5) and (contains(lower(html), 'cstmrcdttrfinitn') or contains(lower(html), 'pain.001'))) then 'pain001' when page_id % 16 = 5 or (page_id % 8 in (4, 5) and (contains(lower(html), 'bktocstmrstmt') or contains(lower(html), 'camt.'))) then 'camt'
        when page_id % 16 = 6 or contains(lower(html), '<ofx>') or contains(lower(html), '<banktranlist>') then 'ofx' when contains(html, ':20:') and contains(html, ':61:') then 'mt940' end end as format from pages""",
    "tag_extract": "select page_id, nullif(trim(regexp_extract(html, '(?i)<title>([^<\\r\\n]+)', 1)), '') as title, nullif(trim(regexp_extract(html, '(?i)<h1>([^<\\r\\n]+)', 1)), '') as h1, len(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1))::int as n_paragraphs from pages",
    "json_payload_extract": "select event_id, (props->>'$.k')::int as k, props->>'$.k' as k_text from events",
    "confidence_valid": "select event_id, case when (props->>'$.k')::int / 80.0 between 0 and 1 then ((props->>'$.k')::int / 80.0)::decimal(10,4) end as confidence from events",
    "hledger_lines": _LEDGER + f" select idx, day || ' ' || d || chr(10) || '    Assets:Bank:Checking    ' || c || ' ' || {_KEY} || chr(10) || '    ' || contra || chr(10) as entry from q",
    "beancount_lines": _LEDGER + f""" select idx, day || ' txn "' || payee || '" "' || replace(replace(d, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || '  Assets:Bank:Checking  ' || {_KEY} || ' ' || c || chr(10) || '  ' || contra || '  ' || {_NEG} || ' ' || c || chr(10) as entry from q""",
    "ingest_projection": TX_SQL + "select md5(idx::varchar) as transaction_hash, 'deterministic' as source_method, case when idx % 2 = 0 then (idx % 7)::varchar else '' end as source_page, booking_date::varchar as booking_date, description, amount::varchar as amount, currency, reference, '' as confidence from tx",
    "result_json": TX_SQL + "select 1 as schema_version, 'f' || file as source_format, count(*)::int as n, sum(amount)::decimal(38,2) as total, 1 as n_warnings, 'verified' as status from tx group by file",
    "union_by_name": "select o_orderkey as id, o_totalprice::decimal(38,2) as amount, o_orderstatus as status, null::varchar as kind from orders union all select event_id, null, null, event_type from events",
    "low_confidence_review": "select doc_id from labels where doc_id % 4 <> 0 and doc_id % 100 < 50",
    "review_edits": TX_SQL + f""", a as (select idx, amount::decimal(38,10) as amount, booking_date, reference, trim(regexp_replace(regexp_replace(lower(description), '[0-9-]+', ' ', 'g'), '[^a-z]+', ' ', 'g')) as nd from tx where idx % 7 < 2)
        select idx as row_index, case when idx % 7 = 0 then 'edit' else 'delete' end as action, case when idx % 7 = 1 then md5(booking_date::varchar || '|' || nd || '|' || {_KEY} || '|' || reference) end as deleted_hash,
        case when idx % 7 = 0 then md5(booking_date::varchar || '|new words|1.5|' || reference) end as after_hash from a""",
    "eval_summary": """with s as (select source, sum(quality) / count(*)::double as p, sum(toxic) / count(*)::double as r from labels join documents using (doc_id) group by 1), f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1 from s)
        select count(*) as case_count, arg_min(source, (f1, source)) as worst_case, avg(f1)::decimal(12,6) as mean_f1, avg(p)::decimal(12,6) as mean_precision, avg(r)::decimal(12,6) as mean_recall, min(f1)::decimal(12,6) as worst_f1 from f""",
}

QUERIES = {
    f.__name__: f
    for f in (
        parse_locale_amount, amount_quarantine, parse_multi_format_date, coalesce_normalize, pii_mask_columns, pii_mask_filled, account_map_static, account_map_rules, category_attach, prompt_rows,
        page_trace, context_slice, prompt_sanitize, low_density_route, detect_format, tag_extract, json_payload_extract, confidence_valid, hledger_lines, beancount_lines, ingest_projection, result_json,
        union_by_name, low_confidence_review, review_edits, eval_scores, eval_summary,
    )
}
