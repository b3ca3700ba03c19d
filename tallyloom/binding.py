"""The driver's tables as transactions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same rows in SQL; every query's SQL begins with it.
TX_SQL = """
with tx as (
  select o_orderkey as idx, 'ACCT-' || (o_custkey % 40)::varchar as account_id,
    case (o_custkey % 4)::int when 0 then 'EUR' when 1 then 'GBP' when 2 then 'SEK' else 'USD' end as currency,
    cast(case when o_orderkey % 3 = 0 then -o_totalprice else o_totalprice end as decimal(18,2)) as amount,
    cast(o_orderdate as date) as booking_date, cast(o_orderdate as date) + (o_orderkey % 4)::int as value_date,
    'ORDER ' || o_orderpriority || ' ' || cast(cast(o_orderdate as date) as varchar) as description,
    'REF-' || (o_orderkey % 1000)::varchar as reference, o_orderkey % 5 as file, o_orderpriority as priority, o_orderstatus as status
  from orders
)
"""

#: Coarse amounts make duplicates.
COARSE_SQL = TX_SQL.replace("cast(case when o_orderkey % 3 = 0 then -o_totalprice else o_totalprice end as decimal(18,2))", "cast(case when o_orderkey % 3 = 0 then -1 else 1 end * (o_orderkey % 23) as decimal(18,2))")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    sign = F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    amount = sign * (F.col("o_orderkey") % 23) if coarse else sign * F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("idx"), F.concat(F.lit("ACCT-"), (F.col("o_custkey") % 40).cast("string")).alias("account_id"),
        F.element_at(F.array(*(F.lit(c) for c in ("EUR", "GBP", "SEK", "USD"))), (F.col("o_custkey") % 4 + 1).cast("int")).alias("currency"),
        amount.cast("decimal(18,2)").alias("amount"), day.alias("booking_date"), F.date_add(day, (F.col("o_orderkey") % 4).cast("int")).alias("value_date"),
        F.concat(F.lit("ORDER "), F.col("o_orderpriority"), F.lit(" "), day.cast("string")).alias("description"),
        F.concat(F.lit("REF-"), (F.col("o_orderkey") % 1000).cast("string")).alias("reference"), (F.col("o_orderkey") % 5).alias("file"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )
