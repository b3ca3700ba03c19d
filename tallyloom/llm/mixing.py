"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over its
present share.  Each document draws its number of copies by inverting the
Poisson distribution of that mean at a uniform number hashed from a seed and
its id, so the draw is the same wherever and whenever it is made.  Copies are
then spread by a hash of seed, id and copy and sorted by it within partitions: a
global shuffle with one exchange.

Defined results: null is a source of its own; a source whose texts have no
character keeps its documents as they are (rate 1), and so does one whose
weight is not given, if weights are given only for others: it is dropped, its
weight is 0.  Rows that repeat an id draw alike, and a null id draws as the
empty string.  A text's length matters for its source's share alone, however
long it is.  An empty table gives no row.  Extra columns are passed on, whatever
their names; ``copy`` replaces one of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Numbers in all sources' distributions up to which these are broadcast (8 bytes each); more are joined by a shuffle, in which a source is spread over ``_SALT`` keys.
BROADCAST_NUMBERS = 2_000_000
_SALT = 32


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where it is 1 in doubles."""
    if not rate > 0:
        return [1.0]
    k = np.arange(int(rate + 12 * math.sqrt(rate) + 40))
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(k))))])
    return np.minimum(np.cumsum(np.exp(-rate + k * math.log(rate) - log_factorial)), 1.0).tolist()


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.7) -> DataFrame:
    """(source, n_chars, rate) over all documents.

    ``weights`` are target shares of characters (they needn't add up to 1);
    without them a source's target is its present share to the power
    ``temperature``, which lifts small sources.
    """
    stats = docs.groupBy(docs[source_col].cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("bigint")).alias("n_chars"))
    total = stats.agg(F.sum("n_chars").alias("all_chars"))
    if weights is None:
        weight = F.pow(F.col("n_chars") / F.col("all_chars"), F.lit(float(temperature)))
        weighed = stats.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("n_chars") > 0, weight).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__s string, __w double")
        weighed = stats.crossJoin(F.broadcast(total)).join(given, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("weight", F.coalesce("__w", F.lit(0.0))).drop("__s", "__w")
    sums = weighed.agg(F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("n_chars") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("n_chars")).otherwise(1.0)
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n_chars", rate.alias("rate"))


def replicate(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.7) -> DataFrame:
    """The documents' copies in a global shuffle, with their number in ``copy`` (from 0)."""

    def distributions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"s": frame["source"], "cdf": [poisson_cdf(r) for r in frame["rate"]]})

    given = docs.drop("copy")
    own, cdf, salt, u, n, order = (fresh(given, x) for x in ("s", "cdf", "salt", "u", "n", "order"))
    # one row a source; written, so that the count below and the join don't scan the texts twice
    table = cut(rates(docs, source_col, text_col, weights, temperature).mapInPandas(distributions, "s string, cdf array<double>"))
    numbers = table.agg(F.coalesce(F.sum(F.size("cdf") + 4), F.lit(0))).first()[0]
    table = table.withColumnsRenamed({"s": own, "cdf": cdf})
    alike = given[source_col].cast("string").eqNullSafe(F.col(own))
    if numbers <= BROADCAST_NUMBERS:
        joined = given.join(F.broadcast(table), alike)
    else:
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
        joined = given.join(spread, alike & (F.pmod(F.xxhash64(given[id_col]), F.lit(_SALT)).cast("int") == F.col(salt))).drop(salt)
    drawn = joined.withColumn(u, uniform(seed, F.col(id_col))).withColumn(n, F.size(F.filter(cdf, lambda c: c <= F.col(u))))
    copies = drawn.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(own, cdf, u, n)
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy"), F.col(text_col))
    return copies.withColumn(order, place).repartition(order).sortWithinPartitions(order).drop(order)


#: The same copies in SQL (without their order).
ORACLE = """
with s as (select source, sum(coalesce(length(text), 0)) as n from {docs} group by source),
w as (select source, n, (select sum(n) from s) as t, case when n > 0 then power(n / (select sum(n) from s)::double, 0.7) else 0 end as w from s),
r as (select source, case when n > 0 then w / (select sum(w) from w) * t / n else 1 end as rate from w),
c as (select source, k, sum(p) over (partition by source order by k) as cdf
      from (select source, k, exp(-rate + k * ln(rate) - case when k > 0 then lgamma(k + 1) else 0 end) as p from r, range(0, 200) as g(k))),
u as (select *, ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u from {docs}),
n as (select u.* exclude (u), (select count(*) from c where c.source is not distinct from u.source and c.cdf <= u.u) as n from u)
select n.* exclude (n), g.k::int as copy from n, lateral (select unnest(range(0, n.n)) as k) as g
"""
