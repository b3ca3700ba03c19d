"""What the XML readers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, paths, row_tag: str, schema: str, strict: bool = True) -> DataFrame:
    """One row for each element ``row_tag`` of the files, with _file; all leaves are text.

    ``strict`` fails on a malformed file; otherwise its rows hold only the text in ``_corrupt``.
    """
    full = schema + ("" if strict else ", _corrupt string")
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(full)
    if not strict:
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
    return reader.load(paths).withColumn("_file", F.col("_metadata.file_path"))


def parse_documents(texts: DataFrame, xml: Column, schema: str, keep: list[str], strict: bool = True) -> DataFrame:
    """The same from XML text that is already in a column; ``keep`` names columns to go along.

    Document types and entities are refused, as no statement needs them.
    """
    unsafe = xml.rlike(r"<!(DOCTYPE|ENTITY)")
    body = F.when(unsafe, F.raise_error(F.lit("document types and entities are refused")).cast("string")).otherwise(xml)
    parsed = F.from_xml(body, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE", "ignoreNamespace": "true"})
    return texts.select(*keep, parsed.alias("_doc")).select(*keep, "_doc.*")


def parsed_once(rows: DataFrame, xml: Column | str, schema: str, name: str) -> DataFrame:
    """``rows`` with their XML parsed as ``name``, behind a generator, so that filters on it don't parse it again."""
    return rows.select("*", F.explode(F.array(F.from_xml(xml, schema, {"mode": "FAILFAST", "ignoreNamespace": "true"}))).alias(name))


def runs_parsed(rows: DataFrame, xml: Column | str, unit: str, schema: str, name: str, at: str) -> DataFrame:
    """``rows`` with each of the ``unit`` elements of a run as ``name``, and ``at`` moved on to its number; no run is long, as the reader copies an array for each element.  An outer generator, as others parse twice."""
    run = F.from_xml(xml, f"{unit} array<{schema}>", {"mode": "FAILFAST", "ignoreNamespace": "true"})[unit]
    return rows.select("*", F.posexplode_outer(run).alias("__pos", name)).withColumn(at, F.col(at) + F.coalesce("__pos", F.lit(0))).drop("__pos")


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def present(column: Column) -> Column:
    return column.isNotNull() & (column != "")
