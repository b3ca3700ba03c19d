"""PDF pages, by extractors that the caller brings: none is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_TEXT, MAX_PAGES, STRIPS, OVERLAP = 50, 5, 4, 0.1


def clean_page(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def extract_pages(spark: SparkSession, paths, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(_file, pages, error): each file's page texts; an extractor's error stays with its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    pages, error = [str(p or "") for p in extract(content.as_py())], None
                except Exception as e:  # one bad file fails alone
                    pages, error = None, str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([pages], type=pa.list_(pa.string())), pa.array([error], type=pa.string())], names=["_file", "pages", "error"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "_file string, pages array<string>, error string").withColumn("pages", F.transform("pages", clean_page))


def low_density(text: Column, least: int = MIN_TEXT) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def route(text: Column, least: int = MIN_TEXT) -> Column:
    """llm where a document's text is dense enough, else vision."""
    return F.when(low_density(text, least), "vision").otherwise("llm")


def density_warning(text: Column, least: int = MIN_TEXT) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < least, F.concat(F.lit("LOW_TEXT_DENSITY: extracted "), n.cast("string"), F.lit(f" chars (threshold {least}). Routing to vision model.")))


def render_pages(spark: SparkSession, paths, render: Callable[[bytes, int], list[bytes]], max_pages: int = MAX_PAGES) -> DataFrame:
    """(_file, page, image): PNGs of the first pages, from ``render(content, max_pages)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                images = render(content.as_py(), max_pages)[:max_pages]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(images), type=pa.string()), pa.array(range(len(images)), type=pa.int32()), pa.array(images, type=pa.binary())], names=["_file", "page", "image"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "_file string, page int, image binary")


def strip_bounds(strips: int = STRIPS, overlap: float = OVERLAP) -> list[tuple[float, float]]:
    """Tops and bottoms of a page's bands, as shares of its height; each reaches into its neighbours."""
    height = 1 / strips
    return [(max(0.0, k * height - overlap * height), min(1.0, (k + 1) * height + overlap * height)) for k in range(strips)]


def render_strips(pages: DataFrame, crop: Callable[[bytes, float, float], bytes], strips: int = STRIPS, overlap: float = OVERLAP) -> DataFrame:
    """(_file, page, strip, image): bands of page images, from ``crop(image, top, bottom)``."""
    bounds = strip_bounds(strips, overlap)
    cut = F.udf(lambda image, k: crop(bytes(image), *bounds[k]), "binary")
    return pages.select("_file", "page", "image", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip")).select("_file", "page", "strip", cut("image", "strip").alias("image"))


def data_url(image: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(image))


def from_data_url(url: Column) -> Column:
    return F.unbase64(F.regexp_replace(url, r"^data:[^,]*,", ""))
