"""Scanned documents: PDF files as binary rows, with pluggable rendering and recognition.

The PDF and OCR libraries are optional and not part of this package: pass functions that use them. Pages are rendered and
recognised one at a time in the task of their file, so no task holds more than one image."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import with_text_measures, words_to_pages

WORDS = "source_stem string, page_no int, seq int, block int, par int, line int, word string, conf double"
#: Bytes of a PDF to page images; an image to (block, par, line, word, conf) rows.
Render = Callable[[bytes], Iterable[object]]
Recognise = Callable[[object], Iterable[tuple[int, int, int, str, float]]]


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)\.[Pp][Dd][Ff]$", 1).alias("source_stem"), F.col("path").alias("source_file"), "content")


def text_layer(files: DataFrame, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """source_stem, page_no, raw_text of the embedded text layer, for operators.quality.layer_verdict."""

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            for i, text in enumerate(extract(bytes(r["content"])), 1):
                yield r["source_stem"], i, text or ""

    return _map_rows(files.select("source_stem", "content"), run, "source_stem string, page_no int, raw_text string")


def ocr_words(files: DataFrame, render: Render, recognise: Recognise) -> DataFrame:
    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            for page, image in enumerate(render(bytes(r["content"])), 1):
                for seq, (block, par, line, word, conf) in enumerate(recognise(image)):
                    yield r["source_stem"], page, seq, block, par, line, word, float(conf)

    return _map_rows(files.select("source_stem", "content"), run, WORDS)


def ocr_pages(files: DataFrame, render: Render, recognise: Recognise) -> DataFrame:
    """Page rows: words joined to lines, mean confidence, text measures."""
    pages = with_text_measures(words_to_pages(ocr_words(files, render, recognise)))
    return pages.join(files.select("source_stem", "source_file"), "source_stem")


def _map_rows(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def frames(batches):
        for b in batches:
            for record in b.to_dict("records"):  # a file at a time: its rows leave before the next is opened
                rows = list(run(iter([record])))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(frames, schema)
