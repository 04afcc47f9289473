"""Incremental forms of the batch operators (an addition: the batch semantics stay as they are).

stream_pages reads new page files; upsert_stream keeps a vector table up to date; group_stream runs the page
grouping as keyed state; windowed_counts is an event-time extension over an events table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed
from ..operators.clean import clean_pages, template_of
from ..operators.group import with_signals
from ..sources.tables import PAGE, VectorTable


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_trigger).json(path).withColumn("source_stem", stem)


def clean_stream(pages: DataFrame) -> DataFrame:
    """Cleaning is a row-wise plan, so it runs on a stream as it is."""
    return clean_pages(pages)


def upsert_stream(records: DataFrame, table: VectorTable, namespace: str, checkpoint: str):
    """Micro-batches are upserted by id; a batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, namespace)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DECIDED = "source_stem string, page_no int, doc_id string, doc_kind string, doc_page_index int"
_STATE = "n int, kind string, cases string, prev_mid boolean, at int"


def _continues(p: dict, kind: str | None, cases: set[str], prev_mid: bool) -> bool:
    template, here = p["template"], set(p["cases"])
    if template == "4-750":
        return False
    if p["cover"]:
        return kind == "cover"
    if kind is None:
        return False
    if template == "FD-36-cont":
        return kind in ("teletype", "teletype-cont", "loose")
    if p["page_n"]:
        return kind in fixed.CONTINUATION_COMPATIBLE and not (here and cases and not here & cases)
    if p["cont"]:
        return kind in ("newspaper", "loose")
    if p["header"]:
        return False
    return template in (None, "unknown") and prev_mid and p["starts_mid"] and bool(here & cases)


def decide(pages: Iterator[dict], state: tuple) -> tuple[list[tuple], tuple]:
    """Rows (page_no, n, kind, index) of pages in order, and the state after them. The stream's form of the batch fold."""
    n, kind, cases, prev_mid, at = state
    cases = set(cases)
    out = []
    for p in pages:
        if _continues(p, kind, cases, prev_mid):
            cases |= set(p["cases"])
            at += 1
        else:
            n, at, cases = n + 1, 1, set(p["cases"])
            kind = "cover" if p["cover"] and p["template"] != "4-750" else fixed.DOC_KINDS.get(p["template"], "loose")
        prev_mid = bool(p["ends_mid"])
        out.append((p["page_no"], n, kind, at))
    return out, (n, kind, cases, prev_mid, at)


def group_stream(pages: DataFrame) -> DataFrame:
    """Pages of a source are decided as they come (in page order within a batch, later pages in later batches)."""
    p = pages.withColumn("template", F.coalesce("template", template_of(F.coalesce("raw_text", F.lit("")))))
    live = with_signals(p).where(~F.col("empty")).select("source_stem", "page_no", "template", "cover", "page_n", "cont", "header", "starts_mid", "ends_mid", "cases")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, None, "", False, 0)
        rows = pd.concat(list(frames)).sort_values("page_no").to_dict("records")
        for r in rows:
            r["cases"] = list(r["cases"])
        out, (n, kind, cases, mid, at) = decide(iter(rows), (now[0], now[1], [x for x in (now[2] or "").split(",") if x], now[3], now[4]))
        state.update((n, kind, ",".join(sorted(cases)), mid, at))
        yield pd.DataFrame([(key[0], page, f"{key[0]}__doc-{i:03d}", k, place) for page, i, k, place in out], columns=[c.split()[0] for c in DECIDED.split(", ")])

    return live.groupBy("source_stem").applyInPandasWithState(step, DECIDED, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: event counts and sums for each window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
