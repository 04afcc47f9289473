"""The stages of a collection one after the other: score, clean, group, chunk, embed.

Each stage reads the table of the one before and writes its own under the root folder, so a run can begin at any stage. Without
a threshold the run ends after score, whose distribution is the ground for choosing one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, clean, group, quality, search
from ..sources.tables import VectorTable, path_exists, read_pages, write_stage

STAGES = ["score", "clean", "group", "chunk", "embed"]
NAMESPACE = "chunks"
Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], size: int = 256) -> np.ndarray:
    """Offline stand-in for an embedding model: signed counts of hashed words, of length one."""
    import zlib

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.strip(".,;:!?()[]\"'").encode())
            out[i, h % size] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def with_embedding(df: DataFrame, embed: Embedder = hashed_words, column: str = "text", batch: int = 90) -> DataFrame:
    """df plus embedding array<double>, in batches of the size that a service takes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embed([t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()])
                yield part.append_column("embedding", pa.array(list(map(list, vectors)), pa.list_(pa.float64())))

    return df.mapInArrow(run, df.withColumn("embedding", F.array().cast("array<double>")).schema)


@dataclass
class Run:
    done: list[str]
    report: DataFrame | None = None
    paused: bool = False


def steps_from(start: str | None) -> list[str]:
    if start is not None and start not in STAGES:
        raise ValueError(f"unknown stage {start}: one of {', '.join(STAGES)}")
    return STAGES[STAGES.index(start) if start else 0 :]


def run_stages(spark: SparkSession, root: str, start: str | None = None, threshold: float | None = None, dry_run: bool = False, embed: Embedder = hashed_words, say: Callable[[str], None] = print) -> Run:
    """root/pages holds the recognised pages as JSON lines, a directory for each source; tables go to root/<stage>."""
    run, steps = Run([]), steps_from(start)
    for i, name in enumerate(steps, 1):
        say(f"[{i}/{len(steps)}] {name}")
        if not dry_run:
            _run_one(spark, root.rstrip("/"), name, threshold, embed, run)
        run.done.append(name)
        if name == "score" and threshold is None:
            run.paused = True
            say("no threshold: choose one from the distribution and begin again at score")
            break
    return run


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    if not path_exists(spark, f"{root}/{name}"):
        raise FileNotFoundError(f"{root}/{name}: run the stage {name} first")
    return spark.read.parquet(f"{root}/{name}")


def _run_one(spark: SparkSession, root: str, name: str, threshold: float | None, embed: Embedder, run: Run) -> None:
    if name == "score":
        pages = quality.with_text_measures(read_pages(spark, f"{root}/pages").select("source_stem", "page_no", "raw_text", "ocr_confidence"))
        run.report = quality.histogram(pages)
        if threshold is not None:
            write_stage(quality.assign_buckets(pages, threshold), f"{root}/score")
    elif name == "clean":
        pages = _read(spark, root, "score")
        done = clean.clean_pages(pages.where("bucket = 'clean'"))
        write_stage(done.unionByName(pages.where("bucket <> 'clean'"), allowMissingColumns=True), f"{root}/clean")
    elif name == "group":
        write_stage(group.group_pages(_read(spark, root, "clean")), f"{root}/group")
    elif name == "chunk":
        pages = _read(spark, root, "group")
        write_stage(chunk.build_chunks(pages, group.doc_summaries(pages)), f"{root}/chunk")
    else:
        records = search.to_records(_read(spark, root, "chunk"))
        table = VectorTable(spark, f"{root}/embed")
        table.upsert(with_embedding(records, embed), NAMESPACE)
        run.report = spark.createDataFrame([(table.verify(NAMESPACE, records.count()),)], "records long")
