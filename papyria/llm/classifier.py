"""Compression classifier of text quality.

Two zstandard dictionaries are built from good and bad labelled text. A text is cut into pieces of `piece` bytes (all
of it), each is compressed with either dictionary, and the difference of the summed sizes, divided by the text's
bytes, is turned into a probability by a logistic curve that is fitted on labelled texts which built no dictionary.

Learning takes a bounded sample: the first `sample` labelled documents of each class in the order of a hash of the
id, and `sample_chars` characters from the middle of each. Nothing but the text enters the score. Scoring is one scan;
model and dictionaries (some 200 KB, whatever the input) are broadcast.

Defined results: a null or empty text has difference 0, and so the score that the curve gives at 0; with one class only, or
none, every score is that class's share (0.5 without labels); labels that are null, or that contradict each other for one
document, are not learned from; repeated documents are separate rows; a very long text is scored whole, piece by piece; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    piece: int
    level: int


_ready: dict[tuple, tuple] = {}


def _compressors(model: Model):
    key = (model.good, model.bad, model.level)
    if key not in _ready:
        _ready.clear()
        _ready[key] = tuple(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))
    return _ready[key]


def difference(model: Model, text: str | None) -> float:
    """(size with the bad dictionary - size with the good one) / bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data or not model.good:
        return 0.0
    good, bad = _compressors(model)
    total = 0
    for i in range(0, len(data), model.piece):
        part = data[i : i + model.piece]
        total += len(bad.compress(part)) - len(good.compress(part))
    return total / len(data)


def score(model: Model, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.slope * difference(model, text) + model.offset, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _dictionary(texts: list[bytes], size: int, piece: int) -> bytes:
    parts = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"".join(parts)[-size:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight ridge; x is scaled first."""
    scale = float(np.std(x)) or 1.0
    a, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1e-2, 1e-6])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, sample_chars: int = 6000, piece: int = 1024, dictionary: int = 110_000, level: int = 3) -> Model:
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("lo") == q).orderBy(*order).limit(sample).select("doc_id", F.col("lo").alias("q")) for q in (0, 1)]
    shares = {r[0]: r[1] for r in known.groupBy("lo").count().collect()}
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample ids at most
    middle = F.greatest(F.lit(1), ((F.length("text") - sample_chars) / 2).cast("int"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "q", F.substring(F.coalesce("text", F.lit("")), middle, F.lit(sample_chars)).alias("text")).orderBy("q", *order, "text").limit(4 * sample).collect()
    total = sum(shares.values())
    good, bad = ([r["text"].encode("utf-8", "surrogatepass") for r in rows if r["q"] == q] for q in (1, 0))
    if len(good) < 4 or len(bad) < 4:
        p = min(max((shares.get(1, 0) + 0.5) / (total + 1), 1e-6), 1 - 1e-6)
        return Model(b"", b"", 0.0, float(np.log(p / (1 - p))), piece, level)
    model = Model(*(_dictionary(t[::2], dictionary, piece) for t in (good, bad)), 0.0, 0.0, piece, level)
    rest = [(r, y) for t, y in ((good, 1.0), (bad, 0.0)) for r in t[1::2]]
    x = np.array([difference(model, t.decode("utf-8", "surrogatepass")) for t, _ in rest])
    model.slope, model.offset = _logistic(x, np.array([y for _, y in rest]))
    # the sample has as many of either class as there are; the curve's offset goes back to their real shares
    prior = np.log(shares[1] / shares[0]) - np.log(len(good) / len(bad))
    model.offset += float(prior)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(sent.value, t) for t in batch.column(1).to_pylist()], pa.float64())], schema=kinds)

    scored = map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of least or more; all columns pass through in the scan that scores."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([score(sent.value, t) >= least for t in texts]))

    return map_arrow(docs, run, docs.schema)
