"""Quality by compression: dictionaries built from good and from bad labelled texts compress a text; sizes become a score.

The normalised difference (bytes under the bad dictionary less bytes under the good one, by the text's bytes) is joined by the
better of both ratios, since text that repeats itself shrinks under either dictionary, and by length; a logistic calibration
learned on labelled rows that built no dictionary turns them into a score.

Learning reads about ``LEARN_ROWS`` labelled rows, and the dictionaries take whole texts of them up to ``DICTIONARY_TEXT``
bytes a class; both bound the model only. Every whole text is scored, each by itself inside its task.

Defined results: null and empty texts have a difference of nought and a ratio of one; with no labels every score is one half;
repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .learning import fit_logistic, learning_rows, predict_logistic

LEARN_ROWS = 12_000
DICTIONARY_TEXT = 4_000_000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Compressed bytes that a frame costs without any text.
FRAME = 12


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the texts' own end where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-size:]


class Sizes:
    """Compression features of texts under a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False) for d in (good, bad)]

    def features(self, text: str | None) -> list[float]:
        body = (text or "").encode("utf-8", "surrogatepass")
        if not body:
            return [0.0, 0.0, 1.0, 1.0, 0.0]
        good, bad = (max(len(c.compress(body)) - FRAME, 1) for c in self.by)
        difference, ratio = (bad - good) / len(body), min(good, bad) / len(body)
        return [difference, difference * abs(difference), ratio, ratio * ratio, float(np.log1p(len(body)))]


FEATURES = ("difference", "signed_square", "ratio", "ratio_square", "length")


def _features_of(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            rows = np.array([sizes.features(t.as_py()) for t in batch.column(0)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in rows.T)], ["label", *FEATURES])

    return run


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, bound: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: two dictionaries (from half of the sample) and the calibration (from the other half)."""
    rows = learning_rows(docs, labels, "quality", learnable, bound, id_col, text_col)
    half = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(2))
    order = F.xxhash64("id", F.lit(17))
    made = []
    for label in (1, 0):
        texts, size = [], 0
        drawn = rows.where((half == 0) & (F.col("label") == label) & (F.col("text") != "")).select("text", F.octet_length("text").alias("b"), order.alias("o"), "id")
        # Whole texts in hash order while they fit: their running size bounds what the driver gets.
        least = drawn.groupBy(F.shiftright("o", 54).alias("p")).agg(F.sum("b").alias("b")).orderBy("p").collect()
        stop = None
        for r in least:
            size += r["b"]
            if size > DICTIONARY_TEXT:
                stop = r["p"]
                break
        drawn = drawn if stop is None else drawn.where(F.shiftright("o", 54) <= stop)
        for r in drawn.orderBy("o", "id").select("text").collect():
            texts.append(r["text"].encode("utf-8", "surrogatepass"))
        made.append(build_dictionary(texts) if texts else b"")
    shape = "label int, " + ", ".join(f"{c} double" for c in FEATURES)
    seen = rows.where(half == 1).select("text", "label").mapInArrow(_features_of(*made), shape).toPandas()
    return {"good": made[0], "bad": made[1], "calibration": fit_logistic(seen[list(FEATURES)].to_numpy(), seen["label"].to_numpy())}


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(shared.value["good"], shared.value["bad"])
        for batch in batches:
            rows = np.array([sizes.features(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict_logistic(shared.value["calibration"], rows))], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(out.dtypes)["id"]
    return out.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
