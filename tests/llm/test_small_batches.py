"""Texts go to Python in small batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quietstar.llm import common as C
from quietstar.llm import toxicity
from quietstar.llm.learning import fit_logistic

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_small(spark):
    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("some words "), 400).alias("text"))
    was = spark.conf.get(BYTES)
    with C.small_batches(spark, size=C.TEXT_BYTES):
        sizes = [r.size for r in docs.mapInArrow(measured, "size long").collect()]
    assert spark.conf.get(BYTES) == was and sum(sizes) > 12_000_000 and max(sizes) < 1_300_000


def test_drop_toxic_sends_texts_alone_in_small_batches(spark, monkeypatch):
    x = np.array([[0.0] * 5, [4.0, 0, 0, 0, np.log(2)]])
    model = {"lexicon": {"=moron": 4.0}, "calibration": fit_logistic(np.repeat(x, 20, 0), np.repeat([0, 1], 20))}
    seen, real = [], toxicity.read_back
    monkeypatch.setattr(toxicity, "read_back", lambda s, df, name: seen.append((name, df.columns, int(s.conf.get(BYTES)))) or real(s, df, name))
    rows = [(1, "moron", 7), (1, "fine words", 7), (2, None, 8), (None, "moron", 9), (None, "other", 9), (3, "", 1), (1, "fine words", 7), (4, "a moron!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own long")
    kept = [r for r in rows if "moron" not in (r[1] or "")]
    for few in (toxicity.BROADCAST_TEXTS, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_TEXTS", few)
        got = toxicity.drop_toxic(docs, model)
        assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, kept))
    assert seen == [("toxic", ["toxic"], 1 << 20)] * 2
