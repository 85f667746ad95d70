"""Steps of few rows take few tasks."""

import numpy as np
import pytest

from quietstar.llm import common as C
from quietstar.llm import components, ngram_join


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def _files(monkeypatch, module):
    found, real = [], module.read_back

    def read_back(spark, df, name):
        out = real(spark, df, name)
        found.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(module, "read_back", read_back)
    return found


def test_rounds_of_few_edges_take_few_tasks(spark, monkeypatch, many_partitions):
    files = _files(monkeypatch, components)
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {tuple(r) for r in components.components(spark, chain, 200).collect()} == {(i, 0) for i in range(201)}
    assert {"low", "large", "small"} <= {n for n, _ in files}
    assert all(n <= spark.sparkContext.defaultParallelism for _, n in files), files


@pytest.mark.parametrize("few", [C.FEW_ROWS, 0])
def test_tried_pairs_take_few_tasks(spark, monkeypatch, many_partitions, few):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    draw = np.random.default_rng(3)
    rows, family = [], {}
    for f in range(60):
        words = [f"w{x}" for x in draw.integers(0, 10**6, 60)]
        for k in range(3):
            family[len(rows)] = f * 3
            rows.append((len(rows), " ".join([*words[:-1], f"end{k}"])))
    files = _files(monkeypatch, ngram_join)
    got = {r.doc_id: r.component_id for r in ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == family
    near = [(n, k) for n, k in files if n in ("pairs", "near", "asked", "nearer", "inside", "named", "heads")]
    assert {"pairs", "near", "nearer"} <= {n for n, _ in near} and all(k <= spark.sparkContext.defaultParallelism for _, k in near), near
