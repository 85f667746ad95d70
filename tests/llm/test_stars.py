"""Stars and rounds that change nothing are not made."""

import numpy as np

from quietstar.llm import components, ngram_join


def _written(monkeypatch, module):
    names, real = [], module.read_back
    monkeypatch.setattr(module, "read_back", lambda s, df, name: names.append(name) or real(s, df, name))
    return names


def test_settled_edges_need_no_round(spark, monkeypatch):
    names = _written(monkeypatch, components)
    got = components.components(spark, spark.createDataFrame([(2, 1), (3, 1), (9, 8), (1, 2), (None, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)] and names == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {tuple(r) for r in components.components(spark, chain).collect()} == {(i, 0) for i in range(21)}
    assert components.components(spark, chain.limit(0)).count() == 0


def test_small_cells_are_searched_without_further_stars(spark, monkeypatch):
    draw = np.random.default_rng(7)
    base = [f"w{x}" for x in draw.integers(0, 10**6, 40)]
    rows = []
    for i in range(30):
        words = list(base)
        for at in draw.choice(36, i % 6, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = _written(monkeypatch, ngram_join)
    once = {tuple(r) for r in ngram_join.near_classes(docs).collect()}
    assert "turn" not in names and "dealt" in names
    names.clear()
    monkeypatch.setattr(ngram_join, "MEETINGS", 0)
    assert {tuple(r) for r in ngram_join.near_classes(docs).collect()} == once

    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    assert once == {(i, len(sets[i]), least[i]) for i in sets} and len(set(least.values())) > 1
