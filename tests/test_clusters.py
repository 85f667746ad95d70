"""Clusters of all groups at once against plain rounds on each group."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietstar.operators import aspects, clusters
from quietstar.plans import topics


@pytest.fixture(scope="module")
def vectors(spark):
    """A group with half of all rows, middling ones, one under the least size and one of a single row."""
    draw, rows = np.random.default_rng(9), []
    for group, n in (("hot", 900), ("b", 400), ("c", 300), ("small", 12), ("one", 1)):
        centres = draw.normal(size=(5, 10))
        for i in range(n):
            own = 0 if group == "c" and i < 285 else i % 5
            rows.append((group, len(rows), [float(x) for x in centres[own] + draw.normal(scale=0.4, size=10)]))
    return rows, spark.createDataFrame([*rows, (None, 9999, [1.0] * 10), ("b", 9998, None)], "product_id string, review_id long, features array<double>")


def plain(rows, k, min_size, rounds, seed):
    out, groups = {}, {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i, v))
    for g, members in groups.items():
        members.sort()
        x = np.array([v for *_, v in members])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        head = x[: clusters.CANDIDATES]
        centres = head[clusters.farthest_first(head, k)]
        for _ in range(rounds):
            own = np.round(x @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T, 9).argmax(axis=1)
            new = centres.copy()
            for c in range(len(centres)):
                if (own == c).any():
                    total = x[own == c].sum(axis=0)
                    new[c] = np.round(total / np.linalg.norm(total), 9)
            if (new == centres).all():
                break
            centres = new
        own = np.round(x @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T, 9).argmax(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        order = sorted((c for c in range(len(centres)) if sizes[c]), key=lambda c: (-sizes[c], c))
        number = {c: n if sizes[c] >= min_size else -1 for n, c in enumerate(order)}
        out |= {i: number[c] for (_, i, _), c in zip(members, own, strict=True)}
    return out


def test_groups_equal_plain_rounds(spark, vectors, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 100)
    rows, df = vectors
    want = plain(rows, 5, 20, 20, 42)
    got = clusters.cluster_groups(df.repartition(7)).collect()
    assert {r["review_id"]: r["topic_id"] for r in got} == want and len(got) == len(rows)
    assert {r["topic_id"] for r in got if r["product_id"] in ("small", "one")} == {-1}
    assert len({r["topic_id"] for r in got if r["product_id"] == "hot"}) == 5


def test_blocks_do_not_change_clusters(spark, vectors, monkeypatch):
    _, df = vectors
    whole = sorted(map(tuple, clusters.cluster_groups(df, rounds=6).collect()))
    monkeypatch.setattr(clusters, "BLOCK", 37)
    assert sorted(map(tuple, clusters.cluster_groups(df.repartition(3), rounds=6).collect())) == whole


def test_no_rows(spark, vectors):
    assert clusters.cluster_groups(vectors[1].limit(0)).count() == 0


def test_found_topics_are_named_after_their_terms(spark):
    battery = ["battery drains fast charge dead", "battery charge fails dead power", "battery dead charge power drains"]
    sound = ["sound bass audio crisp volume", "bass sound volume audio rich", "audio sound crisp bass rich"]
    rows = [(p, i, body) for p in ("x", "y") for i, body in enumerate((battery + sound) * 15)] + [("z", i, b) for i, b in enumerate(sound)]
    df = spark.createDataFrame(rows, "product_id string, review_id long, clean_text string")
    rules = [("Battery", ["battery", "charge", "power"]), ("Sound", ["sound", "bass", "audio"])]
    got = topics.discovered_topics(df, k=2, rules=rules, overrides={}).collect()
    named = {(r["product_id"], r["topic_label"], r["n_reviews"]) for r in got if r["topic_id"] >= 0}
    assert named == {(p, label, 45) for p in ("x", "y") for label in ("Battery", "Sound")}
    assert {r["topic_id"] for r in got if r["product_id"] == "z"} == {-1}
    assert all(len(r["terms"].split(", ")) == 10 and abs(r["share_pct"] - 50) < 1e-9 for r in got if r["topic_id"] >= 0)


def test_term_weights_of_groups_are_those_of_each_alone(spark):
    rows = [("p", "a", "red red blue"), ("p", "b", "blue green"), ("q", "a", "red green green green"), ("q", "c", "violet")]
    df = spark.createDataFrame(rows, "product_id string, topic_label string, clean_text string")
    together = aspects.class_tfidf(df, by=["product_id"])
    for p in ("p", "q"):
        alone = aspects.class_tfidf(df.where(F.col("product_id") == p))
        assert sorted(map(tuple, together.where(F.col("product_id") == p).drop("product_id").collect())) == sorted(map(tuple, alone.collect()))
