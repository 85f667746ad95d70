"""Language-model scores, ranked search and the prefix trie against brute force, SQL and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietstar.llm import common as C
from quietstar.llm import katz, mixing, ngram_join, prefix_trie, queries, term_search

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, id long, learn string, chunk string, query long, score double"


def documents(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 0.5) for i, t in texts], DOC).repartition(parts)


def lowered(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


# Katz backoff -----------------------------------------------------------------------------


def brute_katz(rows, learned):
    """``n_tokens, n_known, train_tokens, base, score`` by row and the sum of one context's probabilities."""
    tokens = [["<s>", *[w for w in re.split(r"[\x20\x09-\x0d]+", lowered(t)) if w], "</s>"] for _, t in rows]
    words, pairs = Counter(), Counter()
    for t, known in zip(tokens, learned, strict=True):
        if known:
            words.update(t[1:])
            pairs.update(zip(t, t[1:], strict=False))
    total, distinct = sum(words.values()), len(words)

    def kept(counts):
        n = Counter(counts.values())
        out = {r: r - katz.TAIL for r in range(1, katz.LARGE + 1)}
        for r in out:
            if n[r] and n[r + 1] and n[1] and n[1] != 6 * n[6]:
                ratio = ((r + 1) * n[r + 1] / n[r] / r - 6 * n[6] / n[1]) / (1 - 6 * n[6] / n[1])
                if 0 < ratio < 1:
                    out[r] = ratio * r
        return lambda c: out.get(c, c - katz.TAIL)

    word, pair = kept(words), kept(pairs)
    rest = 1 - sum(map(word, words.values())) / total if total else 1
    share = lambda w: word(words[w]) / total if words[w] else rest
    followers = defaultdict(dict)
    for (v, w), c in pairs.items():
        followers[v][w] = c

    def chance(v, w):
        after = followers[v]
        if w in after:
            return pair(after[w]) / sum(after.values())
        if not after:
            return share(w)
        left = 1 - sum(map(pair, after.values())) / sum(after.values())
        return left / (1 - sum(map(share, after))) * share(w)

    out = []
    for t in tokens:
        steps = list(zip(t, t[1:], strict=False))
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for _, w in steps)
        out.append((len(steps), sum(words[w] > 0 for _, w in steps), total, base, sum(math.log10(chance(*s)) for s in steps)))
    sums = [sum(chance(v, w) for w in words) + chance(v, "never seen") for v in list(followers)[:5]]
    return out, sums


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_katz_scores_match_brute_force(spark, chunk):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=draw.randint(0, 40)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, " \t\n "), (203, "W1 w1 W2 É é"), (204, "the the " * 3000), (5, "again"), (5, "again")]
    learned = [i % 7 != 2 for i, _ in texts]
    want, sums = brute_katz(texts, learned)
    assert np.allclose(sums, 1)
    rows = katz.katz_scores(documents(spark, texts), F.col("id") % 7 != 2, chunk=chunk).collect()
    got = sorted((r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    for g, w in zip(got, sorted((i, k, *w) for (i, _), k, w in zip(texts, learned, want, strict=True)), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9)


def test_katz_of_odd_tables(spark):
    none = katz.katz_scores(documents(spark, []), F.lit(True))
    assert none.count() == 0
    unlearned = katz.katz_scores(documents(spark, [(1, "a b"), (None, "c")]), F.lit(None).cast("boolean")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in unlearned} == {(1, 3, 0, 0, 0.0, 0.0), (None, 2, 0, 0, 0.0, 0.0)}


def test_pairs_lower_the_perplexity_of_held_out_texts(spark):
    rows = queries.op11_katz_scores(spark, SF).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert rows[1] / rows[2] > rows[0] / rows[2] + 1


def test_packed_arrays_come_back():
    draw = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.sort(draw.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))):
        assert (katz.unpack_sorted(katz.pack_sorted(values)) == values).all()
        assert katz.slices(values, 7) == [(b, s, e) for b, s, e in katz.slices(values, 7) if (values[s:e] * 1.0 // (2**64 / 7) == b).all()]
    assert (katz.unpack(katz.pack(np.arange(5) / 3), np.float64) == np.arange(5) / 3).all()


# ranked search ----------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def brute_search(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // length
            scored.append((-sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t]), i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def searched():
    draw = random.Random(8)
    vocabulary = [f"t{i}" for i in range(150)]
    text = lambda: " ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(150)], k=draw.randint(1, 60)))
    docs = [(i, text()) for i in range(600)] + [(700, None), (701, ""), (702, "-- !"), (703, "T0_t1É é ü" * 400), (None, "t0 t1 t2"), (9, "t9 t9"), (9, "t9 t9")]
    items = [(i, text()) for i in range(25)] + [(30, None), (31, "nowhere"), (32, "t140 T140"), (33, "É"), (None, "t3 t4"), (0, "t149")]
    return docs, items


@pytest.mark.parametrize("limits", [(8192, 2_000_000), (16, 60)])
def test_search_matches_brute_force(spark, searched, limits, monkeypatch):
    monkeypatch.setattr(term_search, "CHUNK_DOCS", limits[0])
    monkeypatch.setattr(term_search, "BLOCK_CHARS", limits[1])
    docs, items = searched
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rank string")
    got = term_search.ranked_search(documents(spark, docs), asked, k=10)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)


def test_postings_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(term_search, "CHUNK_DOCS", 4)
    texts = [b"a b a", None, b"", b"c", b"A-b", b"a"] + [b"b"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(texts, pa.binary())], ["id", "text"])
    rows = [r.to_pylist()[0] for r in term_search._to_postings(SimpleNamespace(value={b"a": 0, b"b": 1}))(iter([batch]))]
    assert [r["ids"] for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert [(r["n"], r["l"]) for r in rows] == [(2, 4), (4, 5), (2, 2)]
    assert [(r["terms"], r["dfs"]) for r in rows] == [([0, 1], [1, 1]), ([0, 1], [2, 3]), ([1], [2])]
    assert katz.unpack(rows[0]["tfs"], np.int64).tolist() == [2, 1] and katz.unpack(rows[1]["docs"], np.uint16).tolist() == [0, 1, 0, 2, 3]


def test_accumulators_stop_and_scores_stay_exact():
    draw = np.random.default_rng(2)
    rare = [(np.sort(draw.choice(5000, 40, replace=False)), draw.integers(800, 1000, 40)) for _ in range(6)]
    often = [(np.sort(draw.choice(5000, 3000, replace=False)), draw.integers(1, 60, 3000)) for _ in range(4)]
    total, created, creating = term_search.best_of(rare + often, 5000, 10)
    full = np.zeros(5000, np.int64)
    for docs, scores in rare + often:
        full[docs] += scores
    assert creating <= 6 and len(created) <= 240
    assert (total[created] == full[created]).all()
    assert sorted(np.sort(full)[-10:]) == sorted(np.sort(total)[-10:])


def test_search_of_empty_tables(spark, searched):
    docs, items = searched
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert term_search.ranked_search(documents(spark, []), asked).count() == 0
    assert term_search.ranked_search(documents(spark, docs), asked.limit(0)).count() == 0


def test_search_matches_sql(spark):
    same_as_sql(spark, "op12_ranked_search")


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=str)
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == want


# prefix trie ------------------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = convs.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()), key=str
    )


def conversations(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth long")
    return df.repartition(parts)


@pytest.fixture(scope="module")
def talked():
    draw, rows = random.Random(5), []
    for c in [*range(-12, 60), 1000, 1003, 10**12]:
        if draw.random() < 0.85:
            for t in range(draw.choice([1, 2, 3, 5, 8, 9, 12, 40])):
                text = draw.choice(["a", "b", None, "é", "long text " * 3]) if t > 1 else "a"
                rows.append((c, None if draw.random() < 0.05 else t, draw.choice(["user", "assistant", None]), text))
    rows += [(7, 1, "user", "a")] * 3 + [(None, 1, "user", "x")]
    rows += [(c, t, "user", "same") for c, n in ((77, 300), (76, 300), (75, 3)) for t in range(n)]
    draw.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark, talked):
    got = prefix_trie.prefix_trie(conversations(spark, talked))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(talked)


def test_one_conversation_over_many_partitions(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(2000)] + [(6, t, "user", f"t{t % 7}") for t in range(2000)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        turns, lengths = prefix_trie.stored_turns(spark, conversations(spark, rows), "conv_id", "turn", "role", "text")
        assert turns.where("conv = 5").select("part").distinct().count() > 1
        assert {(r.conv, r.n) for r in lengths.collect()} == {(5, 2000), (6, 2000)}
        rest = turns.groupBy("place").agg(F.countDistinct("out0", "out1", "out2", "out3").alias("n")).where("n > 1").count()
        assert rest == 0 and turns.agg(F.count_distinct("place")).first()[0] == 2000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_products_of_a_run_are_the_monoid_product():
    places = np.arange(50)
    for base in prefix_trie.BASES:
        assert prefix_trie.power(base, places).tolist() == [pow(base, int(i), prefix_trie.P) for i in places]


def test_sequences_that_share_a_fingerprint_stop_the_job(spark):
    one = [(1, 1, 1, 9, 9, 0, 0, 5, 5, 3), (2, 1, 1, 9, 9, 0, 0, 6, 5, 3)]
    prefixes = spark.createDataFrame(one, "conv long, depth long, length long, f1 long, f2 long, p1 long, p2 long, turn1 long, turn2 long, bytes long")
    with pytest.raises(Exception, match="share a fingerprint"):
        prefix_trie.trie_nodes(spark, prefixes).count()


def test_trie_of_no_conversations(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0


def test_ids_are_joined_in_bounded_strings(monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    node = [[1] * 20 + [2] * 3, [5] * 23, [6] * 23, list(range(-3, 20))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in node], [*prefix_trie.KEY, "conv"])
    strings = next(prefix_trie._joined(iter([batch]))).to_pylist()
    assert all(r["ids"].count(",") < 7 for r in strings) and [r["first"] for r in strings] == sorted(r["first"] for r in strings)
    hashed = {tuple(r[k] for k in prefix_trie.KEY): r["ends"] for b in prefix_trie._hashed(pa.RecordBatch.from_pylist([{k: r[k] for k in [*prefix_trie.KEY, "first", "ids"]}]) for r in strings) for r in b.to_pylist()}
    assert hashed == {(d, 5, 6): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for d, ids in ((1, range(-3, 17)), (2, range(17, 20)))}


def test_ends_over_many_strings(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 1000, 5)] + [(c, 0, "user", "hello") for c in range(1, 1000, 5)]
    got = prefix_trie.prefix_trie(conversations(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_matches_sql(spark):
    same_as_sql(spark, "op13_prefix_trie")


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = katz.katz_scores(docs, ~C.held_out(F.col("id"), 7, 2)).select("doc_id", "learned").collect()
    assert all(r.learned == (zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in rows)


# mixing: long documents -------------------------------------------------------------------


def sourced(spark, rows):
    return spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")


def test_a_source_of_one_long_document_is_not_missing(spark):
    docs = sourced(spark, [("long", 50_000), *[("a", 100)] * 120, *[("b", 79)] * 100])
    rows = mixing.mix_sources(docs, keep=("doc_id", "source")).toPandas()
    assert set(rows["source"]) == {"long", "a", "b"} and (rows[rows["source"] == "long"]["n_tokens"] == 50_000).all()


def test_documents_that_do_not_fit_make_way_for_those_that_do(spark):
    draw = random.Random(2)
    docs = sourced(spark, [(s, draw.choice([3, 10, 40, 2000])) for s in "abcd" for _ in range(80)])
    tokens = {r.source: r.tokens for r in mixing.source_tokens(docs).collect()}
    for budget in (3000.0, 20_000.0, 90_000.0):
        exponent = mixing.find_exponent(mixing.source_tokens(docs), budget, mixing.REPETITIONS)
        wanted = {r.source: r["take"] for r in mixing.mixture_weights(mixing.source_tokens(docs), exponent, budget).collect()}
        rows = mixing.mix_sources(docs, budget, keep=("doc_id", "source")).toPandas()
        taken = rows.groupby("source").n_tokens.sum()
        assert set(taken.index) == set(tokens)
        # Under the budget, but for a source of which nothing fits.
        assert all(taken[s] <= wanted[s] or len(rows[rows.source == s]) == 1 for s in tokens)
        assert rows.groupby(["doc_id", "epoch"]).size().max() == 1


def test_a_block_is_filled_as_by_hand(spark):
    draw, rows = random.Random(6), []
    for block in range(40):
        room, before = draw.randint(0, 120), draw.choice([0, 5])
        rows += [("s", block, 0, room, before, 1000, key, draw.choice([0, 1, 7, 30, 80, 200])) for key in range(draw.randint(1, 9))]
    inside = spark.createDataFrame(rows, "source string, block long, epoch int, room long, before long, take long, key long, t long")
    got = {(r.block, r.key) for r in mixing._fitting(inside).collect()}
    want = set()
    for block in range(40):
        docs = [(r[6], r[7]) for r in rows if r[1] == block]
        room, before = next((r[3], r[4]) for r in rows if r[1] == block)
        used, taken = 0, []
        for key, t in docs:
            if used + t > room:
                break
            used, taken = used + t, [*taken, (key, t)]
        for key, t in sorted((x for x in docs if x not in taken), key=lambda x: (x[1], x[0])):
            if used + t <= room:
                used, taken = used + t, [*taken, (key, t)]
        if before == 0 and not any(t for _, t in taken):
            taken += [next((x for x in docs if x[1]), docs[0])]
        want |= {(block, key) for key, _ in taken}
    assert got == want


# n-gram join: fine points -----------------------------------------------------------------


def test_fine_points_bound_overlaps_from_above():
    draw = np.random.default_rng(12)
    for n, m, shared in ((5, 6, 5), (200, 220, 150), (3000, 2500, 2400), (9000, 8000, 10), (40, 5000, 40)):
        tokens = draw.integers(0, 1 << 63, n + m - shared).astype(np.uint64) * np.uint64(2)
        a, b = np.sort(tokens[:n]), np.sort(tokens[n - shared :])
        bound = ngram_join.fine_bound(ngram_join.fine_point(a), ngram_join.fine_point(b))
        assert bound >= shared and ngram_join.fine_bound(ngram_join.fine_point(a), ngram_join.fine_point(a)) >= n
    assert bound < 40 * 1.01
    far = ngram_join.fine_bound(*(ngram_join.fine_point(draw.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)) for _ in range(2)))
    assert far < ngram_join.needed(20_000, 20_000) * 0.8
    same = np.full(600, 7, np.uint64)  # one coordinate, over 255
    assert ngram_join.fine_bound(ngram_join.fine_point(same), ngram_join.fine_point(same)) >= 600
