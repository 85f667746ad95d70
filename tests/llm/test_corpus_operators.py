"""The corpus operators against brute force, held-out accuracy and edge cases."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quietstar.llm import common as C
from quietstar.llm import components, decontamination, exact_dedup, language, line_dedup, mixing, ngram_join, pii, quality, queries, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h string"
SF = "/root/testdata/sf0.01"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 3 else "s", 0, "x", "y") for i, t in texts], DOC)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (6, "a  b\tc d e f g " * 3000), (7, "a b c d e f g " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


# exact de-duplication ---------------------------------------------------------------------


def test_exact_copies_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(sf_dir, 'documents.parquet')}')")
    want = con.execute(queries.ORACLES["op9_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op9_exact_dedup(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(want)].astype(str))


def test_exact_copies_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.kept, r.group_size) for r in exact_dedup.exact_copies(odd).collect()}
    assert {(1, True, 2), (2, False, 2), (3, True, 1), (4, True, 3), (5, False, 3), (None, True, 1), (6, True, 2), (7, False, 2)} == got
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6]
    assert exact_dedup.exact_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_hash_collisions_are_told_apart_by_bytes(spark):
    df = documents(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc")])
    got = exact_dedup.exact_copies(df, content_hash=lambda body: F.unhex(F.lit("00"))).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size) for r in got] == [(1, 2), (2, 1), (1, 2), (4, 1)]


def test_repeated_kept_rows_become_one(spark):
    df = documents(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "b")])
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == [1, 3]


# components -------------------------------------------------------------------------------


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# n-gram Jaccard join ----------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_classes_match_brute_force(spark):
    draw, texts = random.Random(3), []
    shared = " ".join(f"common{i}" for i in range(30))
    for family in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randint(3, 160))]
        for _ in range(draw.randint(1, 14)):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 18))):
                words[draw.randrange(len(words))] = f"x{draw.randrange(9999)}"
            texts.append((len(texts), " ".join(words) + (" " + shared if family % 3 == 0 else "")))
    texts += [(900, None), (901, ""), (902, "Same FEW"), (903, "same few")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(documents(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_near_copies_odd_rows(odd, none):
    got = ngram_join.near_classes(odd).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)}
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert ngram_join.near_classes(none).count() == 0


def test_tree_never_misses():
    import numpy as np

    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[:55], draw.integers(0, 2**63, 4).astype(np.uint64)])) for s in sets]
    at = ngram_join.points(np.frombuffer(b"".join(ngram_join.point(s) for s in sets), np.uint8).reshape(len(sets), -1))
    n = np.array([len(s) for s in sets])
    tree = ngram_join.Tree(at, n)
    for i, s in enumerate(sets):
        links = {j for j, o in enumerate(sets) if len(np.intersect1d(s, o)) >= ngram_join.needed(len(s), len(o))}
        assert links <= set(tree.search(at[i], len(s)).tolist())


# toxicity, quality, language --------------------------------------------------------------


def test_toxicity_held_out(spark, small):
    docs, labels = small
    model = toxicity.learn(docs, labels, ~C.held_out(F.col("id"), 5, 0))
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(C.held_out(F.col("doc_id"), 5, 0)).toPandas()
    assert (rows.predicted == rows.toxic).mean() > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_grammar_composes_targets_negation_and_reports():
    grammar = toxicity.Grammar({"=moron": 4.0, "=kill": 4.0})
    assert grammar.outputs("You moron.")[0] == 4.0 and grammar.outputs("You moron.")[3] == 4.0
    assert grammar.outputs("he is not a moron")[:2] == [0.0, 4.0]
    assert grammar.outputs("she said moron")[2] == 4.0
    assert grammar.outputs("kill time")[0] == 0.0 and grammar.outputs("I kill you")[0] == 4.0
    assert grammar.outputs(None) == grammar.outputs("") == [0.0] * 5


def test_scores_of_odd_rows_without_labels(spark, odd, none):
    empty = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for module, learn, score in ((toxicity, toxicity.learn, toxicity.score_toxicity), (quality, quality.learn, quality.score_quality)):
        model = learn(odd, empty, F.lit(True))
        rows = score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows), module
        assert score(none, model).count() == 0
    assert toxicity.drop_toxic(odd, toxicity.learn(odd, empty, F.lit(True))).count() == len(ODD)


def test_quality_held_out(spark, small):
    docs, labels = small
    model = quality.learn(docs, labels, ~C.held_out(F.col("id"), 3, 1))
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where(C.held_out(F.col("doc_id"), 3, 1)).toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.9


def test_language_held_out_and_odd(spark, small, odd, none):
    docs, _ = small
    model = language.learn(docs, ~C.held_out(F.col("id"), 3, 1))
    rows = language.tell_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(C.held_out(F.col("doc_id"), 3, 1)).toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()
    told = {r.doc_id: r for r in language.tell_language(odd, model).collect()}
    assert [told[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and told[6].lang_pred != "und" and told[1].score == 0
    assert language.tell_language(odd, language.learn(none, F.lit(True))).where("lang_pred <> 'und'").count() == 0


# decontamination --------------------------------------------------------------------------


def edits_of(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def test_items_within_their_budget_are_found():
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea at dawn"
    index, draw = decontamination.Index([(1, item)]), random.Random(2)
    for _ in range(120):
        letters = list(item)
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(letters))
            letters[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "y"])
        text = "".join(draw.choice("abcdef ") for _ in range(draw.randint(0, 200))) + "".join(letters) + "".join(draw.choice("abcdef ") for _ in range(draw.randint(0, 90)))
        best, found = edits_of(item, text), decontamination.find_items(text, index)
        assert (best <= index.budget[0]) == bool(found) and (not found or found[0][3] == best)


def test_contamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "A passage of the benchmark that nobody should train on."), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    held = documents(spark, [*ODD, (8, "x " * 600_000 + "a passage of the BENCHMARK that\nnobody should train on. y"), (8, "clean"), (9, None)])
    rows = decontamination.contamination(held, items).collect()
    assert len(rows) == len(ODD) + 3 and {r.doc_id for r in rows if r.contaminated} == {8}
    assert next(r.leaks for r in rows if r.contaminated) == "1:1200000:1255:0".replace("1255", "1200055")
    kept = decontamination.drop_contaminated(held, items)
    assert kept.columns == held.columns and kept.count() == len(ODD) + 1
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.drop_contaminated(odd, items.limit(0)).count() == len(ODD)


def test_rows_without_an_id_of_their_own_are_judged_by_their_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    held = documents(spark, [(None, f"x {item} y"), (None, "clean"), (None, None), (8, item), (8, "clean too"), (9, "fine")])
    kept = corpus_pipeline.decontamination_stage(spark, held, SF)
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == ["(8, 'clean too')", "(9, 'fine')", "(None, 'clean')", "(None, None)"]
    whole = decontamination.drop_contaminated(held, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(str((r.doc_id, r.text)) for r in whole.collect()) == ["(9, 'fine')", "(None, 'clean')", "(None, None)"]


def test_near_copies_without_an_id_of_their_own(spark):
    base = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    near = lambda words, n: " ".join([*words, *(f"end{n}x{i}" for i in range(n))])
    rows = [(None, near(base[0], n)) for n in (0, 1, 2)] + [(None, near(base[1], n)) for n in (0, 1)] + [(4, near(base[1], 2))]
    rows += [(7, near(base[2], 0)), (7, near(base[2], 1)), (7, "quite another text"), (1, "linked to none"), (None, None), (None, "")]
    rows += [(None, near(base[0], 0)), (4, near(base[1], 2))]
    kept = [(r.doc_id, r.text) for r in ngram_join.drop_near_copies(documents(spark, rows)).collect()]
    assert sum((t or "").startswith("a0 ") for _, t in kept) == 1 and [i for i, t in kept if (t or "").startswith("b0 ")] == [4]
    assert sum((t or "").startswith("c0 ") for _, t in kept) == 1 and {(7, "quite another text"), (1, "linked to none"), (None, None), (None, "")} <= set(kept)
    assert len(kept) == 7
    found = [r.component_id for r in ngram_join.near_classes(documents(spark, rows)).collect() if r.doc_id is None]
    assert sorted(map(str, found)) == ["4", "4"] + ["None"] * 6


# mixing -----------------------------------------------------------------------------------


def test_mixture_meets_its_limit_and_budget(spark, small):
    docs, _ = small
    tokens = {r.source: r.tokens for r in mixing.source_tokens(docs).collect()}
    total = sum(tokens.values())
    rows = mixing.mix_sources(docs, keep=("doc_id", "source")).toPandas()
    taken = rows.groupby("source").n_tokens.sum()
    longest = max(len((r.text or "").split()) for r in docs.select("text").collect())
    assert all(taken[s] <= mixing.REPETITIONS * tokens[s] + longest for s in taken.index)
    assert total * 0.9 < taken.sum() <= total + len(tokens)
    assert rows.groupby(["doc_id", "epoch"]).size().max() == 1 and rows.epoch.max() <= 1
    assert max(taken / total) < max(tokens.values()) / total


def test_exponent_reaches_an_entropy(spark):
    import math

    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("d", 0)], "source string, tokens long")
    found = mixing.find_exponent(sources, 1000.0, None, 0.9)
    weights = [r.weight for r in mixing.mixture_weights(sources, found, 1000.0).collect()]
    assert abs(-sum(w * math.log(w) for w in weights) - 0.9) < 1e-4 and abs(sum(weights) - 1) < 1e-9
    assert mixing.find_exponent(sources, 1000.0, 1.0) == 1.0


def test_mixing_odd_rows(odd, none):
    rows = mixing.mix_sources(odd, budget=1e9, repetitions=None, entropy=0.0)
    assert {"epoch", "stream_block", "mix_key", "n_tokens", *odd.columns} == set(rows.columns)
    assert mixing.mix_sources(none).count() == 0


# personal data ----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad and not (kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_seeds_match_the_plain_patterns(spark, odd, none):
    draw = random.Random(7)
    pieces = ["a@b.c", "x_y@d-e.f.g", "@", ".", "1.2.3.4", "300.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+1", "é", "𝒳", " ", "-", "7", "_", "\n", "12 34"]
    texts = [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 30)))) for i in range(400)]
    texts += [(900, "1.2.3.4 " * 3000), (901, "9" * 50_000), (902, "a" * 50_000), (903, "a.b@c.d.e@f.g_h@i.j")]
    for r in pii.find_personal_data(documents(spark, texts)).collect():
        want = base_spans(dict(texts)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k) for k in BASE)
    assert pii.find_personal_data(odd).count() == len(ODD) and pii.find_personal_data(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [(i, f"please write to user{i}@mail.org for more") for i in range(5)] + [(9, "please write to user9(at)mail9 for more"), (10, "see page 9 there")]
    got = {r.doc_id: (r.spans, r.n_email) for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert got[9] == ("email:16:30", 0) and got[10] == ("", 0) and got[0] == ("email:16:30", 1)


# lines ------------------------------------------------------------------------------------


def test_repeated_chunks_go_but_their_first_place_stays(spark):
    draw = random.Random(1)
    run = [f"shared line {i}" for i in range(24)]
    texts = []
    for i in range(8):
        own = [f"own {i} {draw.randrange(10**9)}" for _ in range(draw.randint(1, 9))]
        texts.append((i, "\n".join(own + run + [f"end {i}"])))
    texts += [(20, None), (21, ""), (22, "own line"), (23, "own line")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert got[0].text == dict(texts)[0] and got[0].lines_cut == 0
    assert all(got[i].lines_cut >= 12 for i in range(1, 8))
    for i in range(1, 8):
        lines, left = dict(texts)[i].split("\n"), Counter(got[i].text.split("\n"))
        assert len(lines) - len(got[i].text.split("\n")) == got[i].lines_cut and not left - Counter(lines)
        assert all(x in got[i].text for x in lines if x.startswith("end"))
    assert got[20].text is None and got[21].text == "" and got[22].text == got[23].text == "own line"


def test_runs_of_two_lines_go_wherever_they_stand(spark):
    draw, fresh = random.Random(4), iter(range(10**6))
    runs = [[f"run {r} line {i}" for i in range(2 + r % 4)] for r in range(24)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(draw.randint(1, 3)):
            lines += [f"own {next(fresh)}" for _ in range(draw.randint(1, 3))] + draw.choice(runs)
        texts.append((i if i % 7 else None, "\n".join(lines)))
    texts += [(70, "x\nx\nx\ny"), (71, "run 0 line 0\nalone"), (72, "only here\nand here"), (72, "run 0 line 0\nrun 0 line 1")]
    place = lambda row: (row[0] is None, row[0] or 0, hashlib.md5(row[1].encode()).digest())
    met, want = set(), {}
    for row in sorted(texts, key=place):
        lines, gone = row[1].split("\n"), set()
        for j, pair in enumerate(zip(lines, lines[1:])):
            gone |= {j, j + 1} if pair in met else set()
            met.add(pair)
        want[row] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone))
    frame = documents(spark, texts).withColumn("keep_id", F.col("text"))
    got = {(r.doc_id, r.keep_id): (r.text, r.lines_cut) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == want
    assert {x for _, t in texts for x in t.split("\n")} == {x for t, _ in got.values() for x in t.split("\n") if t}


def test_line_dedup_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "lines_cut"] and got.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


# urls -------------------------------------------------------------------------------------


def test_verdicts_spread_over_aliases(spark):
    html = '<html><head><link rel="canonical" href="{}"></head>'
    pages = [
        (1, "https://a.example.com/en/x?utm_source=q#t", None), (2, "http://mirror.org/x", html.format("https://a.example.com/en/x")),
        (3, "http://m2.org/y", html.format("http://mirror.org/x")), (4, "http://other.org/z", '<meta http-equiv="refresh" content="0; url=http://www.example.com/en/">'),
        (5, "HTTP://NET/es/", ""), (6, None, None), (7, "no scheme", None), (8, "https://sub.net/es/k", None), (9, "https://plain.org", None), (10, "ftp://X.Com/a?b", None),
        (11, "http://both.org/", html.format("http://www.example.com/en/p")), (12, "http://both.org", html.format("http://q.example.com/en/p")), (5, "HTTP://NET/es/", ""),
    ]
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    rows = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][2:] == (None, "allow") and got[5] == ("net", "/es/", "net/es/", "block") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][2:] == ("net/es/", "block") and got[9] == ("plain.org", "", None, "allow") and got[10] == ("x.com", "/a", "com/", "allow")
    assert got[11][3] == got[12][3] == "allow"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_all_links_of_a_page_are_resolved(spark):
    rest = F.lit("host.org/a/b/page?q=1")
    wanted = {
        "x.html": "host.org/a/b/x.html", "../x": "host.org/a/x", "../../../x?y=../z": "host.org/x?y=../z", "./": "host.org/a/b/", "..": "host.org/a/", "?id=3": "host.org/a/b/page?id=3",
        "/r/../s": "host.org/s", "//other.net/p": "other.net/p", "https://o.net/../p": "o.net/../p", "#top": None, "": None, "mailto:a@b.c": None, "x?u=http://o.net/": "host.org/a/b/x?u=http://o.net/",
        "/": "host.org/", "/r?u=http://o.net/": "host.org/r?u=http://o.net/",
    }
    rows = spark.createDataFrame([(k,) for k in wanted], "link string").select("link", url_filter.linked(F.col("link"), rest).alias("to")).collect()
    assert {r.link: r.to for r in rows} == wanted
    tag = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://block.net/es/a", None), (2, "http://m.org/d/x", tag.format("y.html")), (3, "http://m.org/d/y.html", tag.format("http://none.org/") + tag.format("//block.net/es/a")),
        (4, "http://m.org/e/x", '<meta http-equiv="refresh" content="9"><meta http-equiv="refresh" content="0; url=../d/x">'), (5, "http://m.org/f", None),
        (6, "http://m.org", tag.format("d/x")), (7, "http://n.org/z", tag.format("//block.net/es/" + "k" * 100_100)), (8, "http://block.net/fr", tag.format("?a=1")),
    ]
    rules = spark.createDataFrame([("block.net", "/es/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {i: "block" if i in (1, 2, 3, 4, 6, 7) else "allow" for i in range(1, 9)}


# pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now < left, name
        left = now
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts}) == len(texts)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in (t or "") for _, t in texts for i in items)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(columns) <= set(mixed.columns) and {r.doc_id for r in mixed.select("doc_id").collect()} <= left
