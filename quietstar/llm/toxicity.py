"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to insult or threat symbols with weights: it accepts whole words and word stems of four to six
letters whose weight (log odds of toxic against clean labelled documents) is learned. A clause automaton then reads a clause's
symbols and composes them with targets, negation and reported speech: it keeps the state (target seen, negation open, report
open) and sends the best weight of a match to one of three outputs: plain, negated or reported. A document's outputs (best
weight by output, best aimed at a target, matched clauses) go through a logistic calibration learned on other labelled rows.

Learning reads about ``LEARN_ROWS`` labelled rows; the lexicon keeps the ``LEXICON`` most significant entries. Both bound the
model, not the scoring: every whole text is scored.

Defined results: null, empty and wordless texts match nothing and get the score of a document without matches; with no labels
at all the seed words alone decide; repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C
from .learning import fit_logistic, learning_rows, predict_logistic
from .shingles import shingle_set

LEARN_ROWS = 20_000
LEXICON = 20_000
#: Likelihood ratio (2 ln) an entry needs; at a toxic share of a tenth, seven toxic documents and no clean one.
SIGNIFICANT = 32.0
#: Log odds an entry needs.
LEAST_WEIGHT = 4.5
STEMS = (4, 5, 6)
FLUSH = 400_000
#: Digests up to here (32 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_TEXTS = 500_000

INSULTS = frozenset("idiot moron scum loser pathetic worthless stupid trash clown disgusting".split())
THREATS = frozenset("kill hurt murder stab shoot destroy burn beat".split())
TARGETS = frozenset("you your yours he she they them him her ihr du dich sie tu te vous toi usted ustedes eres".split())
NEGATIONS = frozenset("not never no nobody nor isn aren don doesn nicht kein nie pas jamais nunca ni".split())
REPORTS = frozenset("said says say wrote quoted called claims reported according sagte schrieb dit dijo escribió".split())
#: A threat counts only when aimed at someone; seeds weigh this much until labels say more.
SEED_WEIGHT = 4.0
#: Words a negation stays open.
NEGATION_SPAN = 3

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n\r]+")
OUTPUTS = ("plain", "negated", "reported", "aimed", "clauses")


def _entries(text: str) -> set[str]:
    """Whole words (``=word``) and stems (``stem``) of a text."""
    words = set(_WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    toxic: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], ["entry", "toxic", "n"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            entries = _entries(text)
            found.update(entries)
            if label:
                toxic.update(entries)
            if len(found) > FLUSH:
                yield flush()
                found, toxic = Counter(), Counter()
    if found:
        yield flush()


def _families(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys = []
    for text in batch.column(1):
        tokens = shingle_set(text.as_py()).view(np.int64)
        keys.append((int(tokens.min()), int(tokens.max())) if len(tokens) else (0, 0))
    low, high = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), low, high], ["id", "text", "label", "low", "high"])


def one_of_family(rows: DataFrame) -> DataFrame:
    """``id``, ``text``, ``label`` of one row (smallest id) of each family of copies in a learning sample.

    Near copies mostly share their smallest or their largest shingle hash. Without this, the words of one much copied toxic
    document look as toxic as an insult.
    """
    keyed = rows.select("id", "text", "label").mapInArrow(C.per_batch(_families), "id long, text string, label int, low long, high long")
    for key in ("low", "high"):
        keyed = keyed.groupBy("label", key).agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in ("label", key)]), "id").alias("r"))
        keyed = keyed.select("label", key, "r.*")
    return keyed.select("id", "text", "label")


def _learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entry to weight. ``rows``: text, label."""
    sums = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    total, bad = int(sums["n"]), int(sums["t"])
    lexicon = {f"={w}": SEED_WEIGHT for w in INSULTS | THREATS}
    if not 0 < bad < total:
        return lexicon
    counts = rows.mapInArrow(_count_entries, "entry string, toxic long, n long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("n").alias("n"))
    t, n, share = F.col("t"), F.col("n"), bad / total
    term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    ratio = 2 * (term(t, n * share) + term(n - t, n * (1 - share)))
    odds = F.log((t + 0.5) / (bad + 1.0)) - F.log((n - t + 0.5) / (total - bad + 1.0))
    chosen = counts.where("t >= 3").select("entry", ratio.alias("g"), odds.alias("w"))
    chosen = chosen.where((F.col("g") >= SIGNIFICANT) & (F.col("w") >= LEAST_WEIGHT)).orderBy(F.desc("g"), "entry").limit(LEXICON)
    return lexicon | {r["entry"]: float(r["w"]) for r in chosen.collect()}


class Grammar:
    """The composed transducers; ``outputs`` reads a text."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {e.lstrip("=")[: STEMS[0]] for e in lexicon}
        self.threats = {f"={w}" for w in THREATS}

    def symbol(self, word: str) -> tuple[float, bool]:
        """Weight of the best accepting path of a word (0: none), and whether it is a threat."""
        paths = [f"={word}", *(word[:k] for k in STEMS if len(word) >= k)]
        best = max(paths, key=lambda p: self.lexicon.get(p, 0.0))
        return self.lexicon.get(best, 0.0), best in self.threats

    def clause(self, words: list[str]) -> tuple[float, float, float, float]:
        """Best weights by output: plain, negated, reported, aimed."""
        target = report = False
        open_for, out, aims = 0, [0.0, 0.0, 0.0], 0.0
        target = any(w in TARGETS for w in words)
        for word in words:
            if word in NEGATIONS:
                open_for = NEGATION_SPAN + 1
            elif word in REPORTS:
                report = True
            weight, threat = self.symbol(word) if word[: STEMS[0]] in self.heads else (0.0, False)
            if weight and (target or not threat):
                state = 2 if report else 1 if open_for > 0 else 0
                out[state] = max(out[state], weight)
                aims = max(aims, weight if target else 0.0)
            open_for -= 1
        return out[0], out[1], out[2], aims

    def outputs(self, text: str | None) -> list[float]:
        """Best weights by output, and the matched clauses (log)."""
        best, matched = [0.0] * 4, 0
        low = (text or "").lower()
        heads, size = self.heads, STEMS[0]
        if any(w[:size] in heads for w in _WORD.findall(low)):
            for part in _CLAUSE.split(low):
                words = _WORD.findall(part)
                if any(w[:size] in heads for w in words):
                    found = self.clause(words)
                    matched += any(found)
                    best = [max(x) for x in zip(best, found, strict=True)]
        return [*best, math.log1p(matched)]


def _outputs_of(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            rows = np.array([grammar.outputs(t) for t in batch.column(0).to_pylist()], float).reshape(-1, len(OUTPUTS))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in rows.T)], ["label", *OUTPUTS])

    return run


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, bound: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: lexicon (from seven tenths of the sample) and calibration (from the rest)."""
    rows = learning_rows(docs, labels, "toxic", learnable, bound, id_col, text_col)
    with C.small_batches(docs.sparkSession, size=C.TEXT_BYTES):
        return _learned(read_back(docs.sparkSession, one_of_family(rows), "sample"))


def _learned(rows: DataFrame) -> dict:
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(10))
    lexicon = _learn_lexicon(rows.where(part < 7).select("text", "label"))
    shape = "label int, " + ", ".join(f"{c} double" for c in OUTPUTS)
    seen = rows.where(part >= 7).select("text", "label").mapInArrow(_outputs_of(lexicon), shape).toPandas()
    # Two rows of prior knowledge: no match is clean, a plain match of seed weight is toxic.
    prior = np.array([[0.0] * 5, [SEED_WEIGHT, 0, 0, 0, math.log(2)]])
    x, y = np.vstack([seen[list(OUTPUTS)].to_numpy(), prior]), np.append(seen["label"].to_numpy(), [0, 1])
    return {"lexicon": lexicon, "calibration": fit_logistic(x, y)}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, calibration = Grammar(shared.value["lexicon"]), shared.value["calibration"]
        for batch in batches:
            rows = np.array([grammar.outputs(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(OUTPUTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict_logistic(calibration, rows))], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(out.dtypes)["id"]
    return out.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The documents scored under 0.5, with the columns of ``docs``.

    Every whole text is scored, in small batches without the other columns; a score hangs on the text alone, so digests of the
    toxic texts say which rows go. They are broadcast while they are few.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, calibration = Grammar(shared.value["lexicon"]), shared.value["calibration"]
        for batch in batches:
            rows = np.array([grammar.outputs(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(OUTPUTS))
            toxic = predict_logistic(calibration, rows) >= 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(toxic))], ["toxic"])

    # A null text scores as an empty one.
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    with C.small_batches(spark, size=C.TEXT_BYTES):
        toxic = read_back(spark, docs.select(digest.alias("own"), text.alias("text")).mapInArrow(run, "toxic binary").distinct(), "toxic")
    rows = C.carried(docs, digest.alias("own"))
    few = toxic.count() <= BROADCAST_TEXTS
    return C.released(rows.join(F.broadcast(toxic) if few else toxic, F.col("own") == F.col("toxic"), "left_anti"))
