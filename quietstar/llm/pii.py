"""Personal data by bootstrapped contextual extraction.

*Seeds.* Emails, addresses, card numbers and phone numbers are matched by fixed patterns (:data:`KINDS`), leftmost first and not
overlapping within a kind; what fails its check (parts, Luhn sum, digits) is dropped without another try.

*Bootstrapping.* Seeds and all other words with a digit or an ``@`` are occurrences with a context: the two words before, and the
word before with the word after. Contexts (patterns) and distinct identifiers (instances) form a graph. In each round a pattern
is scored by the share of its instances that are known, patterns with ``SUPPORT`` known instances and a score of ``CONFIDENCE``
or more are accepted, and their other instances become known as the pattern's kind. Spans of instances found that way are added
beside the seeds.

Everything is DataFrame functions. A text is read once: matches come from ``regexp_extract_all``, their places from the lengths
of the pieces that ``split`` leaves. The patterns never run twice over a stretch: starts within a run are excluded and
repetitions are possessive, so long runs cost linear time. Only occurrences, never texts, are shuffled.

Defined results: null and empty texts have no spans; rows repeated with one id and text have the same spans each; an empty
table gives an empty result; counts and ``base_sha256`` are of the seeds alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import read_back

#: Kind to pattern. Each finds what the plain pattern in its comment finds: a run that cannot start a match is not tried from
#: its middle, except where the match before ended inside it.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3
#: Characters of a gap that are read for context.
REACH = 80
BLOCK = 256


def _running(lengths: Column, start: Column) -> Column:
    """Sums of all lengths before each place, from ``start`` on: within blocks, then over blocks, so the cost stays low."""
    def append(values: Column, first: Column) -> Column:
        zero = F.struct(first.cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(values, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]

    count = F.ceil(F.size(lengths) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(lengths, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
    offsets = append(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda x, y: x + y)), start)
    inner = F.transform(blocks, lambda b: append(b, F.lit(0)))
    out = F.flatten(F.transform(F.arrays_zip(inner.alias("i"), offsets.alias("o")), lambda z: F.transform(z["i"], lambda v: v + z["o"])))
    return F.when(F.size(lengths) > 0, out).otherwise(F.array().cast("array<bigint>"))


def _before(gap: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(gap, F.lit(REACH)), r"(\S+\s+\S+)\s+$", 1))


def _last(gap: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(gap, F.lit(REACH)), r"(\S+)\s+$", 1))


def _after(gap: Column) -> Column:
    return F.lower(F.regexp_extract(F.left(gap, F.lit(REACH)), r"^\s+(\S+)", 1))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(PART))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
        parts = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: doubled(d.cast("int"), i))
        return F.when(F.length(digits).between(13, 19), F.aggregate(parts, F.lit(0), lambda x, y: x + y) % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


_OCCURRENCE = "array<struct<kind:string,start:bigint,stop:bigint,word:string,two:string,pair:string>>"


def _occurrences(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds ``o_<kind>``: every match with its place and context; most texts have none, and cost a search only."""
    m, g, s = f"m_{kind}", f"g_{kind}", f"s_{kind}"
    df = df.withColumn(m, F.regexp_extract_all("body", F.lit(pattern), F.lit(0)))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split("body", pattern, -1)))
    steps = F.zip_with(F.col(m), F.slice(F.col(g), F.lit(2), F.size(m)), lambda x, y: (F.length(x) + F.length(y)).cast("long"))
    df = df.withColumn(s, F.when(F.size(m) > 0, _running(steps, F.length(F.get(g, F.lit(0))))))

    def occurrence(i: Column) -> Column:
        word, start = F.get(m, i), F.get(s, i)
        left, right = F.get(g, i), F.get(g, i + 1)
        pair = F.when((_last(left) != "") & (_after(right) != ""), F.concat_ws(" _ ", _last(left), _after(right))).otherwise("")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(word)).alias("stop"), word.alias("word"), _before(left).alias("two"), pair.alias("pair"))

    every = F.transform(F.sequence(F.lit(0), F.size(m) - 1), occurrence)
    if kind in KINDS:
        every = F.filter(every, lambda o: _valid(kind, o["word"]))
    return df.withColumn(f"o_{kind}", F.when(F.size(m) > 0, every).otherwise(F.array().cast(_OCCURRENCE))).drop(m, g, s)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``."""
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    for kind, pattern in {**KINDS, "word": IDENTIFIER}.items():
        df = _occurrences(df, kind, pattern)
    seeds = F.concat(*[F.col(f"o_{k}") for k in KINDS])
    # A word that touches a seed is no candidate.
    free = F.filter("o_word", lambda w: ~F.exists(F.col("seeds"), lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))
    df = df.select("id", F.xxhash64("body").alias("print"), seeds.alias("seeds"), "o_word")
    found = read_back(spark, df.select("id", "print", "seeds", free.alias("words")), "found")

    every = found.select("id", "print", F.explode(F.concat("seeds", "words")).alias("o")).select("id", "print", "o.*")
    patterns = F.filter(F.array(F.concat(F.lit("2 "), "two"), F.concat(F.lit("1 "), "pair")), lambda p: F.length(p) > 2)
    edges = every.select("kind", "word", F.explode(patterns).alias("pattern")).groupBy("pattern", "word").agg(F.min("kind").alias("kind"))
    edges = read_back(spark, edges, "graph")
    known = read_back(spark, edges.where("kind <> 'word'").select("word", F.col("kind").alias("as")).distinct(), "known")
    accepted = None
    for _ in range(ROUNDS):
        score = edges.join(known, "word", "left").groupBy("pattern", "as").agg(F.count_distinct("word").alias("n"))
        best = score.groupBy("pattern").agg(
            F.sum("n").alias("all"), F.max(F.when(F.col("as").isNotNull(), F.struct("n", "as"))).alias("top")
        ).where((F.col("top.n") >= SUPPORT) & (F.col("top.n") >= CONFIDENCE * F.col("all"))).select("pattern", F.col("top.as").alias("as"))
        accepted = read_back(spark, best, "patterns")
        grown = edges.where("kind = 'word'").join(accepted, "pattern").groupBy("word").agg(F.min("as").alias("as"))
        merged = read_back(spark, known.unionByName(grown).distinct(), "known")
        if merged.count() == known.count():
            break
        known = merged
    words = found.select("id", "print", F.explode("words").alias("o")).select("id", "print", "o.*")
    hits = words.withColumn("pattern", F.explode(patterns)).join(accepted, "pattern").groupBy("id", "print", "start", "stop").agg(F.min("as").alias("kind"))
    added = hits.groupBy("id", "print").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))
    added = read_back(spark, added.select(F.col("id").alias("i"), F.col("print").alias("p"), "added"), "added")

    rows = found.select("id", "print", F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("seeds"))
    joined = rows.join(added, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")), "left")
    more = F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))
    ordered = F.concat(*[F.sort_array(_of_kind(F.concat("seeds", more), k)) for k in KINDS])
    counts = [F.size(_of_kind(F.col("seeds"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select(F.col("id").alias(id_col), *counts, F.sha2(_rendered(F.col("seeds")), 256).alias("base_sha256"), _rendered(ordered).alias("spans"))
