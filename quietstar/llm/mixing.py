"""Mixing sources to target weights: temperature, then budgeted block permutations.

*Weights.* A source's share of tokens is raised to an exponent between 0 and 1 and normalised: 1 keeps the shares, 0 makes
sources equal. Repetitions (a source's weight times the budget, by its tokens) and the mixture's entropy both fall steadily as
the exponent rises, so the exponent that just meets the repetition limit, or the target entropy, is bisected. One job
evaluates ``2^LEVELS - 1`` exponents between the bounds, which is as good as ``LEVELS`` bisections; only these sums reach the
driver, not the sources.

*Realisation.* Documents fall into ``2^BLOCK_BITS`` blocks of their source by a digest of their id. For each pass over a source
the blocks are permuted by a digest; whole blocks are taken while they fit the source's budget. Of the block that doesn't fit
whole, documents are taken in digest order while they fit; what is too long is skipped, and the shortest of the rest fill the room
that is left. A source with a budget of which no document with tokens fits gets its first one, so it is never missing. Token sums
by (source, block) are combined on the map side, so a source with a third of all rows is as many small rows as any other; no
window holds more than a source's blocks or one block's documents by their digests. A copy's ``stream_block`` is its place in the
mixture: each of the ``STREAM_BLOCKS`` blocks holds every source in proportion to its weight.

Defined results: a null source is a source of its own; null or wordless texts have no tokens and are taken with their block; a
source without tokens is not drawn; rows repeated with one id share their digest and are taken or left together; an empty
table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C

REPETITIONS = 1.25
LEVELS = 10
ROUNDS = 3
BLOCK_BITS = 10
STREAM_BLOCKS = 64
TOKEN = r"[^\x20\x09-\x0D]+"
OUT = ("epoch", "stream_block", "mix_key", "n_tokens")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source``, ``tokens`` of every source."""
    rows = docs.select(F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("t"))
    return rows.groupBy("source").agg(F.sum("t").alias("tokens"))


def _measures(sources: DataFrame, low: float, high: float, budget: float) -> list:
    """For ``2^LEVELS + 1`` exponents from ``low`` to ``high``: the largest repetition and the entropy of the mixture."""
    steps = 1 << LEVELS
    total = float(sources.agg(F.sum("tokens")).first()[0] or 0)
    grid = sources.where("tokens > 0").select(
        "tokens", F.log(F.col("tokens") / total).alias("l"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("j")
    ).withColumn("x", F.lit(low) + F.col("j") * ((high - low) / steps))
    power = F.exp(F.col("x") * F.col("l"))
    sums = grid.groupBy("j").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("x") * F.col("l")).alias("zl"), F.max(power / F.col("tokens")).alias("rate"), F.max("x").alias("x")
    )
    return sums.select("j", "x", (budget * F.col("rate") / F.col("z")).alias("repetition"), (F.log("z") - F.col("zl") / F.col("z")).alias("entropy")).orderBy("j").collect()


def find_exponent(sources: DataFrame, budget: float, repetitions: float | None = REPETITIONS, entropy: float | None = None) -> float:
    """The smallest exponent (most even mixture) within the repetition limit, or the largest whose entropy reaches the target.

    ``sources``: ``source``, ``tokens``. Where no exponent meets the condition, 1 for a limit and 0 for an entropy.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        rows = _measures(sources, low, high, budget)
        if not rows:
            return 1.0
        if entropy is not None:
            fits = [r["j"] for r in rows if r["entropy"] >= entropy - 1e-12]
            edge = max(fits) if fits else 0
            low, high = rows[edge]["x"], rows[min(edge + 1, len(rows) - 1)]["x"]
            found = low
        else:
            fits = [r["j"] for r in rows if r["repetition"] <= repetitions + 1e-12]
            edge = min(fits) if fits else len(rows) - 1
            low, high = rows[max(edge - 1, 0)]["x"], rows[edge]["x"]
            found = high
        if low == high:
            break
    return found


def mixture_weights(sources: DataFrame, exponent: float, budget: float) -> DataFrame:
    """``source``, ``tokens``, ``weight``, ``take`` (whole tokens of the budget) of each source with tokens."""
    drawn = sources.where("tokens > 0")
    power = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    total = float(drawn.agg(F.sum(power)).first()[0] or 0)
    out = drawn.withColumn("weight", power / total)
    return out.select("source", "tokens", "weight", F.floor(F.col("weight") * budget + 0.5).cast("long").alias("take"))


def _key(*parts: Column) -> Column:
    """60 bits of a digest."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, budget: float | None = None, repetitions: float | None = REPETITIONS, entropy: float | None = None, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The mixture: a row per taken copy with the columns of ``docs`` (or those in ``keep``), ``epoch``, ``stream_block``,
    ``mix_key`` (order within a stream block) and ``n_tokens``. Columns of ``docs`` with these names give way.

    ``budget``: tokens of the mixture, by default those of ``docs``.
    """
    spark = docs.sparkSession
    named = [c for c in (keep or docs.columns) if c.lower() not in OUT]
    digest = _key(F.lit(seed), F.col("id"))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("t"))
    narrow = narrow.select("source", "t", digest.alias("key"))
    narrow = read_back(spark, narrow.withColumn("block", F.shiftright("key", 60 - BLOCK_BITS)), "tokens")
    blocks = read_back(spark, narrow.groupBy("source", "block").agg(F.sum("t").alias("t")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("t").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    exponent = find_exponent(sources, budget, repetitions, entropy)
    weights = mixture_weights(sources, exponent, budget).select(F.col("source").alias("s"), "tokens", "take")

    # Each pass over a source sees its blocks in another order; the last pass ends with the budget.
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("take") / F.col("tokens")).cast("int") - 1))
    planned = weights.where("take > 0").select("s", "tokens", "take", passes.alias("epoch"))
    planned = blocks.join(planned, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = W.partitionBy("source", "epoch").orderBy(_key(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block")), "block").rowsBetween(W.unboundedPreceding, -1)
    planned = planned.withColumn("before", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("t").over(order), F.lit(0)))
    planned = planned.where("before < take").withColumn("room", F.col("take") - F.col("before"))
    planned = read_back(spark, planned.select("source", "block", "epoch", "before", "take", "t", "room"), "planned")

    # One block of a source at most fits in part.
    part = planned.where("t > room").select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "room", "before", "take")
    at_part = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    inside = narrow.join(part, at_part).groupBy("source", "block", "epoch", "room", "before", "take", "key").agg(F.sum("t").alias("t"))
    chosen = read_back(spark, _fitting(inside).withColumn("stream_block", _stream_block()), "chosen")
    chosen = chosen.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("key").alias("k"), "epoch", "stream_block")
    whole = planned.where("t <= room").select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", _stream_block().alias("stream_block"))
    whole = read_back(spark, whole, "plan")

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in named]).alias(C.ROW), F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("n_tokens"),
    ).withColumn("key", digest)
    rows = rows.withColumn("block", F.shiftright("key", 60 - BLOCK_BITS))
    taken = rows.join(whole, at_part).unionByName(rows.join(chosen, at_part & (F.col("key") == F.col("k"))).drop("k"))
    taken = taken.withColumn("mix_key", _key(F.lit(seed), F.col("epoch"), F.col("id")))
    return taken.select(f"{C.ROW}.*", "epoch", "stream_block", "mix_key", "n_tokens")


def _stream_block() -> Column:
    return F.least(F.floor(F.col("before") * STREAM_BLOCKS / F.col("take")), F.lit(STREAM_BLOCKS - 1)).cast("int")


def _fitting(inside: DataFrame) -> DataFrame:
    """The documents of blocks that fit in part (a row per digest) that are taken."""
    block = W.partitionBy("source", "block", "epoch")
    upto = F.sum("t").over(block.orderBy("key"))
    rows = inside.withColumn("upto", upto).withColumn("first", F.col("upto") <= F.col("room"))
    rows = rows.withColumn("left", F.col("room") - F.coalesce(F.max(F.when(F.col("first"), F.col("upto"))).over(block), F.lit(0)))
    rows = rows.withColumn("rest", ~F.col("first") & (F.col("t") <= F.col("left")))
    short = block.orderBy(F.desc("rest"), "t", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("fill", F.sum(F.when(F.col("rest"), F.col("t")).otherwise(0)).over(short))
    rows = rows.withColumn("taken", F.col("first") | (F.col("rest") & (F.col("fill") <= F.col("left"))))
    # Nothing of the source stands before this block, and nothing with tokens fits.
    rows = rows.withColumn("none", (F.col("before") == 0) & (F.coalesce(F.max(F.when(F.col("taken"), F.col("t"))).over(block), F.lit(0)) == 0))
    lead = F.row_number().over(block.orderBy(F.desc(F.col("t") > 0), "key"))
    return rows.withColumn("lead", lead).where("taken OR (none AND lead = 1)").select("source", "block", "epoch", "key", "before", "take")
