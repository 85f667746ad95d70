"""Line de-duplication: every run of two lines or more that stands at an earlier place is cut.

A run repeats where each two adjacent lines in it repeat, so all pairs of adjacent lines are grouped by the SHA-256 digest of
both lines' digests. Of a repeated pair the first place (smallest id, then smallest digest of the text, then smallest line)
stays; both lines of its other places go. Boundaries set by content would miss short runs in new surroundings, so there are
none. No line is lost: the first place of a line can't belong to a pair that has an earlier place.

Group sums are combined on the map side, so a pair that a third of all rows hold reaches a reducer as a row per task. Lines
cross the network as digests; only the bytes of repeated pairs are sent, and compared, once for each task. Pairs that agree in
their digest but not in their bytes stop the job.

Defined results: a null text stays null, an empty one empty; a document whose every line goes becomes empty; texts are cut at
line feeds only; blank lines are lines; a line that repeats alone stays; of lines repeated in a row within one text the first
stays; rows repeated with id and text are cut alike, rows that share only the id (or have none) each by themselves; rows without
an id keep nothing that a row with one has; an empty table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C

#: Repeated pairs up to here (some 50 MB) are broadcast to the texts, more are joined by shuffle.
BROADCAST_PAIRS = 250_000
#: Cut lines and documents with any up to here (some 16 MB) are broadcast to the texts, more are joined by shuffle.
BROADCAST_LINES = 1_000_000


def line_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bodies: bool = False) -> DataFrame:
    """``id``, ``own`` (digest of the text), ``at`` (place of the first line, from 0), ``pair`` for each two adjacent lines.

    ``bodies``: only ``pair`` and ``body``, the lines themselves.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.split(F.col(text_col), "\n", -1).alias("lines")).where("size(lines) > 1")
    rows = rows.select("id", F.unhex(F.md5("text")).alias("own"), "lines", F.transform("lines", lambda x: F.sha2(x, 256)).alias("digests"))
    n = F.size("digests") - 1
    pairs = F.zip_with(F.slice("digests", 1, n), F.slice("digests", 2, n), lambda x, y: F.unhex(F.sha2(F.concat(x, y), 256)))
    if not bodies:
        return rows.select("id", "own", F.posexplode(pairs).alias("at", "pair"))
    both = F.zip_with(F.slice("lines", 1, n), F.slice("lines", 2, n), lambda x, y: F.concat(x, F.lit("\n"), y))
    return rows.select(F.inline(F.zip_with(pairs, both, lambda p, b: F.struct(p.alias("pair"), b.alias("body")))))


def repeated_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pair`` and ``first`` (id, own, at) of the pairs of lines that occur more than once."""
    # Nulls sort first in a struct: an id that is missing must not stay before one that is there.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own", "at")
    same = line_pairs(docs, id_col, text_col).groupBy("pair").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    return same.where("times > 1").select("pair", "first")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines cut out of the text, and ``lines_cut`` (long); a column of that name gives way."""
    spark = docs.sparkSession
    again = read_back(spark, repeated_pairs(docs, id_col, text_col), "repeated")
    few = again.count() <= BROADCAST_PAIRS
    sent = lambda df: F.broadcast(df) if few else df
    bodies = line_pairs(docs, id_col, text_col, bodies=True).join(sent(again.select("pair")), "pair", "left_semi")
    if bodies.distinct().groupBy("pair").count().where("count > 1").limit(1).count():
        raise ValueError("two pairs of lines share a digest")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("own") == F.col("first.own")) & (F.col("at") == F.col("first.at"))
    cut = line_pairs(docs, id_col, text_col).join(sent(again), "pair").where(~first)
    cut = cut.groupBy("id", "own").agg(F.array_distinct(F.flatten(F.collect_list(F.array("at", F.col("at") + 1)))).alias("gone"))
    cut = read_back(spark, cut.select(F.col("id").alias("cut_id"), F.col("own").alias("cut_own"), F.size("gone").cast("long").alias("lines_cut"), "gone"), "cut")
    named = [c for c in docs.columns if c.lower() != "lines_cut"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in named]).alias(C.ROW), F.col(id_col).alias("own_id"), F.unhex(F.md5(text_col)).alias("own"), F.col(text_col).alias("body")
    )
    held = cut.agg(F.coalesce(F.sum("lines_cut"), F.lit(0)) + F.count(F.lit(1))).first()[0]
    same = F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own") == F.col("cut_own"))
    joined = rows.join(F.broadcast(cut) if held <= BROADCAST_LINES else cut, same, "left")
    lines = F.split("body", "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(f"{C.ROW}.`{c}`").alias(c) for c in named]
    return joined.select(*out, F.coalesce("lines_cut", F.lit(0)).cast("long").alias("lines_cut"))
