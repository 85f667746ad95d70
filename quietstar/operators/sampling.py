"""Reproducible samples: order by a digest of the row id and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from . import ranking


def sample_n(df: DataFrame, n: int, seed: int | str = 42, key: str = "review_id") -> DataFrame:
    return df.orderBy(maths.seeded_key(F.col(key), seed), F.asc(key)).limit(n)


def stratified_sample(
    df: DataFrame, limit: int, by: str = "star_rating", seed: int | str = 42, key: str = "review_id"
) -> DataFrame:
    """``floor(limit * n_s / N)`` rows of each stratum, at most the rows it has."""
    total = ranking.one_value(df.filter(F.col(by).isNotNull()).agg(F.count(F.lit(1)).alias("n")), "n")
    share = F.floor(F.lit(limit) * F.col("group_size") / total)
    quota = F.least(F.col("group_size"), share.cast("bigint"))
    digest = maths.seeded_key(F.col(key), seed)
    return ranking.digest_positions(df, [by], digest, key, quota).drop("position", "group_size")


def pooled(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def dedup(df: DataFrame, keys: Sequence[str] = ("review_id",)) -> DataFrame:
    """One row per key. Copies collapse in each task before the shuffle."""
    return df.dropDuplicates(list(keys))
