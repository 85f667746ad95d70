"""Exact order statistics, ranks and top-k that hold up under one very large group.

A plain ``percentile`` or window over a hot key puts that key's rows in one task. Here rows are first
counted per distinct value (combined map-side), the distinct values are split into bins by a monotone
rule, and only bin totals are ever ordered per key. Every step is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS_PER_UNIT = 65536


def value_bin(value: Column) -> Column:
    """Monotone integer bin: about 45,000 of them across [0, 1], logarithmic beyond.

    Never null, so a join on it infers no filter that would keep Spark from reusing one exchange for
    both of its sides.
    """
    return F.coalesce(F.floor(F.signum(value) * F.log1p(F.abs(value)) * BINS_PER_UNIT), F.lit(0))


def _value_counts(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], weight: str | None = None
) -> DataFrame:
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    extra = [F.sum(c).alias(name) for name, c in sums.items()]
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(rows.alias("_n"), *extra)
        .withColumn("_bin", value_bin(F.col("_v")))
    )


def _bin_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_key = W.partitionBy(*[F.col(k) for k in keys]) if keys else W.partitionBy(F.lit(0))
    earlier = per_key.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bin_n"))
        .withColumn("_bin_before", F.coalesce(F.sum("_bin_n").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_bin_n").over(per_key))
    )


def _with_rank(counts: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    inside = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    return counts.join(bins, [*keys, "_bin"]).withColumn(
        "_before", F.col("_bin_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )


def distinct_value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, distinct value) with ``n``, ``n_before``, ``total`` and the requested sums."""
    sums = sums or {}
    counts = _value_counts(df, keys, value, sums)
    return _with_rank(counts, _bin_totals(counts, keys), keys).select(
        *keys,
        F.col("_v").alias(value),
        F.col("_n").alias("n"),
        F.col("_before").alias("n_before"),
        F.col("_total").alias("total"),
        *sums.keys(),
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated percentiles per key, plus ``n_rows``; one output row per key.

    Bins that hold none of the wanted ranks drop out before the values are ordered. ``weight`` names a
    count column when the rows are already counted.
    """
    counts = _value_counts(df, keys, value, {}, weight)
    bins = _bin_totals(counts, keys)
    spans = {name: F.lit(p) * (F.col("_total") - 1) for name, p in percentiles.items()}
    wanted = F.lit(False)
    for position in spans.values():
        wanted = wanted | (
            (F.col("_bin_before") <= F.ceil(position)) & (F.col("_bin_before") + F.col("_bin_n") > F.floor(position))
        )
    ranked = _with_rank(counts, bins.filter(wanted), keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))

    aggregates, outputs = [], []
    for name, position in spans.items():
        aggregates += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_frac_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"_frac_{name}")).alias(name))
    return (
        ranked.groupBy(*keys)
        .agg(F.max("_total").alias("n_rows"), *aggregates)
        .select(*keys, "n_rows", *outputs)
    )


def auroc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null when a class is absent."""
    positive = (F.col(label).cast("int") == 1).cast("bigint")
    ranks = distinct_value_ranks(df.filter(F.col(label).isNotNull()), keys, score, {"pos": positive})
    average_rank = F.col("n_before") + (F.col("n") + 1) / 2
    n_pos, n_all = F.col("n_pos").cast("double"), F.col("n_rows").cast("double")
    u = F.col("rank_sum") - n_pos * (n_pos + 1) / 2
    return (
        ranks.groupBy(*keys)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("n").alias("n_rows"),
            F.sum(F.col("pos") * average_rank).alias("rank_sum"),
        )
        .select(*keys, "n_rows", "n_pos", F.try_divide(u, n_pos * (n_all - n_pos)).alias("auroc"))
    )


SALTS = 1024


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= n)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_no",
    spread_by: Column | None = None,
) -> DataFrame:
    """First ``n`` rows of every group with their rank.

    Up to 1,000 Spark prunes each input partition to ``n`` rows per group before the shuffle; more go two levels. Where
    the input is raw rows, pass ``spread_by`` (a row id): the survivors of all partitions are then
    pruned again over many salts, so a hot group's final task sees ``n`` rows per salt and not per
    input partition. Exact either way.
    """
    if n > 1000:
        return first_per_group(df, keys, order, n, n, F.xxhash64(*df.columns) if spread_by is None else spread_by, rank)
    if spread_by is None:
        return _ranked(df, keys, order, n, rank)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    return _ranked(_ranked(salted, [*keys, "_salt"], order, n, rank).drop("_salt", rank), keys, order, n, rank)


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: Column | int, limit: int,
    spread_by: Column, rank: str = "rank_no",
) -> DataFrame:
    """First ``n`` rows of every group when ``n`` is large or varies by group (never above ``limit``).

    Two levels: every group is split over many tasks that each keep ``limit`` rows, then the survivors
    are ranked. Exact, because a row among the first ``n`` of its group is among the first ``n`` of
    its salt.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    kept = _ranked(salted, [*keys, "_salt"], order, limit, rank).drop("_salt", rank)
    return _ranked(kept, keys, order, limit, rank).filter(F.col(rank) <= n)


def digest_positions(
    df: DataFrame, keys: Sequence[str], digest: Column, row_id: str, quota: Column | None = None
) -> DataFrame:
    """``position`` (1-based) and ``group_size`` of every row in its group, in digest order.

    A group may hold nearly all rows, so it is never ordered in one task: rows are counted per digest
    prefix, prefixes get offsets, and rows are ranked inside their prefix. With ``quota`` (an
    expression over ``group_size``) only rows up to it are kept, and prefixes beyond it drop out
    before any row is shuffled to be ranked.
    """
    placed = df.withColumn("_digest", digest).withColumn(
        "_prefix", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("bigint")
    )
    per_group = W.partitionBy(*keys)
    earlier = per_group.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_prefix")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
        .withColumn("group_size", F.sum("_m").over(per_group))
        .drop("_m")
    )
    if quota is not None:
        offsets = offsets.withColumn("_quota", quota).filter(F.col("_before") < F.col("_quota"))
    inside = W.partitionBy(*keys, "_prefix").orderBy("_digest", row_id)
    out = placed.join(offsets, [*keys, "_prefix"]).withColumn("position", F.col("_before") + F.row_number().over(inside))
    if quota is not None:
        out = out.filter(F.col("position") <= F.col("_quota")).drop("_quota")
    return out.drop("_digest", "_prefix", "_before")


def one_value(df: DataFrame, column: str) -> Column:
    """A one-row, one-column result as a scalar subquery: no join, no collect."""
    return df.select(column).scalar()
