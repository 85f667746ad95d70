"""The trie of conversation prefixes, by composable fingerprints.

The fingerprint of a sequence of turns is an element of a monoid: its length and, in each of ``LANES`` fields of ``P`` numbers,
the sum of ``turn * B^place``. Two elements combine without their texts: lengths add, the second's sum is moved by ``B^length``
of the first. A conversation ``c`` is rebuilt from the head of its base and from its own turns after that many, so the
fingerprint of each of its prefixes is the base's head combined with a stretch of its own running products, the difference of
two of them moved to its place. No rebuilt text is ever made: rebuilt turns are references (conversation, place) with the
fingerprint before and after them.

Prefixes with one depth and fingerprint are a node. That they are equal is verified by induction: all members of a node have
the same stored turn last and the same fingerprint before it, and turns that share a digest are compared as texts. A difference
stops the job.

Rows are put in order by range, so that one conversation may fill many partitions; running products are made inside a partition
and combined over a conversation's runs. Sums over subtrees are gathered by doubling: after ``k`` rounds a node knows the nodes
fewer than ``2^k`` levels below it, and hands its sum to the ancestor that far up, which is a prefix of the same conversation
and so is found under a key that is never hot. The ids that end at a node are joined to strings by ranges of ids, then hashed
as a stream, so a node where a third of all conversations end is never held in memory.

Defined results: rows without a conversation id belong to none and are left out; null roles and texts are empty; a null turn
comes first; equal turns are ordered by role, then text, and repeated rows are turns of their own; the root stands for all
conversations, also those without a rebuilt turn; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C

#: A prime of which products fit 64 bits, and the bases of the lanes.
P = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525, 747_796_405, 48_271)
LANES = len(BASES)
#: Turns at most that a conversation takes from its base, and the step from one base to the next.
HEAD = 8
STEP = 5
#: Ids in one string of a node's ends.
JOINED = 4096
#: A key with over one in so many rows is looked up in a broadcast table, which has no more rows than this.
SHARES = 1000


def head_length(conv: Column) -> Column:
    """Turns that a conversation takes from its base: 0 to ``HEAD``."""
    return F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo ``P``."""
    out, square, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64).copy()
    while left.any():
        odd = (left & np.uint64(1)) > 0
        out[odd] = out[odd] * np.uint64(square) % np.uint64(P)
        square = square * square % P
        left >>= np.uint64(1)
    return out


# running products ---------------------------------------------------------------------------

_IN = [f"in{i}" for i in range(LANES)]
_OUT = [f"out{i}" for i in range(LANES)]
_RUN = "conv long, part int, at long, turn1 long, turn2 long, bytes long, " + ", ".join(f"{c} long" for c in _IN + _OUT)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and products before (``in``) and after (``out``) each turn of a partition sorted by conversation and turn."""
    last, count, sums = None, 0, np.zeros(LANES, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, turn1, turn2 = (batch.column(c).to_numpy() for c in ("conv", "turn1", "turn2"))
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = conv[0] != last
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        at = np.arange(len(conv)) - start
        at[start < 0] += count - 1
        lanes = []
        for i, base in enumerate(BASES):
            digest = (turn1 if i % 2 else turn2).view(np.uint64) >> np.uint64(32 * (i // 2)) & np.uint64(0xFFFFFFFF)
            term = (digest % np.uint64(P)) * power(base, at) % np.uint64(P)
            # Sums of 2^32 terms fit 64 bits; what stood before a conversation is taken off.
            total = np.cumsum(term, dtype=np.uint64)
            off = np.where(start >= 0, (total - term)[np.maximum(start, 0)], np.uint64(0))
            after = (total - off + np.where(start < 0, sums[i], np.uint64(0))) % np.uint64(P)
            before = (after + np.uint64(P) - term) % np.uint64(P)
            lanes.append((before.astype(np.int64), after.astype(np.int64)))
        last, count = conv[-1], int(at[-1]) + 1
        sums = np.array([after[-1] for _, after in lanes], np.uint64)
        cols = [batch.column(c) for c in ("conv", "part")] + [pa.array(at)] + [batch.column(c) for c in ("turn1", "turn2", "bytes")]
        cols += [pa.array(b) for b, _ in lanes] + [pa.array(a) for _, a in lanes]
        yield pa.RecordBatch.from_arrays(cols, ["conv", "part", "at", "turn1", "turn2", "bytes", *_IN, *_OUT])


def _powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        moved = [pa.array(power(b, batch.column("offset").to_numpy()).astype(np.int64)) for b in BASES]
        yield pa.RecordBatch.from_arrays([*batch.columns, *moved], [*batch.schema.names, *[f"move{i}" for i in range(LANES)]])


def _mod(value: Column) -> Column:
    return F.pmod(value, F.lit(P))


def _verify_turns(turns: DataFrame) -> None:
    """Turns that share a digest have one role and one text."""
    same = turns.groupBy("turn1", "turn2").agg(*[f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("low", F.min), ("high", F.max))])
    if same.where("low_role <> high_role OR low_text <> high_text").limit(1).count():
        raise ValueError("two turns share a digest")


def stored_turns(spark: SparkSession, convs: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The turns with their places and products from the start of their conversation, and a row for each conversation.

    ``turns``: ``conv``, ``part`` (a run of the conversation), ``place`` (from 1), digests, ``bytes``, products.
    """
    empty = F.lit("")
    rows = convs.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text).cast("string"), empty).alias("text"),
    ).where("conv IS NOT NULL")
    digests = [F.xxhash64(F.lit(i), "role", "text").alias(f"turn{i}") for i in (1, 2)]
    _verify_turns(rows.select("role", "text", *digests))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(parts, *order[:3], F.substring("text", 1, 64)).sortWithinPartitions(*order)
    ranged = ranged.select("conv", F.spark_partition_id().alias("part"), *digests, F.octet_length("text").cast("long").alias("bytes"))
    local = read_back(spark, ranged.mapInArrow(_runs, _RUN), "runs")
    # A run is the part of a conversation in one partition.
    runs = local.groupBy("conv", "part").agg(F.max("at").alias("last"), *[F.max_by(c, "at").alias(c) for c in _OUT])
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("n", F.col("last") + 1).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    names = ["conv", "part", "n", "offset", *_OUT]
    kinds = "conv long, part int, n long, offset long, " + ", ".join(f"{c} long" for c in [*_OUT, *[f"move{i}" for i in range(LANES)]])
    runs = runs.select(*names).mapInArrow(_powers, kinds)
    prior = [_mod(F.coalesce(F.sum(_mod(F.col(f"move{i}") * F.col(f"out{i}"))).over(earlier), F.lit(0))).alias(f"prior{i}") for i in range(LANES)]
    runs = read_back(spark, runs.select("conv", "part", "n", "offset", *[f"move{i}" for i in range(LANES)], *prior), "moves")
    whole = lambda c, i: _mod(F.col(f"prior{i}") + _mod(F.col(f"move{i}") * F.col(c))).alias(c)
    moved = [whole(c, i) for i in range(LANES) for c in (f"in{i}", f"out{i}")]
    turns = local.join(runs, ["conv", "part"]).select("conv", "part", (F.col("offset") + F.col("at") + 1).alias("place"), "turn1", "turn2", "bytes", *moved)
    return read_back(spark, turns, "turns"), runs.groupBy("conv").agg(F.sum("n").alias("n"))


# rebuilt conversations ----------------------------------------------------------------------


def _pack(*lanes: Column) -> list[Column]:
    """Lanes two by two as one number."""
    return [(lanes[i] * F.lit(1 << 31) + lanes[i + 1]) for i in range(0, LANES, 2)]


def rebuilt_prefixes(spark: SparkSession, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: ``conv``, ``depth``, ``length`` (of the conversation), ``f1``, ``f2``
    (fingerprint), ``p1``, ``p2`` (that of the prefix before), and the digests and ``bytes`` of the last turn."""
    first = read_back(spark, turns.where(F.col("place") <= HEAD), "first")
    facts = convs.select("conv", "n", (F.col("conv") - F.col("conv") % STEP).alias("base"), head_length(F.col("conv")).alias("asked"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    facts = facts.join(bases, "base", "left").withColumn("head", F.least("asked", F.coalesce("base_n", F.lit(0))))
    facts = facts.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("asked"), F.lit(0)))
    # Products of the base's head and of the own turns that it replaces.
    of = lambda name, key, place: first.select(F.col("conv").alias(key), F.col("place").alias(place), *[F.col(f"out{i}").alias(f"{name}{i}") for i in range(LANES)])
    facts = facts.withColumn("own", F.least("asked", "n")).join(of("head_out", "base", "head"), ["base", "head"], "left")
    facts = facts.join(of("own_out", "conv", "own"), ["conv", "own"], "left").na.fill(0, [f"{x}_out{i}" for x in ("head", "own") for i in range(LANES)])
    facts = read_back(spark, facts, "facts")
    roots = facts.select("conv", F.lit(0).cast("long").alias("depth"), "length", *[F.lit(0).cast("long").alias(c) for c in ("f1", "f2", "p1", "p2", "turn1", "turn2", "bytes")])
    of_base = first.withColumnRenamed("conv", "base").join(facts.select("conv", "base", "head", "length"), "base").where("place <= head")
    keys = lambda side: _pack(*[F.col(f"{side}{i}") for i in range(LANES)])
    named = lambda after, before: [c.alias(n) for c, n in zip([*after, *before], ("f1", "f2", "p1", "p2"), strict=True)]
    heads = of_base.select("conv", F.col("place").alias("depth"), "length", *named(keys("out"), keys("in")), "turn1", "turn2", "bytes")
    # Facts go by run, so that a conversation of very many turns joins in as many pieces.
    by_run = turns.groupBy("conv", "part").agg(F.max("place").alias("to")).join(facts, "conv").where("to > asked").drop("to")
    rows = turns.join(by_run.drop("n", "base", "own", "base_n"), ["conv", "part"]).where("place > asked")
    back = [F.array(*[F.lit(pow(pow(b, s, P), -1, P)) for s in range(HEAD + 1)]) for b in BASES]
    short = (F.col("asked") - F.col("head")).cast("int")
    moved = lambda c, i: _mod(F.col(f"head_out{i}") + _mod(_mod(F.col(f"{c}{i}") - F.col(f"own_out{i}")) * F.get(back[i], short)))
    after, before = (_pack(*[moved(c, i) for i in range(LANES)]) for c in ("out", "in"))
    depth = F.col("head") + F.col("place") - F.col("asked")
    owns = rows.select("conv", depth.alias("depth"), "length", *named(after, before), "turn1", "turn2", "bytes")
    return read_back(spark, roots.unionByName(heads).unionByName(owns), "prefixes")


# the trie -----------------------------------------------------------------------------------

KEY = ["depth", "f1", "f2"]


def trie_nodes(spark: SparkSession, prefixes: DataFrame) -> DataFrame:
    """The nodes, verified: key, ``conv`` (smallest member), ``n_convs``, ``bytes`` of the last turn, ``p1``, ``p2``."""
    same = ("turn1", "turn2", "p1", "p2", "bytes")
    nodes = prefixes.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_high") for c in same]
    )
    differ = " OR ".join(f"{c} <> {c}_high" for c in same)
    checked = F.when(F.expr(differ), F.raise_error(F.lit("two sequences share a fingerprint")).cast("long")).otherwise(F.col("conv"))
    return read_back(spark, nodes.withColumn("conv", checked).drop("turn1", "turn2", *[f"{c}_high" for c in same]), "nodes")


def subtree_sums(spark: SparkSession, nodes: DataFrame, prefixes: DataFrame, sums: list[str]) -> DataFrame:
    """``sums`` of each node added up over its subtree, by doubling."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out, far = nodes.select(*KEY, "conv", *sums), 1
    while far <= deepest:
        above = prefixes.where(F.col("length") >= far).select("conv", (F.col("depth") + far).alias("depth"), F.col("f1").alias("a1"), F.col("f2").alias("a2"))
        up = out.where(F.col("depth") >= far).join(above, ["conv", "depth"])
        up = up.select((F.col("depth") - far).alias("depth"), F.col("a1").alias("f1"), F.col("a2").alias("f2"), F.lit(None).cast("long").alias("conv"), *sums)
        out = out.unionByName(up).groupBy(*KEY).agg(F.max("conv").alias("conv"), *[F.sum(c).alias(c) for c in sums])
        out, far = read_back(spark, out, "sums"), far * 2
    return out.drop("conv")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a partition sorted by node and id, as strings of at most ``JOINED`` of one node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in [*KEY, "conv"]]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])
        starts = sorted({*np.flatnonzero(new).tolist(), *range(0, batch.num_rows, JOINED)})
        texts = [",".join(map(str, cols[-1][s:e].tolist())) for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in cols], pa.array(texts, pa.string())], [*KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each node in a partition sorted by node and first id."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    node, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in [*KEY, "ids"]], strict=True):
            if key != node:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [*KEY, "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*node, state.hexdigest()), kinds, strict=True)], [*KEY, "ends"])


def end_hashes(spark: SparkSession, prefixes: DataFrame) -> DataFrame:
    """For each node where conversations end the hash of their ids in ascending order."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = prefixes.where("depth = length").select(*KEY, "conv").repartitionByRange(parts, "conv").sortWithinPartitions(*KEY, "conv")
    with C.small_batches(spark, JOINED):
        strings = read_back(spark, ends.mapInArrow(_joined, "depth long, f1 long, f2 long, first long, ids string"), "ends")
    with C.small_batches(spark, 256):
        by_node = strings.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first")
        return read_back(spark, by_node.mapInArrow(_hashed, "depth long, f1 long, f2 long, ends string"), "hashes")


def prefix_trie(
    convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes
    of last turns that the members after the first share, over the subtree), ``ends_sha256``.
    """
    spark = convs.sparkSession
    turns, lengths = stored_turns(spark, convs, conv_col, turn_col, role_col, text_col)
    prefixes = rebuilt_prefixes(spark, turns, lengths)
    nodes = trie_nodes(spark, prefixes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = read_back(spark, nodes, "counted")
    sums = subtree_sums(spark, nodes, prefixes, ["n_leaves", "saved_tokens"])
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums, KEY).join(end_hashes(spark, prefixes), KEY, "left")
    nodes = read_back(spark, nodes, "summed")
    # A parent with very many children is broadcast; there are at most SHARES of them.
    total = nodes.count()
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent"), "n_children")
    busy = F.col("n_children") > total // SHARES
    up = ["depth", "p1", "p2"]
    hot = nodes.join(F.broadcast(parents.where(busy).select(*up, F.col("parent").alias("hot"))), up, "left")
    cold = parents.where(~busy).select(*up, F.col("parent").alias("cold"))
    # Children of the broadcast parents meet nothing, so they are spread over keys of their own.
    spread = F.when(F.col("hot").isNull(), F.col("p2")).otherwise(F.xxhash64("conv", "depth"))
    rows = hot.withColumn("own_depth", F.col("depth")).withColumn("p2", spread).join(cold, up, "left")
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("own_depth").alias("depth"), F.when(F.col("own_depth") > 0, F.coalesce("hot", "cold")).alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
