"""N-gram Jaccard join: an R-tree over count vectors of hashed token groups bounds overlaps, surviving pairs are verified.

Tokens are 5-word shingles. Three kinds of groups are used, all by the token's hash:

* 2^20 *frequency groups*: every document adds to a table of fixed size, which orders tokens from rare to common;
* *cells*: two sets with a similarity of 0.8 or more share one of the first ``n - ceil(0.8 n) + 1`` tokens in that order, so
  the documents with a token among their first form a cell, and linked documents meet in a cell (no link is lost);
* 128 *coordinates*: the counts of a set's tokens by coordinate are its point. The sum of the coordinate minima of two points
  is at least their overlap. A cell's points stand in an R-tree whose nodes keep coordinate maxima; a branch is left when its
  bound is under the overlap that 0.8 needs. Surviving pairs are bounded again by points of as many coordinates as their sets
  ask for, and then verified with the whole sets.

The cells alone would leave all pairs of a large family of copies. So a first round links each cell's members to one of them
(combined on the map side: a token that a third of all rows hold reaches a reducer once per task), verifies these stars and
takes components; up to two more turns do so around other members, while the cells that are left are so large that a member
would meet more than ``MEETINGS`` others on average. Only cells with a link that failed are then searched by R-tree, and
only for pairs between components. Cells above ``BLOCK`` members are dealt in blocks, each pair of blocks a task of its own. No pair is dropped, none is capped.

Equal sets are one class (128-bit digest of the set), and classes, not rows, meet. Texts cross the network only for members of
cells, as sets of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C
from .components import components
from .shingles import set_digest, shingle_set

#: Frequency groups; a fixed size, so the table can go to every task.
FREQUENCY_BITS = 20
CHUNK = 4096
COORDINATES = 128
#: Members of a cell that one task indexes at once.
BLOCK = 2048
FANOUT = 16
#: Further stars around other members, before the search, at most.
STAR_TURNS = 2
#: Pairs in open cells, for each of their members, up to which the cells are searched without a further star.
MEETINGS = 128
#: Smallest cell tokens of a class that tell whether a pair meets earlier.
EARLY = 16
#: Postings that a map task combines at once.
BUFFER = 250_000
#: Candidate ids up to here (8 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A link: NUM * union <= DEN * intersection.
NUM, DEN = 4, 5

_COUNTED = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("own", pa.binary()), ("cls", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Smallest overlap with which sets of ``n`` and ``m`` tokens link: o with DEN * o >= NUM * (n + m - o)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def point(tokens: np.ndarray) -> bytes:
    """Counts by coordinate; a count over 16 bits stays at their maximum, which the bound reads as unlimited."""
    counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % COORDINATES, minlength=COORDINATES)
    return np.minimum(counts, 65535).astype(np.uint16).tobytes()


def points(column: np.ndarray) -> np.ndarray:
    out = np.ascontiguousarray(column).view(np.uint16).astype(np.int32)
    out[out == 65535] = 1 << 30
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its class and set size (kind 0), per task its counts of frequency groups in chunks (kind 1)."""
    groups = np.zeros(1 << FREQUENCY_BITS, np.int32)
    shift = np.uint64(64 - FREQUENCY_BITS)
    for batch in batches:
        cls, sizes, prints = [], [], []
        for text in batch.column(1):
            tokens = shingle_set(text.as_py())
            digest = set_digest(tokens)
            groups[(tokens >> shift).astype(np.int64)] += 1  # documents by group, so each group once
            cls.append(int.from_bytes(digest[:8], "little", signed=True))
            sizes.append(len(tokens))
            prints.append(digest)
        ids = batch.column(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(ids), np.int32)), ids, batch.column(2), pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())],
            schema=_COUNTED,
        )
    used = [i for i in range(len(groups) // CHUNK) if groups[i * CHUNK : (i + 1) * CHUNK].any()]
    if used:
        bodies = [groups[i * CHUNK : (i + 1) * CHUNK].astype(np.int64).tobytes() for i in used]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(used), np.int32)), none, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64()), none, pa.array(bodies, pa.binary())], schema=_COUNTED
        )


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cls, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(body, np.int64)
            sums[cls] = sums[cls] + part if cls in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["cls", "body"])


def _frequencies(counted: DataFrame) -> np.ndarray:
    """Documents by frequency group, over all of them: at most 2^20 numbers, whatever the input."""
    chunks, shape = counted.where("kind = 1").select("cls", "body"), "cls long, body binary"
    chunks = chunks.repartition(64, "cls", F.spark_partition_id() % 16).mapInArrow(_add_chunks, shape)
    chunks = chunks.repartition(16, "cls").mapInArrow(_add_chunks, shape)
    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for cls, body in chunks.collect():  # 256 rows of 32 KB at most
        out[cls * CHUNK : (cls + 1) * CHUNK] = np.frombuffer(body, np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def first_tokens(tokens: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """The rarest tokens, as many as a partner must share one of."""
    take = len(tokens) - (-(-NUM * len(tokens) // DEN)) + 1
    keys = frequencies[(tokens >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)
    keys |= tokens & np.uint64(0xFFFFFFFF)
    return tokens[np.argsort(keys, kind="stable")[:take]]


_STAR = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("an", pa.int64()), ("b", pa.int64()), ("bn", pa.int64())])


def _stars(token: np.ndarray, cls: np.ndarray, n: np.ndarray, single: bool) -> pa.RecordBatch:
    """From members sorted by (token, class): a row (first member, member) for each further member of a token.

    ``single``: also the first member alone (paired with itself), for the next level to combine.
    """
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    starts = np.flatnonzero(new)
    head = np.repeat(starts, np.diff(np.append(starts, len(token))))
    same = np.zeros(len(token), bool)
    same[1:] = ~new[1:] & (cls[1:] == cls[:-1]) & (n[1:] == n[:-1])
    take = ~same & (new if single else ~new) | (~same & ~new)
    return pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (token, cls[head], n[head], cls, n)], schema=_STAR)


def _map_stars(frequencies) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([x[0] for x in held]).view(np.int64)
            cls = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[0]) for x in held])
            n = np.repeat(np.array([x[2] for x in held], np.int64), [len(x[0]) for x in held])
            order = np.lexsort((n, cls, token))
            return _stars(token[order], cls[order], n[order], True)

        for batch in batches:
            for text in batch.column(1):
                tokens = shingle_set(text.as_py())
                if not len(tokens):
                    continue
                cls = int.from_bytes(set_digest(tokens)[:8], "little", signed=True)
                first = first_tokens(tokens, frequencies.value)
                held.append((first, cls, len(tokens)))
                size += len(first)
                if size >= BUFFER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _reduce_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, b, bn); tokens of one class are gone after this.

    Heads of map tasks meet here; a member that is no head keeps its own head.
    """
    for block in C.sorted_groups(batches, ["token"]):
        token, a, an, b, bn = (block[k] for k in ("token", "a", "an", "b", "bn"))
        alone = (a == b) & (an == bn)
        yield pa.RecordBatch.from_arrays([pa.array(x[~alone]) for x in (token, a, an, b, bn)], schema=_STAR)
        yield _stars(token[alone], b[alone], bn[alone], False)


def fine_point(tokens: np.ndarray) -> bytes:
    """Counts by as many coordinates as hold two tokens or fewer each, a power of two; 255 stands for any larger count."""
    width = max(COORDINATES, 1 << (len(tokens) // 2).bit_length())
    counts = np.bincount((tokens >> np.uint64(27)).astype(np.int64) & (width - 1), minlength=width)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def fine_bound(x: bytes, y: bytes) -> int:
    """Most tokens that two sets can share; the longer point is folded to the shorter one's coordinates."""
    sides = [np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y)]
    width = min(map(len, sides))
    sides = [np.where(v == 255, 1 << 40, v).reshape(-1, width).sum(0) for v in sides]
    return int(np.minimum(*sides).sum())


_SET = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("point", pa.binary()), ("fine", pa.binary()), ("tokens", pa.list_(pa.int64()))])
#: Tokens that a batch of sets holds before it is handed on.
SET_TOKENS = 250_000


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size, points and tokens, once for each class a task meets."""
    met: set[tuple[int, int]] = set()
    for batch in batches:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32)
            values = np.concatenate([r[4] for r in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            cols = [*(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3)), lists]
            return pa.RecordBatch.from_arrays(cols, schema=_SET)

        for text in batch.column(1):
            tokens = shingle_set(text.as_py())
            key = (int.from_bytes(set_digest(tokens)[:8], "little", signed=True), len(tokens))
            if key in met:
                continue
            met.add(key)
            rows.append((*key, point(tokens), fine_point(tokens), tokens))
            size += len(tokens)
            if size >= SET_TOKENS:
                yield made()
                rows, size = [], 0
        yield made()


def _as_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(2)
    rows = lists.flatten().to_numpy().reshape(len(lists), EARLY) if len(lists) else np.zeros((0, EARLY), np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["cls", "n", "early"])


_PAIR = "a long, an long, b long, bn long"


def _bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs whose summed coordinate minima reach the overlap they need."""
    n, m = batch.column(1).to_numpy(), batch.column(3).to_numpy()
    if batch.num_rows:
        x, y = (points(C.column_values(batch.column(i))) for i in (4, 5))
        keep = np.minimum(x, y).sum(1, dtype=np.int64) >= needed(n, m)
        batch = batch.filter(pa.array(keep))
    return batch.select(range(4))


def _finely_bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs that reach the overlap they need in fine coordinates too: long sets are alike in coarse ones."""
    sides = [batch.column(i).to_pylist() for i in range(1, 6) if i != 2]
    keep = [fine_bound(x, y) >= needed(n, m) for n, m, x, y in zip(*sides, strict=True)]
    return batch.filter(pa.array(keep, pa.bool_())).select(range(4))


def _tried(pairs: DataFrame, sets: DataFrame, most: int, bounded: bool = False) -> tuple[DataFrame, int]:
    """``pairs``, ``most`` of them about, with ``link``: bound by points first (unless they are ``bounded``), then by fine ones, the
    rest verified with the whole sets. Also how many are left to verify.

    Pairs that are few go to the sets by broadcast, so that only points or sets of the pairs' second members are shuffled."""
    def with_column(df: DataFrame, side: str, column: str, held: DataFrame) -> DataFrame:
        part = held.select(F.col("cls").alias(side), F.col("n").alias(f"{side}n"), F.col(column).alias(f"{side}_{column}"))
        return df.join(part, [side, f"{side}n"])

    order = ("a", "an", "b", "bn")
    near = C.in_few_tasks(pairs, most)
    if not bounded:
        pairs = read_back(sets.sparkSession, near, "pairs")
        most = pairs.count()
        by_point = with_column(with_column(C.sent(pairs, most), "a", "point", sets), "b", "point", sets).select(*order, "a_point", "b_point")
        near = C.in_few_tasks(by_point, most).mapInArrow(C.per_batch(_bounded), _PAIR)
    near = read_back(sets.sparkSession, near, "near")
    most = near.count()
    # Only the fine points and sets of pairs that are near move.
    asked = near.select(F.col("a").alias("cls"), F.col("an").alias("n")).union(near.select("b", "bn")).distinct()
    asked = read_back(sets.sparkSession, C.in_few_tasks(asked, 2 * most), "asked")
    held = sets.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, ["cls", "n"], "left_semi")
    by_fine = with_column(with_column(C.sent(near, most), "a", "fine", held), "b", "fine", held).select(*order, "a_fine", "b_fine")
    near = read_back(sets.sparkSession, C.in_few_tasks(by_fine, most, C.TASK_SETS).mapInArrow(C.per_batch(_finely_bounded), _PAIR), "nearer")
    most = near.count()
    by_set = C.in_few_tasks(with_column(with_column(C.sent(near, most), "a", "tokens", held), "b", "tokens", held), most, C.TASK_SETS)
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return by_set.select(*order, ((NUM + DEN) * shared >= NUM * (F.col("an") + F.col("bn"))).alias("link")), most


class Tree:
    """R-tree over points, packed by set size; nodes keep coordinate maxima and the range of sizes."""

    def __init__(self, at: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((at.argmax(1), n))
        self.levels = [(at[self.order], n[self.order], n[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, at: np.ndarray, n: int) -> np.ndarray:
        """Positions of points that may link with a set of ``n`` tokens at ``at``."""
        found = np.arange(len(self.levels[-1][0]))
        for depth, (top, low, high) in reversed(list(enumerate(self.levels))):
            found = found[(DEN * high[found] >= NUM * n) & (NUM * low[found] <= DEN * n)]
            least = np.maximum(low[found], -(-NUM * n // DEN))
            found = found[np.minimum(top[found], at).sum(1, dtype=np.int64) >= needed(n, least)]
            if depth:
                found = (found[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                found = found[found < len(self.levels[depth - 1][0])]
        return self.order[found]


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, one, two, block, cls, n, comp, early, point) sorted by (token, one, two): pairs between components."""
    for block in C.sorted_groups(batches, ["token", "one", "two"]):
        ends = np.append(block["starts"][1:], len(block["token"]))
        early = np.ascontiguousarray(block["early"]).view(np.int64)
        left, right, held = [], [], 0

        def found() -> pa.RecordBatch:
            i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
            swap = (block["cls"][i] > block["cls"][j]) | (block["cls"][i] == block["cls"][j]) & (block["n"][i] > block["n"][j])
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            return pa.RecordBatch.from_arrays([pa.array(block[k][x]) for k, x in (("cls", i), ("n", i), ("cls", j), ("n", j))], ["a", "an", "b", "bn"])

        for start, end in zip(block["starts"], ends, strict=True):
            at, n = points(block["point"][start:end]), block["n"][start:end]
            comp, token = block["comp"][start:end], block["token"][start]
            one, two = block["one"][start], block["two"][start]
            mine = np.flatnonzero(block["block"][start:end] == one)
            if not len(mine):
                continue
            tree = Tree(at[mine], n[mine])
            for q in np.flatnonzero(block["block"][start:end] == two):
                hits = mine[tree.search(at[q], int(n[q]))]
                hits = hits[comp[hits] != comp[q]]
                if one == two:
                    hits = hits[hits < q]
                # A pair that also meets in a cell of a smaller token is left to that cell.
                before = early[start + q]
                before = before[before < token]
                if len(before) and len(hits):
                    hits = hits[~np.isin(early[start + hits], before).any(1)]
                left.append(start + hits)
                right.append(np.full(len(hits), start + q))
                held += len(hits)
                if held > 100_000:
                    yield found()
                    left, right, held = [], [], 0
        yield found()


def _searchable(heads: DataFrame) -> tuple[bool, int, int]:
    """Whether the open cells (``m`` members each) have so few pairs that no further star has to join members first; how many cells
    and how many members there are."""
    cells, members, pairs = heads.agg(F.count(F.lit(1)), F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()
    return not members or pairs <= MEETINGS * members, cells, members or 0


def _linked_by(spark: SparkSession, links: DataFrame, most: int) -> DataFrame:
    """``cls``, ``n``, ``comp`` (a key of the component) for each class of ``links``, ``most`` of them about."""
    node = lambda c, n: F.struct(F.col(c).alias("cls"), F.col(n).alias("n"))
    found = components(spark, links.select(node("a", "an").alias("a"), node("b", "bn").alias("b")), most)
    return found.select("node.cls", "node.n", F.col("component.cls").alias("comp"), F.col("component.n").alias("compn"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, itself included).

    Defined results: a null text, an empty one and one of white space have no shingles and are linked with nothing; a text of
    fewer than five words is one shingle; rows repeated with one id are each returned; a row without an id links like any
    other and gets the smallest id of its component, or null where no row of it has one; an empty table gives an empty result.
    """
    found = _near_rows(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("keep.id")).otherwise(F.col("id")).alias("component_id"))


def _near_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: ``id``, ``own`` (digest of the text), ``n`` and ``keep`` (id and digest of the first row of its component)."""
    with C.small_batches(docs.sparkSession, size=C.TEXT_BYTES):
        return _linked_rows(docs, id_col, text_col)


def _linked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("own"))
    texts = marked.select("id", "text")
    counted = read_back(spark, marked.mapInArrow(_count, "kind int, id long, own binary, cls long, n long, body binary"), "counted")
    frequencies = spark.sparkContext.broadcast(_frequencies(counted))
    rows = counted.where("kind = 0").select("id", "own", "cls", "n", "body")
    # Nulls sort first in a struct: an id that is missing must not come before one that is there.
    classes = rows.where("n > 0").groupBy("cls", "n").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("least"), F.when(F.min("body") != F.max("body"), F.raise_error(F.lit("two sets share a class; change the digest")).cast("long")).alias("clash")
    ).where("clash IS NULL").drop("clash")

    star = "token long, a long, an long, b long, bn long"
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    # Heads of one token meet; the stars that map tasks have made already are dealt evenly.
    alone = F.expr("a = b AND an = bn")
    route = F.when(alone, F.xxhash64("token")).otherwise(F.xxhash64("token", "b"))
    stars = texts.mapInArrow(_map_stars(frequencies), star).repartition(int(parts), route).sortWithinPartitions("token", "b", "bn")
    stars = read_back(spark, stars.mapInArrow(_reduce_stars, star), "stars")

    members = stars.select(F.col("a").alias("cls"), F.col("an").alias("n")).union(stars.select("b", "bn")).distinct()
    wanted = read_back(spark, classes.join(members, ["cls", "n"]).select(F.col("least.id").alias("least_id"), F.col("least.own").alias("least_own")), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    same = F.col("id").eqNullSafe(F.col("least_id")) & (F.col("own") == F.col("least_own"))
    chosen = marked.join(F.broadcast(wanted) if few else wanted, same, "left_semi").select("id", "text")
    sets = read_back(spark, chosen.mapInArrow(_sets, "cls long, n long, point binary, fine binary, tokens array<long>"), "sets")
    # Only a row repeated with its id brings a class twice; where none does, the sets need no shuffle of their own.
    if sets.groupBy("cls", "n").count().where("count > 1").limit(1).count():
        sets = read_back(spark, sets.dropDuplicates(["cls", "n"]), "sets")

    starred = stars.count()
    pairs = stars.select("a", "an", "b", "bn").distinct()
    near_in_size = (F.col("an") * DEN >= F.col("bn") * NUM) & (F.col("bn") * DEN >= F.col("an") * NUM)
    tried, linked = _tried(pairs.where(near_in_size), sets, starred)
    first = read_back(spark, tried.where("link"), "first")

    failed = stars.join(C.sent(first, linked), ["a", "an", "b", "bn"], "left_anti").select("token").distinct()
    failed = read_back(spark, C.in_few_tasks(failed, starred), "failed")
    open_cells = stars.join(C.sent(failed, failed.count()), "token", "left_semi")
    inside = open_cells.select("token", F.col("a").alias("cls"), F.col("an").alias("n")).union(open_cells.select("token", "b", "bn")).distinct()
    # Cells of the same members are searched once; cells of two members have been tried.
    inside = read_back(spark, C.in_few_tasks(inside, 2 * starred), "inside")
    met = inside.count()
    sign = inside.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("cls", "n").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("n", "cls")).alias("s2")
    ).where("m > 2").groupBy("m", "s1", "s2").agg(F.min("token").alias("token"))
    sign = read_back(spark, C.in_few_tasks(sign.select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), met), "cells")
    inside = read_back(spark, C.in_few_tasks(inside.join(C.sent(sign, sign.count()), "token"), met), "searched")
    links = first
    for turn in range(STAR_TURNS + 1):
        comps = read_back(spark, _linked_by(spark, links, linked), "comps")
        named = inside.join(C.sent(comps, comps.count()), ["cls", "n"], "left")
        named = named.select("token", "blocks", "cls", "n", F.xxhash64(F.coalesce("comp", "cls"), F.coalesce("compn", "n")).alias("comp"))
        named = read_back(spark, C.in_few_tasks(named, met), "named")
        heads = named.groupBy("token").agg(
            F.min_by(F.struct("cls", "n", "comp"), F.xxhash64("cls", "n", F.lit(turn))).alias("h"), F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.count(F.lit(1)).alias("m"),
        ).where("low <> high").select("token", "h", "m")
        heads = read_back(spark, C.in_few_tasks(heads, met), "heads")
        searchable, cells, members = _searchable(heads)
        if turn == STAR_TURNS or searchable:
            break
        # A star around another member of each cell, only between components, joins most of what is left of a large family.
        stars = named.join(C.sent(heads, cells), "token").where("comp <> h.comp").select(F.struct("cls", "n").alias("x"), F.struct("h.cls", "h.n").alias("y"))
        stars = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().select(
            F.col("x.cls").alias("a"), F.col("x.n").alias("an"), F.col("y.cls").alias("b"), F.col("y.n").alias("bn")
        ).where(near_in_size)
        tried, more = _tried(stars, sets, members)
        links, linked = read_back(spark, links.unionByName(tried.where("link")), "turn"), linked + more

    # What is left is searched: each member meets the members of its own and of every other block of its cell.
    dealt = read_back(spark, C.in_few_tasks(named.join(C.sent(heads.select("token"), cells), "token", "left_semi"), members), "dealt")
    meetings = dealt.agg(F.sum("blocks")).first()[0] or 0
    early = dealt.groupBy("cls", "n").agg(F.slice(F.array_sort(F.collect_set("token")), 1, EARLY).alias("early"))
    # Padded to one width with the largest number, which no token is before.
    early = early.select("cls", "n", F.concat("early", F.array_repeat(F.lit((1 << 63) - 1), EARLY - F.size("early"))).alias("early"))
    early = early.mapInArrow(C.per_batch(_as_bytes), "cls long, n long, early binary")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", F.col("other").cast("long")).alias("one"), F.greatest("block", F.col("other").cast("long")).alias("two"), "block", "cls", "n", "comp"
    )
    about = read_back(spark, C.in_few_tasks(early.join(sets.select("cls", "n", "point"), ["cls", "n"]), members), "about")
    cells = dealt.join(about, ["cls", "n"]).select("token", "one", "two", "block", "cls", "n", "comp", "early", "point")
    cells = cells.repartition(int(parts), "token", "one", "two").sortWithinPartitions("token", "one", "two")
    found = cells.mapInArrow(_search_cells, _PAIR).distinct()
    tried, more = _tried(found, sets, meetings, bounded=True)
    links = read_back(spark, links.unionByName(tried.where("link")).select("a", "an", "b", "bn"), "links")

    comps = read_back(spark, _linked_by(spark, links, linked + more), "comps")
    joined = comps.count()
    least = C.sent(comps, joined).join(classes, ["cls", "n"]).groupBy("comp", "compn").agg(F.min("least").alias("least"))
    reached = C.sent(comps, joined).join(C.in_few_tasks(least, joined), ["comp", "compn"]).select("cls", "n", F.col("least").alias("linked"))
    reached = C.sent(read_back(spark, C.in_few_tasks(reached, joined), "reached"), joined)
    labels = read_back(spark, classes.join(reached, ["cls", "n"], "left").select("cls", "n", F.coalesce("linked", "least").alias("keep")), "labels")
    return rows.join(labels, ["cls", "n"], "left").select("id", "own", "n", "keep")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, and every document without shingles; columns of ``docs``.

    The row with the smallest id stays, of rows that share it, or of rows of which none has an id, the one with the smallest
    digest; rows repeated with id and text are one.
    """
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("own") == F.col("keep.own"))
    found = _near_rows(docs, id_col, text_col).where("n > 0").select("id", "own", stays.alias("stays"))
    keyed = found.groupBy("id", "own").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    # Rows that go, and rows that stay but stand there several times.
    gone = keyed.where("NOT stays OR rows > 1").select(F.col("id").alias("gone"), F.col("own").alias("gone_own"), F.expr("stays").alias("again"))
    gone = read_back(docs.sparkSession, gone, "gone")
    total, again = gone.agg(F.count(F.lit(1)), F.count_if("again")).first()
    sent = lambda df: F.broadcast(df) if total <= BROADCAST_IDS else df
    rows = C.carried(docs, F.col(id_col).cast("long").alias("own_id"), F.unhex(F.md5(text_col)).alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("gone")) & (F.col("own") == F.col("gone_own"))
    out = rows.join(sent(gone), same, "left_anti")
    if again:
        out = out.unionByName(rows.join(sent(gone.where("again")), same, "left_semi").dropDuplicates(["own_id", "own"]))
    return C.released(out)
