"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of ``m`` characters that stands in a text with at most ``k`` edits shares at least ``m - q + 1 - k q`` of its q-grams
with it, and all of them on diagonals (text position less item position) that differ by at most ``k``. So q-grams of a text
are looked up in an index of the items, hits are counted by (item, diagonal band), bands being ``2 k + 1`` wide and beginning
every ``k + 1`` diagonals so that any ``k + 1`` neighbouring diagonals lie within one, and the regions that reach the bound
are verified by banded alignment. The edit budget is ``BUDGET`` of an item's length (less where the bound would fall to nought).
Letters are compared in lower case, white space as a space.

Items are indexed in blocks of ``BLOCK_CHARS`` characters, each broadcast and held against all documents, so what is broadcast
at once is bounded. Texts are read where they are: only hits and ids are shuffled. A text is read in windows that overlap by
the longest region, so memory doesn't grow with its length.

Defined results: null and empty texts hold nothing; items of fewer than ``Q`` characters (or null) have no q-gram and are never
found; equal items are each reported; every row is judged by its own text, also where it shares its id or has none (for
:func:`drop_contaminated` see there); an empty table of documents or items gives no hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C

Q = 10
BUDGET = 0.08
BLOCK_CHARS = 2_000_000
#: Characters read at once, small enough for the arrays over them to stay in a core's cache.
WINDOW = 1 << 15
#: Regions aligned side by side.
ALIGNED = 256
BROADCAST_IDS = 1_000_000


def _lower_table() -> np.ndarray:
    """Code point to the code point it is compared as; one for one, so positions stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        low = c.lower()
        if c.isspace():
            table[i] = 32
        elif low != c and len(low) == 1:
            table[i] = ord(low)
    return table


_LOWER: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    if not _LOWER:
        _LOWER.append(_lower_table())
    return _LOWER[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q-gram that begins at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, wide = np.zeros(n, np.uint64), codes.astype(np.uint64)
    span, done = 1, 0
    # Blocks of 1, 2, 4, ... positions are doubled; those in q's binary form are joined.
    while q:
        if q & 1:
            out = out * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + wide[done : done + n]
            done += span
        q >>= 1
        if q:
            wide = wide[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + wide[span:]
            span *= 2
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def budget_of(m: int, q: int = Q, share: float = BUDGET) -> int:
    """Edits allowed for an item of ``m`` characters: at least one shared q-gram must follow from the lemma."""
    return max(0, min(int(share * m), (m - q) // q))


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = BUDGET):
        self.q = q
        self.ids = [i for i, t in items if len(t) >= q]
        self.codes = [folded(t) for i, t in items if len(t) >= q]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([budget_of(int(m), q, share) for m in self.length], np.int64)
        self.least = self.length - q + 1 - self.budget * q
        grams = [qgrams(c, q) for c in self.codes]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, self.first = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(gram)))
        # About one in 32 slots is taken, so that most q-grams of a text end at a small table.
        self.shift = np.uint64(64 - max(10, (32 * len(self.grams)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.grams >> self.shift).astype(np.int64)] = True
        self.longest = int((self.length + 3 * self.budget).max()) + q + 2 if len(grams) else 0

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item, item position of every shared q-gram."""
        where = np.flatnonzero(self.table[(grams >> self.shift).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.grams, grams[where]), max(len(self.grams) - 1, 0))
        same = self.grams[slot] == grams[where] if len(where) else np.zeros(0, bool)
        where, slot = where[same], slot[same]
        many = self.count[slot]
        ahead = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        posting = np.repeat(self.first[slot], many) + ahead
        return np.repeat(where, many), self.item[posting], self.at[posting]


_OUTSIDE = np.uint32(0xFFFFFFFF)
_FAR = np.int64(1 << 30)


def align(items: list[np.ndarray], regions: list[np.ndarray], low: list[int], high: list[int], budget: list[int]) -> list[tuple[int, int, int] | None]:
    """For each item edits, start and end in its region of its best place with diagonals ``low`` to ``high``; None over the budget.

    All are aligned side by side, one row of each at a time; those over their budget leave, the longest items end last.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    if not items:
        return out
    at = np.array(sorted(range(len(items)), key=lambda i: -len(items[i])))
    m, least, most = np.array([len(items[i]) for i in at]), np.array(low)[at], np.array(budget)[at]
    wide = np.array(high)[at] - least + 1
    lanes = np.arange(wide.max())
    letters = np.full((len(at), int(m[0])), _OUTSIDE, np.uint32)
    # The text by diagonal: lane j of row i stands at i + j.
    text = np.full((len(at), int(m[0]) + len(lanes)), _OUTSIDE, np.uint32)
    size = np.array([len(regions[i]) for i in at])
    for r, i in enumerate(at):
        letters[r, : m[r]] = items[i]
        part = regions[i][max(0, least[r]) : max(0, least[r] + text.shape[1])]
        text[r, max(0, -least[r]) : max(0, -least[r]) + len(part)] = part
    beyond = lanes >= wide[:, None]
    begin = least[:, None] + lanes
    cost = np.where(beyond | (begin < 0) | (begin > size[:, None]), _FAR, 0)
    for i in range(int(m[0])):
        letter = text[:, i : i + len(lanes)]
        step = cost + np.where(letter == letters[:, i, None], 0, np.where(letter == _OUTSIDE, _FAR, 1))
        # An item character without a text character moves one lane down, a text character without one moves up.
        gap, from_gap = np.full_like(cost, _FAR), np.zeros_like(begin)
        gap[:, :-1], from_gap[:, :-1] = cost[:, 1:] + 1, begin[:, 1:]
        start = np.where(gap < step, from_gap, begin)
        now = np.minimum(step, gap) - lanes
        run = np.minimum.accumulate(now, axis=1)
        came = np.maximum.accumulate(np.where(now == run, lanes, 0), axis=1)
        cost, begin = run + lanes, np.take_along_axis(start, came, 1)
        cost[beyond] = _FAR
        ended = m == i + 1
        if ended.any() or i % 16 == 15:
            within = cost.min(1) <= most
            for r in np.flatnonzero(ended & within):
                best = int(np.argmin(cost[r]))
                out[at[r]] = int(cost[r, best]), int(begin[r, best]), int(least[r]) + best + int(m[r])
            stay = within & ~ended
            if not stay.any():
                break
            if not stay.all():
                at, m, least, most, letters, text, beyond, cost, begin = (x[stay] for x in (at, m, least, most, letters, text, beyond, cost, begin))
    return out


def regions_of(text: str, index: Index) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
    """Regions that reach the lemma's bound: item, place of the region, its letters, lowest and highest diagonal in it."""
    if not index.ids or len(text) < index.q:
        return
    step = max(WINDOW, 2 * index.longest)
    for begin in range(0, len(text), step):
        codes = folded(text[begin : begin + step + index.longest])
        where, item, at = index.hits(qgrams(codes, index.q))
        if not len(where):
            continue
        # A cheap count by item first, then by band.
        enough = np.bincount(item, minlength=len(index.ids)) >= index.least
        keep = enough[item]
        where, item, at = where[keep], item[keep], at[keep]
        size = index.budget[item] + 1
        shift = index.longest
        band = (where - at + shift) // size
        key = np.concatenate([item * (1 << 40) + band, item * (1 << 40) + band - 1])
        bands, counts = np.unique(key, return_counts=True)
        bands = bands[counts >= index.least[bands >> 40]]
        for i, b in zip((bands >> 40).tolist(), (bands & ((1 << 40) - 1)).tolist(), strict=True):
            k = int(index.budget[i])
            low = b * (k + 1) - shift
            high = low + 2 * k + 1
            left = max(0, low - k)
            region = codes[left : max(0, high) + len(index.codes[i]) + k].copy()
            yield i, begin + left, region, low - left - k, high - left + k


def _best(places: dict[tuple[int, int, int], int]) -> list[tuple[int, int, int, int]]:
    """Of places of one item that overlap, the one with fewest edits stays."""
    kept: list[tuple[int, int, int, int]] = []
    for (i, start, end), edits in sorted(places.items(), key=lambda x: (x[0][0], x[1], x[0][1:])):
        if not any(j == i and start < e and s < end for j, s, e, _ in kept):
            kept.append((i, start, end, edits))
    return sorted(kept)


def find_in_texts(texts: Iterable[str | None], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Per text (item id, start, end, edits) of its items: the best place in each region, in code points.

    Regions of all texts are verified together, ``ALIGNED`` at a time.
    """
    found: list[dict[tuple[int, int, int], int]] = []
    held: list[tuple] = []

    def verify() -> None:
        items = [x[1] for x in held]
        places = align([index.codes[i] for i in items], [x[3] for x in held], [x[4] for x in held], [x[5] for x in held], [int(index.budget[i]) for i in items])
        for (row, i, left, *_), place in zip(held, places, strict=True):
            if place:
                edits, start, end = place
                spot = (index.ids[i], left + start, left + end)
                found[row][spot] = min(edits, found[row].get(spot, edits))
        held.clear()

    for row, text in enumerate(texts):
        found.append({})
        for region in regions_of(text or "", index):
            held.append((row, *region))
            if len(held) >= ALIGNED:
                verify()
    verify()
    return [_best(x) for x in found]


def find_items(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """The items of one text, see :func:`find_in_texts`."""
    return find_in_texts([text], index)[0]


_HIT = "id long, own binary, item long, start long, end long, edits long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id``, ``own`` (digest of the text), ``item``, ``start``, ``end``, ``edits`` for every region of a document that holds an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def held_against(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                found = find_in_texts((t.as_py() for t in batch.column(1)), shared.value)
                for i, text, hits in zip(batch.column(0), batch.column(1), found, strict=True):
                    own = hashlib.md5(text.as_py().encode()).digest() if hits else None
                    rows += [(i.as_py(), own, *hit) for hit in hits]
                names = ["id", "own", "item", "start", "end", "edits"]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "own" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

        return texts.mapInArrow(run, _HIT)

    parts, block, size = [], [], 0
    for row in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= BLOCK_CHARS:
            parts.append(held_against(block))
            block, size = [], 0
    if block:
        parts.append(held_against(block))
    out = spark.createDataFrame([], _HIT)
    for part in parts:
        out = out.unionByName(part)
    with C.small_batches(spark, size=C.TEXT_BYTES):
        return read_back(spark, out.distinct(), "leaks")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``contaminated``, ``n_leaks``, ``leaks`` (``item:start:end:edits``, by item and place, comma-joined)."""
    found = leaks(docs, benchmark, id_col, text_col).groupBy("id", "own").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("item", "start", "end", "edits"))).alias("all")
    )
    spot = F.transform("all", lambda x: F.concat_ws(":", x["item"], x["start"], x["end"], x["edits"]))
    found = read_back(docs.sparkSession, found.select(F.col("id").alias("hit"), F.col("own").alias("hit_own"), "n", F.array_join(spot, ",").alias("leaks")), "found")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("own"))
    return rows.join(found, F.col("id").cast("long").eqNullSafe(F.col("hit")) & (F.col("own") == F.col("hit_own")), "left").select(
        F.col("id").alias(id_col), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_leaks"), F.coalesce("leaks", F.lit("")).alias("leaks")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_ids: bool = True) -> DataFrame:
    """The documents that hold no item, with the columns of ``docs``.

    ``whole_ids``: rows with one id are parts of one document and go together; else each row is judged by its own text. Rows
    without an id always are.
    """
    def key(row_id: Column, own: Column) -> Column:
        return F.when(row_id.isNotNull(), F.lit("").cast("binary")).otherwise(own) if whole_ids else own

    gone = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("gone"), key(F.col("id"), F.col("own")).alias("gone_own")).distinct()
    gone = read_back(docs.sparkSession, gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    rows = C.carried(docs, F.col(id_col).cast("long").alias("own_id"), key(F.col(id_col), F.unhex(F.md5(text_col))).alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("gone")) & (F.col("own") == F.col("gone_own"))
    return C.released(rows.join(F.broadcast(gone) if few else gone, same, "left_anti"))
