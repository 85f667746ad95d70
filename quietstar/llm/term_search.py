"""Ranked lexical search: term at a time, with a limit on accumulators.

Documents become postings in chunks of at most ``CHUNK_DOCS`` rows: for each term of the queries the documents of the chunk that
hold it and how often. Document frequencies and lengths are added up over all chunks. Each chunk is then searched for each
query: terms go rarest first and add to accumulators; a term's bound is its largest score in the chunk. Once the bounds of the
terms to come together are less than the ``k``-th partial score, no document without an accumulator can reach the best ``k``, so
no more are created, and the terms to come, the frequent ones, only update those that are there. Each chunk gives its exact best
``k`` for each query, of which the best ``k`` over all chunks are ranked.

Postings are cut by document, not by term, so the term that every document holds is spread over all tasks, and only the best
``k`` of a chunk are shuffled. Queries go in blocks of about ``BLOCK_CHARS`` characters (whole queries), whose terms are what is
broadcast; each block is one pass over all documents.

Terms are maximal runs of ASCII letters and digits and of code points over 127; only A-Z are lower-cased. Weights are whole
numbers, and a document's score sums exactly.

Defined results: null and empty texts have no term and are never found, as queries they find nothing; rows without an id and
rows with equal ids are documents of their own, of equal scores those without an id come last; queries with one id (null
included) are one query with the terms of all; equal scores rank by ascending id; an empty table of either kind gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C
from .katz import pack, unpack

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CHUNK_DOCS = 8192
CHUNK_TERMS = 1 << 22
BLOCK_CHARS = 2_000_000

#: Bytes as they are compared: separators of terms become blanks, A-Z small.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))

_POSTINGS = "ids array<long>, sizes binary, docs binary, tfs binary, terms array<int>, dfs array<int>, n long, l long"


def _to_postings(shared):
    """Chunks of postings of the broadcast terms (a term's number by its bytes)."""

    def close(ids: list, sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        n = len(ids)
        term = np.concatenate(found).astype(np.int64)
        doc = np.repeat(np.arange(n), [len(f) for f in found])
        spots, tfs = np.unique(term * n + doc, return_counts=True)
        terms, dfs = np.unique(spots // n, return_counts=True)
        some = [s for s in sizes if s]
        row = [ids, pack(np.array(sizes, np.int64)), pack((spots % n).astype(np.uint16)), pack(tfs.astype(np.int64)), terms, dfs, len(some), sum(some)]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 3, *[pa.list_(pa.int32())] * 2, pa.int64(), pa.int64()]
        names = ["ids", "sizes", "docs", "tfs", "terms", "dfs", "n", "l"]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        ids, sizes, found, size = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or b"").translate(_FOLD).split()
                at = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                ids.append(i.as_py())
                sizes.append(len(words))
                found.append(at[at >= 0])
                size += len(words)
                if len(ids) >= CHUNK_DOCS or size >= CHUNK_TERMS:
                    yield close(ids, sizes, found)
                    ids, sizes, found, size = [], [], [], 0
        if ids:
            yield close(ids, sizes, found)

    return run


def best_of(terms: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Accumulators of a query over ``size`` documents, those that may be among the best ``k``, and the terms that created them.

    ``terms``: rarest first, the documents that hold each and its score there.
    """
    total = np.zeros(size, np.int64)
    bounds = np.array([s.max(initial=0) for _, s in terms], np.int64)
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)[1:]
    for at, (docs, scores) in enumerate(terms):
        total[docs] += scores
        if size > k and rest[at] < (least := np.partition(total, size - k)[size - k]) and least > 0:
            break
    created = total > 0
    for docs, scores in terms[at + 1 :] if terms else ():
        there = created[docs]
        total[docs[there]] += scores[there]
    return total, np.flatnonzero(created), at + 1 if terms else 0


def _search(shared, k: int, documents: int, length: int):
    """The best ``k`` of each chunk for each query of the block. shared: weights by term, and (query, its terms rarest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
                null = np.array([i is None for i in row["ids"]], bool)
                m = 50 + 50 * unpack(row["sizes"], np.int64) * documents // max(length, 1)
                docs, tf = unpack(row["docs"], np.uint16).astype(np.int64), unpack(row["tfs"], np.int64)
                dfs = np.array(row["dfs"], np.int64)
                weight = np.repeat(weights[np.array(row["terms"], np.int64)], dfs)
                scores = weight * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
                ends = np.cumsum(dfs)
                spans = {t: slice(e - n, e) for t, e, n in zip(row["terms"], ends.tolist(), row["dfs"], strict=True)}
                for query, terms in queries:
                    lists = [(docs[spans[t]], scores[spans[t]]) for t in terms if t in spans]
                    total, some, _ = best_of(lists, len(ids), k)
                    if not len(some):
                        continue
                    if len(some) > k:
                        some = some[total[some] >= np.partition(total[some], len(some) - k)[len(some) - k]]
                    some = some[np.lexsort((ids[some], null[some], -total[some]))[:k]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([query] * len(some), pa.int64()), pa.array([row["ids"][i] for i in some], pa.int64()), pa.array(total[some]),
                    ], ["query", "id", "score"])

    return run


def _blocks(spark: SparkSession, items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Queries with their distinct terms, a bounded block of them at a time."""
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), 0))).alias("term"))
    rows = read_back(spark, rows.distinct(), "queries")
    blocks = -(-int(rows.agg(F.sum(F.length("term") + 1)).first()[0] or 0) // BLOCK_CHARS)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        yield [(r["item"], r["terms"]) for r in own.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()]


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The ``k`` best documents for each query: query id, ``rank`` (from 1), document id, ``score`` (above 0)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in _blocks(spark, items, item_col, item_text):
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        shared = spark.sparkContext.broadcast({t.encode(): i for t, i in numbers.items()})
        with C.small_batches(spark):
            postings = read_back(spark, texts.mapInArrow(_to_postings(shared), _POSTINGS), "postings")
        documents, length = (int(x or 0) for x in postings.agg(F.sum("n"), F.sum("l")).first())
        held = postings.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").cast("long").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(documents).cast("double") + 2) / (2 * F.col("df") + 1)))
        weights, df = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for r in held.select("terms", "df", weight.alias("w")).collect():
            weights[r["terms"]], df[r["terms"]] = r["w"], r["df"]
        queries = [(item, sorted((numbers[t] for t in terms), key=lambda t: (df[t], t))) for item, terms in block]
        model = spark.sparkContext.broadcast((weights, queries))
        with C.small_batches(spark, 1):
            found = read_back(spark, postings.mapInArrow(_search(model, k, documents, length), "query long, id long, score long"), "found")
        shared.unpersist()
        model.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query long, id long, score long")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(item_col), "rank", F.col("id").alias(id_col), "score")
