"""Language-model scoring by Katz backoff over word pairs.

``P(w | v)`` is the Good-Turing discounted share of ``v w`` among the followers of ``v`` where the pair was seen in learning,
else ``alpha(v) P(w)``; ``P(w)`` is the discounted share of ``w``, and words never seen share what the known ones leave. The
backoff weights are exact: ``alpha(v)`` is the mass the followers of ``v`` leave over the mass that the words not seen after
``v`` have, so that each context sums to one over the known words and the unknown one. A text is its words and one end; the
first word follows a start mark. Counts up to ``LARGE`` are discounted by Good-Turing as Katz has it; larger ones give up
``TAIL`` of a count instead of nothing, as do all counts for which the counts of counts yield no ratio between 0 and 1, so
that no context is left without mass to back off to.

The corpus is held as a table of chunks of about ``CHUNK`` tokens, each with its own dictionary. Whatever is looked up by key
(counts of words, counts of pairs, weights of contexts) is asked for by sorted distinct keys, one packed row for each chunk
and bucket of keys, and answered in the same order into a table partitioned by bucket. So the word or pair that fills a third
of all rows is one entry a chunk, buckets are ranges of a uniform hash, and memory is bounded by a chunk or a bucket, whose
number grows with the corpus. Each token is then evaluated recursively from the tables of its chunk: pair, else weight and word.

Words and pairs are told apart by 64-bit hashes.

Defined results: a null or empty text is its end alone; rows without an id get a score like all others and whatever
``learnable`` says of them (null: not learned from); equal rows are scored and learned from each for itself; without any
learned text every token is unknown and has probability one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_back, shared_dir
from . import common as C

CHUNK = 1 << 19
#: Tokens for each bucket of keys.
BUCKET = 1 << 21
LARGE = 5
TAIL = 0.5
START, END = np.uint64(0), np.uint64(1)


# packed arrays ------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(packed: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``bucket, begin, end`` of the sorted ``keys`` in each of ``buckets`` equal ranges of 64 bits that holds any."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    edges = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(b, s, e) for b, (s, e) in enumerate(zip(edges, edges[1:], strict=False)) if s < e]


# chunks -------------------------------------------------------------------------------------

_CHUNKS = "chunk long, ids array<long>, learn array<boolean>, sizes binary, words binary, tokens binary"


def hashes(text: str | None) -> np.ndarray:
    """The tokens of a text as 64-bit hashes, its end included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    np.maximum(out, END + END, out=out)
    out[-1] = END
    return out


def _to_chunks(limit: int):
    def close(chunk: int, ids: list, learn: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
        row = [chunk, ids, learn, pack(np.array([len(t) for t in texts], np.uint32)), pack_sorted(words), pack(tokens.astype(np.uint32))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        names = ["chunk", "ids", "learn", "sizes", "words", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, learn, texts, size = [], [], [], 0
        for batch in batches:
            for i, t, l in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids.append(i.as_py())
                learn.append(bool(l.as_py()))
                texts.append(hashes(t.as_py()))
                size += len(texts[-1])
                if size >= limit:
                    yield close(chunk, ids, learn, texts)
                    chunk, ids, learn, texts, size = chunk + 1, [], [], [], 0
        if ids:
            yield close(chunk, ids, learn, texts)

    return run


class Chunk:
    """The texts of one chunk: ``words`` (sorted hashes), ``tokens`` (places in ``words``), their texts and what precedes them."""

    def __init__(self, row: dict):
        self.words, self.tokens = unpack_sorted(row["words"]), unpack(row["tokens"], np.uint32).astype(np.int64)
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.learn = np.repeat(np.array(row["learn"], bool), self.sizes)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        #: Contexts are ``words`` after the start mark.
        self.before = np.empty(len(self.tokens), np.int64)
        self.before[1:] = self.tokens[:-1] + 1
        self.before[first] = 0
        self.contexts = np.concatenate([[START], self.words])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the pairs, the pair of each token, and a token of each pair."""
        mixed = (self.contexts[self.before] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed = (mixed + self.words[self.tokens]) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        keys, at, inverse = np.unique(mixed, return_index=True, return_inverse=True)
        return keys, inverse, at


# counts by key ------------------------------------------------------------------------------


def _ask(kind: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                keys, at = (chunk.words, chunk.tokens) if kind == "word" else chunk.pairs()[:2]
                counts = np.bincount(at[chunk.learn], minlength=len(keys)).astype(np.uint32)
                parts = slices(keys, buckets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()),
                    pa.array([pack_sorted(keys[s:e]) for _, s, e in parts], pa.binary()),
                    pa.array([pack(counts[s:e]) for _, s, e in parts], pa.binary()),
                ], ["bucket", "chunk", "keys", "counts"])

    return run


def _by_chunk(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["chunk"])


def _count(table: pa.Table) -> pa.Table:
    """Totals of a bucket's keys for each chunk that asked, and which keys it is the first to have learned from."""
    rows = _by_chunk(table)
    asked = [unpack_sorted(r["keys"]) for r in rows]
    counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.zeros(len(keys), np.uint64)
    np.add.at(totals, inverse, counts.astype(np.uint64))
    learned = np.flatnonzero(counts)
    owner = np.zeros(len(counts), np.uint8)
    owner[learned[np.unique(inverse[learned], return_index=True)[1]]] = 1
    known = totals[totals > 0]
    of_counts = [int((known == r).sum()) for r in range(1, LARGE + 2)]
    edges = np.cumsum([0, *map(len, asked)])
    spans = list(zip(edges, edges[1:], strict=False))
    none = [None] * len(rows)
    return pa.table({
        "chunk": pa.array([*[r["chunk"] for r in rows], None], pa.int64()), "bucket": pa.array([rows[0]["bucket"]] * (len(rows) + 1), pa.int32()),
        "totals": pa.array([*[pack(totals[inverse[s:e]]) for s, e in spans], None], pa.binary()),
        "owner": pa.array([*[pack(owner[s:e]) for s, e in spans], None], pa.binary()),
        "stats": pa.array([*none, [int(known.sum()), len(known), *of_counts]], pa.list_(pa.int64())),
    })


_COUNTS = "chunk long, bucket int, totals binary, owner binary, stats array<long>"


def key_counts(spark: SparkSession, chunks: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Counts over all learned texts of the words or pairs (``kind``) of each chunk, by bucket, and each bucket's statistics."""
    asked = chunks.mapInArrow(_ask(kind, buckets), "bucket int, chunk long, keys binary, counts binary")
    return read_back(spark, asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count, _COUNTS), f"{kind}-counts")


class Discount:
    """The sums over a table of counts, and what is left of a count."""

    def __init__(self, counts: DataFrame):
        places = [F.sum(F.col("stats")[i]) for i in range(LARGE + 3)]
        row = counts.where("chunk IS NULL").agg(*places).first()
        self.total, self.distinct, *self.of_counts = [int(x or 0) for x in row]
        r = np.arange(LARGE + 1, dtype=float)
        self.kept = np.maximum(r - TAIL, 0)
        n = np.array([0, *self.of_counts], float)
        with np.errstate(all="ignore"):
            tail = (LARGE + 1) * n[LARGE + 1] / n[1]
            turing = (r + 1) * n[1:] / n[:-1]
            ratio = (turing / r - tail) / (1 - tail)
        fair = (n[:-1] > 0) & (n[1:] > 0) & np.isfinite(ratio) & (ratio > 0) & (ratio < 1)
        fair[0] = False
        self.kept[fair] = ratio[fair] * r[fair]

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.astype(np.int64)
        return np.where(counts > LARGE, counts - TAIL, self.kept[np.minimum(counts, LARGE)])


# evaluation ---------------------------------------------------------------------------------


def _answers(answers: list[dict], column: str, dtype: type) -> np.ndarray:
    parts = [unpack(a[column], dtype) for a in sorted(answers, key=lambda a: a["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


_PARTS = (
    "chunk long, bucket int, keys binary, followers binary, kept binary, backed binary, wanted binary, "
    "ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, open_text binary, open_times binary"
)
_PART_TYPES = {
    "chunk": pa.int64(), "bucket": pa.int32(), **dict.fromkeys(["keys", "followers", "kept", "backed", "wanted"], pa.binary()),
    **dict.fromkeys(["ids", "n_tokens", "n_known"], pa.list_(pa.int64())), **dict.fromkeys(["base", "score"], pa.list_(pa.float64())),
    "open_text": pa.binary(), "open_times": pa.binary(),
}


def _part_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _PART_TYPES.items()], list(_PART_TYPES))


def _evaluate(word: Discount, pair: Discount, buckets: int):
    """Scores but for the backoff weights; what each context's weight is made of; and which weights are wanted how often."""
    rest = 1 - float((word.kept[1:] * word.of_counts[:LARGE]).sum() + _large(word)) / word.total if word.total else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                known = _answers(row["words_known"], "totals", np.uint64).astype(np.int64)
                keys, inverse, at = chunk.pairs()
                totals = _answers(row["pairs_known"], "totals", np.uint64).astype(np.int64)
                owner = _answers(row["pairs_known"], "owner", np.uint8) > 0
                share = np.where(known > 0, word(known) / max(word.total, 1), rest)
                # How often a word was followed is how often it stood; the start mark is followed once for each text, as is an end.
                texts = int(row["texts"])
                followed = np.concatenate([[texts], np.where(chunk.words == END, 0, known)])
                seen = totals[inverse] > 0
                log = np.empty(len(seen))
                log[seen] = np.log10(pair(totals[inverse[seen]]) / followed[chunk.before[seen]])
                log[~seen] = np.log10(share[chunk.tokens[~seen]])
                n = len(chunk.sizes)
                c = known[chunk.tokens]
                base = np.log10((c + 1) / (word.total + word.distinct + 1))
                sums = lambda x, n=n, text=chunk.text: np.bincount(text, x, minlength=n)
                # Contexts that were learned from and whose follower was not: times by text and context.
                open_at = np.flatnonzero(~seen & (followed[chunk.before] > 0))
                wide = len(chunk.contexts)
                spots, times = np.unique(chunk.before[open_at] * n + chunk.text[open_at], return_counts=True)
                wanted_at, open_count = np.unique(spots // n, return_counts=True)
                # Each learned pair counts once in the whole corpus, in the chunk that owns it.
                own = at[owner]
                before = chunk.before[own]
                kept = np.bincount(before, pair(totals[owner]), minlength=wide)
                backed = np.bincount(before, share[chunk.tokens[own]], minlength=wide)
                followers = np.bincount(before, totals[owner], minlength=wide)
                wanted = np.zeros(wide, np.uint32)
                wanted[wanted_at] = open_count
                sent = np.flatnonzero((followers > 0) | (wanted > 0))
                asked = chunk.contexts[sent]
                out = [{
                    "chunk": row["chunk"], "ids": row["ids"], "n_tokens": chunk.sizes.tolist(), "n_known": sums(c > 0).astype(np.int64).tolist(),
                    "base": sums(base).tolist(), "score": sums(log).tolist(),
                    "open_text": pack((spots % n).astype(np.uint32)), "open_times": pack(times.astype(np.uint32)),
                }]
                for b, s, e in slices(asked, buckets):
                    some = sent[s:e]
                    out.append({
                        "chunk": row["chunk"], "bucket": b, "keys": pack_sorted(asked[s:e]), "followers": pack(followers[some].astype(np.uint64)),
                        "kept": pack(kept[some]), "backed": pack(backed[some]), "wanted": pack(wanted[some]),
                    })
                yield _part_rows(out)

    return run


def _large(word: Discount) -> float:
    """The kept part of all counts over ``LARGE`` together."""
    small = sum(r * n for r, n in enumerate(word.of_counts[:LARGE], 1))
    return word.total - small - TAIL * (word.distinct - sum(word.of_counts[:LARGE]))


def _weigh(table: pa.Table) -> pa.Table:
    """The backoff weights of a bucket's contexts, as logarithms, for each chunk: one for each wanted use."""
    rows = _by_chunk(table)
    asked = [unpack_sorted(r["keys"]) for r in rows]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = lambda column, dtype: np.bincount(inverse, np.concatenate([unpack(r[column], dtype) for r in rows]), minlength=len(keys))
    followers, kept, backed = total("followers", np.uint64), total("kept", np.float64), total("backed", np.float64)
    weight = np.log10((1 - kept / np.maximum(followers, 1)) / (1 - backed))
    edges = np.cumsum([0, *map(len, asked)])
    logs = [np.repeat(weight[inverse[s:e]], unpack(r["wanted"], np.uint32)) for r, s, e in zip(rows, edges, edges[1:], strict=False)]
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "logs": pa.array([pack(x) for x in logs], pa.binary()),
    })


def _finish(train_tokens: int):
    kinds = {"id": pa.int64(), "learned": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                logs = _answers(row["weights"] or [], "logs", np.float64)
                text, times = unpack(row["open_text"], np.uint32), unpack(row["open_times"], np.uint32)
                score = np.array(row["score"]) + np.bincount(text, logs * times, minlength=n)
                cols = [row["ids"], row["learn"], row["n_tokens"], row["n_known"], [train_tokens] * n, row["base"], score]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return run


@contextmanager
def _by_chunk_table(spark: SparkSession, chunks: DataFrame) -> Iterator[DataFrame]:
    """The chunks as a table bucketed by chunk in the shared folder: answers come to them, so the texts are never shuffled."""
    name = f"chunks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(parts, "chunk").option("path", shared_dir(spark, "chunks")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _gathered(answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """A chunk's answers side by side."""
    return answers.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", *columns)).alias(name))


def katz_scores(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learnable`` is a condition on the column ``id`` that says which rows are learned from. ``base_score`` is the add-one
    unigram score, ``score`` the log10 probability of the text under the model.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.coalesce(learnable, F.lit(False)).alias("learn"))
    with C.small_batches(spark), _by_chunk_table(spark, rows.mapInArrow(_to_chunks(chunk), _CHUNKS)) as chunks, C.small_batches(spark, 1):
        # A row is a chunk from here on, and a task's batch one of them.
        size = chunks.agg(F.count(F.lit(1)), F.sum(F.size(F.filter("learn", lambda x: x)))).first()
        texts = int(size[1] or 0)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size[0] * chunk // BUCKET)
        words = key_counts(spark, chunks, "word", buckets)
        pairs = key_counts(spark, chunks, "pair", buckets)
        word, pair = Discount(words), Discount(pairs)
        known = _gathered(words, "words_known", "totals").join(_gathered(pairs, "pairs_known", "totals", "owner"), "chunk")
        full = chunks.join(known, "chunk").withColumn("texts", F.lit(texts))
        parts = read_back(spark, full.mapInArrow(_evaluate(word, pair, buckets), _PARTS), "parts")
        asked = parts.where("bucket IS NOT NULL").select("bucket", "chunk", "keys", "followers", "kept", "backed", "wanted")
        weights = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_weigh, "chunk long, bucket int, logs binary")
        weights = read_back(spark, weights, "weights")
        scored = parts.where("bucket IS NULL").drop("bucket", "keys", "followers", "kept", "backed", "wanted").join(chunks.select("chunk", "learn"), "chunk")
        scored = scored.join(_gathered(weights, "weights", "logs"), "chunk", "left")
        out = "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        done = read_back(spark, scored.mapInArrow(_finish(word.total), out), "scored")
    return done.withColumnRenamed("id", id_col)
