"""Vector index and similarity search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, IDF, Normalizer, StopWordsRemover, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from . import ranking

#: Queries in a block, vectors in a chunk, blocks that are broadcast together.
BLOCK = 1024
CHUNK = 2048
PASS = 16


def normalize_index(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Unit vectors, so that cosine similarity is a dot product."""
    dense = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    unit = Normalizer(inputCol="_v", outputCol="_unit").transform(dense)
    return unit.withColumn(vector, vector_to_array("_unit")).drop("_v", "_unit")


def fit_embedder(df: DataFrame, text_col: str = "clean_text", size: int = 256) -> PipelineModel:
    """Hashed TF-IDF of fixed width: one distributed pass for the weights, nothing else to train.

    The same model embeds queries. A pretrained encoder plugs in through ``sentiment.score_table``.
    """
    return Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="_words"),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        HashingTF(inputCol="_kept", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]).fit(df)


def embed(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Unit-length ``array<float>`` vectors, kept in the row of their text."""
    return model.transform(df).select(*df.columns, vector_to_array("_unit", "float32").alias("embedding"))


def best_rows(sims: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row of ``sims``, ties by name; only what reaches the ``k``-th value is sorted."""
    k = min(k, sims.shape[1])
    out = np.empty((len(sims), k), np.int64)
    if not out.size:
        return out
    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    for i, row in enumerate(sims):
        some = np.flatnonzero(row >= least[i])
        out[i] = some[np.lexsort((names[some], -row[some]))[:k]]
    return out


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors as rows of length one; those of length nought stay, null and shorter ones become nought."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    x = np.array([v if v is not None and len(v) == width else [0.0] * width for v in vectors], float).reshape(len(vectors), width)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def unit_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """``unit_rows`` of a list column, without a Python object for each number where all rows have one width."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    values = [part.flatten() for part in parts]
    widths = {int(w) for part in parts for w in np.unique(np.diff(part.offsets.to_numpy()))}
    if len(widths) != 1 or any(part.null_count for part in parts) or any(v.null_count for v in values):
        return unit_rows(column.to_pylist())
    x = np.concatenate([v.to_numpy(zero_copy_only=False) for v in values]).astype(float, copy=False).reshape(len(column), widths.pop())
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in chunks of at most ``CHUNK``, one row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(i).to_pylist()], pa.list_(part.schema.field(i).type)) for i in (0, 1)], ["keys", "vectors"])


def _best_of_chunks(k: int, schema: T.StructType):
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, keys, vectors = (batch.column(c)[i].values for c in ("asked", "keys", "vectors"))
                q, x = unit_rows(asked.field("q").to_pylist()), unit_rows(vectors.to_pylist())
                if q.shape[1] != x.shape[1]:
                    continue
                sims = np.round(q @ x.T, 9)
                found = best_rows(sims, keys.to_numpy(zero_copy_only=False), k)
                ids = asked.field("query_id").take(pa.array(np.repeat(np.arange(len(q)), found.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, keys.take(pa.array(found.ravel())), pa.array(np.take_along_axis(sims, found, 1).ravel())], names)

    return run


def semantic_search(index: DataFrame, queries: DataFrame, k: int = 6, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` most similar index rows per query, exactly.

    ``queries``: query_id, q. Queries are packed into rows of about ``BLOCK`` and the index into rows of ``CHUNK`` vectors; each chunk
    meets each block once, as matrices, and keeps its best ``k`` per query, so what is shuffled is k rows per query and chunk,
    never a row pair. Up to ``PASS`` blocks are broadcast to one reading of the index; more queries take more readings.
    """
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    n_blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    blocks = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    rows = index.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kinds = [T.ArrayType(rows.schema[c].dataType) for c in ("key", "vector")]
    chunks = rows.mapInArrow(_packed, T.StructType([T.StructField("keys", kinds[0]), T.StructField("vectors", kinds[1])]))
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("similarity", T.DoubleType()),
    ])
    found = None
    for first in range(0, n_blocks, PASS):
        last = min(first + PASS, n_blocks) - 1
        part = blocks if n_blocks <= PASS else blocks.where(F.col("block").between(first, last))
        dealt = chunks.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last))))
        met = dealt.join(F.broadcast(part), "block").mapInArrow(_best_of_chunks(k, schema), schema)
        found = met if found is None else found.unionByName(met)
    best = ranking.top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("key")], k, spread_by=F.col("key"))
    return best.select("query_id", F.col("key").alias(key), "similarity", "rank_no")


def match_insight(matches: DataFrame) -> DataFrame:
    """Mean score, mean stars, silent-killer share and modal aspect of each query's matches.

    ``matches`` holds at most k rows per query.
    """
    modal = ranking.top_per_group(
        matches.groupBy("query_id", "topic_label").agg(F.count(F.lit(1)).alias("_n")),
        ["query_id"], [F.desc("_n"), F.asc("topic_label")], 1, "_r",
    ).select("query_id", F.col("topic_label").alias("top_aspect"))
    out = matches.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.avg("star_rating").alias("avg_star"),
        (F.avg(F.col("is_silent_killer").cast("double")) * 100).alias("sk_rate"),
    ).join(modal, "query_id")
    killers = F.when(
        F.round("sk_rate", 0) > 0,
        F.concat(F.lit(", silent killers "), F.format_string("%.0f", F.round("sk_rate", 0)), F.lit("%")),
    ).otherwise("")
    sentence = F.concat(
        F.lit("Matches: mean sentiment "), F.format_string("%+.2f", F.round("avg_sentiment", 2)),
        F.lit(" ("), F.col("tone"), F.lit("), mean stars "), F.format_string("%.1f", F.round("avg_star", 1)),
        F.lit(", main aspect "), F.col("top_aspect"), killers,
    )
    return out.withColumn("tone", labels.tone(F.col("avg_sentiment"))).withColumn("insight", sentence)
