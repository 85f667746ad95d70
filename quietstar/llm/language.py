"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter trigram binds the letters' vectors, each
permuted by its place, into one vector (element-wise product); a text bundles its trigrams (sum over the whole text), a
language bundles its learning texts. A text is told by the largest cosine with the languages' prototypes. Anything that is no
letter is one boundary symbol, runs of it count once.

Prototypes are sums over all learning rows: each task adds up its own texts and hands on one vector a language, so what is
shuffled grows with tasks and languages, not with texts.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and where nothing was learned; ties go to the
language that sorts first; other columns don't matter; repeated rows are each told; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: A letter beyond this many code points shares vectors by remainder; 11 bits a letter fit a trigram in one number.
LETTERS = 2047
#: Vectors of trigrams that a task keeps.
KEPT = 24_000
_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, else 1 to ``LETTERS`` of its lower case."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low[0]) % LETTERS + 1
        _TABLE.append(table)
    return _TABLE[0]


def trigrams(text: str | None) -> np.ndarray:
    """Trigram codes of a whole text with a boundary at either end; none without a letter."""
    codes = _symbols()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    return (codes[:-2] << 22) | (codes[1:-1] << 11) | codes[2:]


class Space:
    """Letter vectors and bound trigram vectors of one task."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 1):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.slots: dict[int, int] = {}
        self.bound = np.zeros((KEPT, dimensions), np.int8)

    def letter(self, symbol: int) -> np.ndarray:
        if symbol not in self.letters:
            draw = np.random.default_rng([self.seed, symbol]).integers(0, 2, self.dimensions)
            self.letters[symbol] = (2 * draw - 1).astype(np.int8)
        return self.letters[symbol]

    def vector(self, code: int) -> np.ndarray:
        first, second, third = code >> 22, (code >> 11) & 2047, code & 2047
        return np.roll(self.letter(first), 2) * np.roll(self.letter(second), 1) * self.letter(third)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        if len(self.slots) + len(codes) > KEPT:
            self.slots.clear()
        out = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            slot = self.slots.get(code)
            if slot is None:
                slot = self.slots[code] = len(self.slots)
                self.bound[slot] = self.vector(code)
            out[i] = slot
        return self.bound[out]

    def bundle(self, text: str | None) -> np.ndarray | None:
        codes = trigrams(text)
        if not len(codes):
            return None
        codes, counts = np.unique(codes, return_counts=True)
        out = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(codes), KEPT // 4):
            out += counts[i : i + KEPT // 4].astype(np.float32) @ self.rows(codes[i : i + KEPT // 4]).astype(np.float32)
        return out


def _sum_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, sums = Space(), {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            vector = space.bundle(text.as_py())
            if vector is not None:
                sums[lang] = sums.get(lang, 0) + vector.astype(np.int64)
    langs = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.int64()))], ["lang", "v"])


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes, one row each, of length 1. ``learnable`` is a condition on the column ``id``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(learnable).where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    parts = rows.mapInArrow(_sum_languages, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sums.select("lang", F.transform("v", lambda c: c["x"]).alias("v")).orderBy("lang").collect()
    matrix = np.array([r["v"] for r in found], np.float64).reshape(len(found), DIMENSIONS)
    return [r["lang"] for r in found], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)


def tell_language(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (the cosine, from 0 to 1) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, (langs, prototypes) = Space(), shared.value
        for batch in batches:
            told, scores = [], []
            for text in batch.column(1):
                vector = space.bundle(text.as_py()) if langs else None
                length = 0.0 if vector is None else float(np.linalg.norm(vector))
                if length:
                    cosines = prototypes @ vector / length
                    best = int(np.argmax(cosines))
                    told.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
                else:
                    told.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(out.dtypes)["id"]
    return out.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
