"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

The features of a text are its single words, its pairs of neighbouring words and the same
of the words' shapes (``A`` capital, ``a`` other letter, ``0`` digit, other characters as
they are; runs count once), hashed to 2**18 columns.  A feature's value is its count by
the square root of the number of features, so long and short texts weigh alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, words_of

BITS = 18
#: At most so many labelled rows are used for the fit: those with the lowest hash of their id.
MAX_TRAIN_ROWS = 8192
EPOCHS = 2
#: Words whose hashes a worker remembers.
CACHE_WORDS = 300_000

_ODD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))
_hashes: dict[bytes, int] = {}


def _hash_word(word: bytes) -> int:
    """The word's hash in the low and its shape's hash in the high 32 bits."""
    shape = word.decode("utf-8", "replace")
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    return zlib.crc32(shape[:8].encode()) << 32 | zlib.crc32(word)


class _Cached(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = _hash_word(word)
        return found


_cached = _Cached()


def features(text: str | None) -> np.ndarray:
    """The columns of a text's n-grams, with repeats; column 0 is the constant."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int32)
    both = np.array(list(map(_cached.__getitem__, words)), dtype=np.uint64)
    found = []
    for salt, one in enumerate((both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32))):
        one = one * _ODD[0] + np.uint32(salt * 7919)
        pair = (one[:-1] * _ODD[1]) ^ (one[1:] + np.uint32(salt + 1))
        found += [one * _ODD[2], np.where(one[:-1] == one[1:], np.uint32(salt + 1), pair) * _ODD[0]]
    mixed = np.concatenate(found)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * _ODD[1]) >> np.uint32(32 - BITS)).astype(np.int32)


def score(weights: np.ndarray, columns: np.ndarray) -> float:
    """The probability of label 1: the constant for a text without words."""
    total = weights[0] + (weights[columns].sum() / np.sqrt(len(columns)) if len(columns) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(rows: list[tuple[np.ndarray, int]], alpha=1.0, beta=1.0, l1=0.01, l2=0.05) -> np.ndarray:
    """FTRL-proximal weights after ``EPOCHS`` passes over (columns, label) in the order given.

    Without rows all weights are 0 and every score is 0.5.
    """
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    for _ in range(EPOCHS):
        for columns, label in rows:
            at, counts = np.unique(columns, return_counts=True)
            x = counts / np.sqrt(max(1, len(columns)))
            at, x = np.append(at, 0), np.append(x, 1.0)
            root, held = np.sqrt(n[at]), z[at]
            w[at] = np.where(
                np.abs(held) <= l1, 0.0, (np.sign(held) * l1 - held) / ((beta + root) / alpha + l2)
            )
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w[at]
            n[at] += g * g
    root = np.sqrt(n)
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + root) / alpha + l2))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
) -> np.ndarray:
    """Train on the labelled rows of ``docs``; one bounded sample in one task.

    Rows without an id or a label are left out; an id that is labelled twice counts with
    its higher label, and repeated rows of ``docs`` count as often as they occur.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter("_id is not null and _label is not null")
        .groupBy("_id").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({
                "_id": rows["_id"], "_label": rows["_label"],
                "_columns": [features(t if isinstance(t, str) else None).tobytes() for t in rows["_text"]],
            })

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_at=[zlib.crc32(str(i).encode()) for i in rows["_id"]])
        rows = rows.sort_values(["_at", "_id", "_columns"], kind="stable")
        w = train([(np.frombuffer(c, np.int32), y) for c, y in zip(rows["_columns"], rows["_label"])])
        return pd.DataFrame({"weights": [w.tobytes()]})

    found = texts.mapInPandas(hashed, "_id long, _label int, _columns binary")
    one = found.withColumn("_all", F.lit(0)).groupBy("_all")
    model = one.applyInPandas(learn, "weights binary").collect()
    return np.frombuffer(model[0][0]) if model else np.zeros(1 << BITS)


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; null and empty texts get that of no words.

    A column that is already called ``name`` is replaced.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        w = model.value
        return pd.Series([score(w, features(t)) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(text_col))
