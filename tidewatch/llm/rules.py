"""Quality rules: plain limits on word statistics, and an isolation forest on the same statistics.

The forest's trees split a random statistic at a random value until a row stands
alone; rows that need few splits are anomalous.  The score of a row is
``2 ** (-mean path length / c)`` with c the mean path length of an unsuccessful search.  The
trees come from a bounded sample; the threshold on the score comes from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, small_batches, words_of
from tidewatch.workspace import written

#: Limits of the plain rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Trees, rows for each, and the labelled rows they are drawn from (those with the lowest
#: hash of their id); of the sample, at most this share has label 0, so that these are few.
TREES, TREE_ROWS, SAMPLE_ROWS, BAD_SHARE = 100, 256, 4096, 0.03
#: Shares of capitals among the characters, and of repeated words, that are common in good text.
USUAL = 0.2, 0.3
#: Largest share of good labelled rows that the threshold may reject.
MAX_GOOD_LOSS = 0.002
#: Scores are compared in steps of this size.
STEP = 1e-4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_capitals", "n_marked_words")
#: All columns of :func:`with_statistics` besides the id.
NAMES = (*BASE, *MORE, "n_lines")

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_CACHE_WORDS = 300_000


class _Words(dict):
    """Hash of a word, and whether it ends in a sign that is doubled."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        marked = len(word) > 1 and word[-1] == word[-2] and not chr(word[-1]).isalnum() and word[-1] < 128
        self[word] = found = xxhash.xxh3_64_intdigest(word) & ~1 | marked
        return found


_words = _Words()


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics named in ``BASE`` and ``MORE``; all 0 for null and for a text without words.

    Windows of three words are compared by 64-bit hashes.
    """
    text = text or ""
    words = words_of(text)
    symbols = sum(map(text.count, _SYMBOLS))
    if not words:
        return (0, 0, symbols, *[0] * 4)
    seen: set[str] = set()
    repeated_lines = 0
    if "\n" in text:
        lines = [line for line in text.split("\n") if line.strip(_SPACE)]
        seen.update(lines)
        repeated_lines = len(lines) - len(seen)
    hashed = np.array(list(map(_words.__getitem__, words)), np.uint64)
    covered = 0
    if len(words) > 3:
        windows = hashed[:-2] * np.uint64(0x9E3779B97F4A7C15)
        windows = (windows ^ (windows >> np.uint64(29))) + hashed[1:-1] * np.uint64(0xBF58476D1CE4E5B9)
        windows = (windows ^ (windows >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + hashed[2:]
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            mask = np.zeros(len(words), bool)
            at = np.flatnonzero(np.isin(windows, twice))
            for k in range(3):
                mask[at + k] = True
            covered = int(mask.sum())
    capitals = sum(map(str.isupper, text))
    return (
        len(words), len(text) - sum(map(text.count, _SPACE)), symbols, repeated_lines, covered,
        capitals, int((hashed & np.uint64(1)).sum()),
    )


def lines_of(text: str | None) -> int:
    """Lines that are not blank."""
    return sum(1 for line in (text or "").split("\n") if line.strip(_SPACE))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every whole text, one row per row; other columns are not read."""
    ship(docs.sparkSession)
    names = NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [(*statistics(text), lines_of(text)) for text in (one.as_py() for one in batch.column(1))]
            made = [pa.array(column, pa.int64()) for column in (zip(*rows) if rows else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *names])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures(rows: pd.DataFrame) -> np.ndarray:
    """What the trees split on: shares that are 0, or nearly so, for ordinary text of any length.

    Symbols beside words, words that end in a doubled sign, and what the shares of capitals
    and of repeated words have beyond ``USUAL``.
    """
    words = np.maximum(1, rows["n_words"].to_numpy())
    symbols = rows["n_symbols"].to_numpy()
    shares = rows["n_capitals"].to_numpy() / np.maximum(1, rows["word_chars"].to_numpy()), rows["n_repeat_words"].to_numpy() / words
    beyond = [np.maximum(0.0, share - usual) for share, usual in zip(shares, USUAL)]
    return np.column_stack([symbols / (symbols + words), rows["n_marked_words"].to_numpy() / words, *beyond])


def base_measures(rows: pd.DataFrame) -> np.ndarray:
    """Mean word length, and the shares of duplicate lines, repeated words and symbols, uncut."""
    words, lines = np.maximum(1, rows["n_words"].to_numpy()), np.maximum(1, rows["n_lines"].to_numpy())
    symbols = rows["n_symbols"].to_numpy()
    return np.column_stack([
        rows["word_chars"].to_numpy() / words, rows["n_dup_lines"].to_numpy() / lines,
        rows["n_repeat_words"].to_numpy() / words, symbols / (symbols + words),
    ])


#: One forest on each of these; in one forest the spread of ordinary texts would hide rare signs.
MEASURES = {"isolation": measures, "isolation_base": base_measures}


def _mean_path(rows: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among so many rows."""
    n = np.asarray(rows, np.float64)
    more = np.maximum(n, 3.0) - 1
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(more) + 0.5772156649) - 2 * more / np.maximum(n, 1)))


def grow(sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> list[np.ndarray]:
    """Trees as arrays of nodes: column (-1 for a leaf), bound or path length, child at or below, child above."""
    draws = np.random.RandomState(seed)
    limit = int(np.ceil(np.log2(max(2, min(rows, len(sample)))))) + 2
    grown = []
    for _ in range(trees if len(sample) else 0):
        own = sample[draws.permutation(len(sample))[:rows]]
        nodes: list[list[float]] = [[]]
        waiting = [(0, own, 0)]
        while waiting:
            at, part, depth = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(open_columns):
                nodes[at] = [-1, depth + float(_mean_path(len(part))), 0, 0]
                continue
            column = int(open_columns[draws.randint(len(open_columns))])
            bound = draws.uniform(low[column], high[column])
            below = part[:, column] <= bound
            nodes[at] = [column, bound, len(nodes), len(nodes) + 1]
            waiting += [(len(nodes), part[below], depth + 1), (len(nodes) + 1, part[~below], depth + 1)]
            nodes += [[], []]
        grown.append(np.array(nodes))
    return grown


def isolation(forest: list[np.ndarray], points: np.ndarray, rows: int) -> np.ndarray:
    """Score between 0 and 1 of every point, higher for anomalies; 0 without trees."""
    if not forest or not len(points):
        return np.zeros(len(points))
    total = np.zeros(len(points))
    every = np.arange(len(points))
    for nodes in forest:
        at = np.zeros(len(points), np.int64)
        while True:
            column = nodes[at, 0].astype(np.int64)
            inner = column >= 0
            if not inner.any():
                break
            below = points[every, np.maximum(column, 0)] <= nodes[at, 1]
            at = np.where(inner, np.where(below, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
        total += nodes[at, 1]
    return 2.0 ** (-total / len(forest) / max(float(_mean_path(rows)), 1e-9))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict[str, list[np.ndarray]]:
    """Trees of every forest of ``MEASURES``, from a bounded sample of the labelled rows that pass the plain rules.

    A label is 1 for good and 0 for bad; the higher of several counts.  Without labels
    there are no trees, and nothing is anomalous.
    """
    told = _told(measured, labels, label).filter(~base_failed())
    columns = NAMES
    found = []
    for value, most in ((1, sample_rows), (0, max(1, int(sample_rows * BAD_SHARE)))):
        rows = told.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id", *columns)
        found.append(rows.limit(most).select(*columns).toPandas())
    good, bad = found
    bad = bad[: max(1, int(len(good) * BAD_SHARE / (1 - BAD_SHARE)))] if len(good) else bad
    return {name: grow(np.concatenate([made(good), made(bad)])) for name, made in MEASURES.items()}


def _told(measured: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    known = labels.select("doc_id", F.col(label).alias("_label")).filter("doc_id is not null and _label is not null")
    return measured.join(known.groupBy("doc_id").agg(F.max("_label").alias("_label")), "doc_id")


def with_isolation(measured: DataFrame, forests: dict[str, list[np.ndarray]]) -> DataFrame:
    """``measured`` with the columns ``isolation`` and ``isolation_base``."""
    spark = measured.sparkSession
    ship(spark)
    trees = spark.sparkContext.broadcast(forests)
    rows = TREE_ROWS

    @F.pandas_udf(", ".join(f"{name} double" for name in MEASURES))
    def scored(*columns: pd.Series) -> pd.DataFrame:
        frame = pd.concat(columns, axis=1, keys=NAMES)
        return pd.DataFrame({name: isolation(trees.value[name], made(frame), rows) for name, made in MEASURES.items()})

    return measured.withColumn("_scores", scored(*[F.col(c) for c in NAMES])).select(*measured.columns, "_scores.*")


def threshold(
    scored: DataFrame, labels: DataFrame, label: str = "quality", loss: float = MAX_GOOD_LOSS, score: str = "isolation",
    limits: dict[str, float] | None = None,
) -> float:
    """The score above which a row is anomalous, from all labelled rows that pass the plain rules.

    Of the scores that reject at most ``loss`` of the good rows, the one that tells the bad
    rows best from the good ones; 1 without good and bad rows.  Rows that ``limits`` of other
    scores reject count as lost already.  The driver sees counts per step of the score only.
    """
    told = _told(scored, labels, label).filter(~base_failed())
    out = F.lit(False)
    for name, limit in (limits or {}).items():
        out = out | (F.col(name) > limit)
    step = F.when(out, F.lit(None)).otherwise(F.floor(F.col(score) / STEP)).cast("int").alias("step")
    counts = told.groupBy(step).agg(
        F.sum((F.col("_label") == 1).cast("long")).alias("good"), F.sum((F.col("_label") == 0).cast("long")).alias("bad")
    )
    found = counts.collect()
    rows = sorted((r for r in found if r["step"] is not None), reverse=True)
    lost = sum(r["good"] for r in found if r["step"] is None)
    all_good, all_bad = lost + sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    best, gained, good, bad = 1.0, 0.0, 0, 0
    for at, row in enumerate(rows):
        good, bad = good + row["good"], bad + row["bad"]
        if lost + good > loss * all_good or not all_bad or not all_good:
            break
        gain = bad / all_bad - good / all_good
        if gain > gained:  # halfway to the next step that holds a row
            following = rows[at + 1]["step"] if at + 1 < len(rows) else row["step"] - 1
            best, gained = (row["step"] + following + 1) / 2 * STEP, gain
    return best


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, both scores and ``kept`` of every row of ``docs``.

    A row is kept if it passes the plain rules and neither score is above its threshold; both
    together reject at most ``MAX_GOOD_LOSS`` of the good labelled rows.
    Null and empty texts have statistics 0 and fail; null ids and repeated rows are judged
    like others, but null ids have no label.
    """
    measured = written(with_statistics(docs, id_col, text_col), "statistics")
    scored = written(with_isolation(measured, fit(measured, labels)), "isolation")
    limits: dict[str, float] = {}
    for name in MEASURES:
        limits[name] = threshold(scored, labels, score=name, limits=limits)
    failed = scored.withColumn("base_failed", base_failed())
    usual = F.lit(True)
    for name, limit in limits.items():
        usual = usual & (F.col(name) <= limit)
    return failed.withColumn("kept", ~F.col("base_failed") & usual)
