"""Join of texts whose word n-grams have a Jaccard similarity above a threshold, by MinHash banding.

The number of bands and rows is chosen for a target recall at the threshold.  Texts that
share a band are shuffled together, but no pairs are made there: every text of a band's bucket
hangs on its lowest one, and the connected texts form clusters of candidates.  Within a
cluster all pairs are verified on the full n-gram sets, in blocks, so that a task holds a
bounded number of texts however large the cluster is; only counts and a spanning
forest of the links leave a block.
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
from tidewatch.llm.components import components, local_roots
from tidewatch.workspace import written

NGRAM = 5
THRESHOLD = 0.8
#: Probability that a pair exactly at the threshold shares a band, and the hashes spent on it.
RECALL = 0.9999
MAX_HASHES = 128
#: A block of verification holds about so many texts, and so many characters, of either side.
BLOCK_TEXTS = 256
BLOCK_CHARACTERS = 4_000_000

CACHE_WORDS = 300_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows per band, hence the fewest candidates, that reach ``recall`` in ``max_hashes``."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"{max_hashes} hashes cannot reach a recall of {recall} at {threshold}")
    return best


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_word_hash = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], n: int = NGRAM) -> np.ndarray:
    """The sorted distinct hashes of all n-grams; a shorter text is one n-gram, an empty one has none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.array(list(map(_word_hash.__getitem__, words)), np.uint64)
    width = min(n, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total = _mixed(total + hashed[k : k + count])
    return np.unique(total)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the minima of ``bands * rows`` hash functions."""
    draws = np.random.RandomState(20)
    count = bands * rows
    factor = (draws.randint(0, 2**32, count, np.uint64) | np.uint64(1)).astype(np.uint32)
    offset = draws.randint(0, 2**32, count, np.uint64).astype(np.uint32)
    values = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 2**32 - 1, np.uint32)
    for start in range(0, len(values), 1024):
        hashed = values[start : start + 1024, None] * factor + offset
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, hashed.min(axis=0), out=least)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, k])
    return total.view(np.int64)


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, digest of the words, length and band hashes of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, digests, sizes, signed = [], [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if words and at is not None:
                    ids.append(at)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sizes.append(sum(map(len, words)) + len(words))
                    signed.append(signature(shingles(words, n), bands, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(signed, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "size", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, digest binary, size long, bands array<long>")


def _overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two texts share."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count > 1
    held = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[held]], owner[held]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(grams), len(grams)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        held = np.zeros((len(grams), 4096), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        both += held @ held.T
    return both.astype(np.int64)


def _verified(rows: pd.DataFrame, n: int, threshold: float) -> Iterator[tuple]:
    """(text, texts linked, lowest text of its links) for one block of one cluster."""
    rows = rows.sort_values(["doc_id", "digest"], kind="stable")
    ids, copies, tile = (rows[c].to_numpy() for c in ("doc_id", "copies", "tile"))
    grams = [shingles(words_of(text), n) for text in rows["text"]]
    if len(grams) < 2:
        return
    sizes = np.array([len(g) for g in grams])
    both = _overlaps(grams)
    links = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    links &= ids[:, None] != ids[None, :]
    if rows["left"].iloc[0] != rows["right"].iloc[0]:
        links &= tile[:, None] != tile[None, :]  # pairs within a tile belong to its own block
    counts = links @ copies
    left, right = np.nonzero(np.triu(links))
    root = local_roots(len(ids), left, right)
    for at in np.flatnonzero(counts):
        yield int(ids[at]), int(counts[at]), int(ids[root[at]])


def similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    block_texts: int = BLOCK_TEXTS,
    block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``n_rows`` of every document.

    Two documents are linked if the sets of their word n-grams have a Jaccard similarity of
    ``threshold`` or more; a text of fewer than n words is one n-gram.  ``n_links`` counts the
    linked documents, copies included; ``class_id`` is the smallest id reachable by links.
    Links between different texts go through banding, which finds a pair at the threshold
    with probability ``recall`` and closer ones more surely; copies, equal word for word, are
    combined first and never expanded.

    Null and empty texts link with nothing.  A row without an id is one row of the result
    with null class and no links.  Rows that repeat an id are one document with ``n_rows`` > 1:
    rows with the same words count once, different texts bring their links together.
    Only the two columns are read.
    """
    spark = docs.sparkSession
    ship(spark)
    bands, rows = bands_and_rows(threshold, recall, max_hashes)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_signatures(texts, n, bands, rows), "signatures")
    # One document stands for all with the same words.
    by_words = signed.select("doc_id", "digest").distinct().groupBy("digest")
    groups = written(by_words.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    own = (signed["digest"] == groups["digest"]) & (signed["doc_id"] == groups["rep"])
    reps = signed.join(groups, own).select("rep", groups["digest"], "size", "copies", "bands")
    reps = written(reps.dropDuplicates(["rep", "digest"]), "representatives")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    lowest = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    star = banded.join(lowest, "band").filter("rep > low")
    clusters = components(star.select(F.col("rep").alias("node"), F.col("low").alias("root")))
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())

    candidates = members.join(reps.drop("bands"), members["node"] == reps["rep"]).drop("node")
    candidates = written(candidates, "candidates")
    weights = candidates.groupBy("root").agg(F.count("*").alias("texts"), F.sum("size").alias("characters"))
    tiles = F.ceil(F.greatest(F.col("texts") / block_texts, F.col("characters") / block_characters)).cast("long")
    weights = written(weights.withColumn("tiles", tiles), "clusters")
    small = weights.filter("tiles = 1").agg(F.sum("characters"), F.sum("texts")).first()
    cells = max(1, -(-(small[0] or 0) // block_characters), -(-(small[1] or 0) // (8 * block_texts)))
    placed = candidates.join(weights.select("root", "tiles"), "root")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("rep", "digest"), F.col("tiles")))
    # A text of a cluster with T tiles goes to the T blocks of two tiles that hold its own.
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(
        F.least(F.col("tile"), t).alias("left"), F.greatest(F.col("tile"), t).alias("right")))
    blocks = placed.select(
        "rep", "digest", "copies", "root", "tile",
        F.when(F.col("tiles") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(cells))).alias("cell"),
        (F.col("tiles") > 1).alias("alone"),
        F.explode(others).alias("block"),
    )
    # Both sides grow with the documents: a shuffle at every size, never a broadcast.
    pairs = texts.join(blocks.hint("merge"), texts["doc_id"] == blocks["rep"]).select(
        "doc_id", "text", "digest", "copies", "root", "tile", "cell", "alone", "block.left", "block.right"
    )

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        own = [xxhash.xxh3_128_digest(b" ".join(words_of(t))) == d for t, d in zip(frame["text"], frame["digest"])]
        frame = frame[own].drop_duplicates(["doc_id", "digest"])
        found = [row for _, one in frame.groupby("root") for row in _verified(one, n, threshold)]
        return pd.DataFrame(found, columns=["doc_id", "links", "low"]).astype("int64")

    links = pairs.groupBy("alone", "cell", "left", "right").applyInPandas(verify, "doc_id long, links long, low long")
    links = written(links, "links")
    counts = links.groupBy("doc_id").agg(F.sum("links").alias("links"))
    # An id with several texts ties the classes of its texts together.
    several = signed.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    tied = signed.select("doc_id", "digest").join(several.select("doc_id"), "doc_id").join(groups, "digest")
    found = links.select(F.col("doc_id").alias("node"), F.col("low").alias("root"))
    classes = components(found.unionByName(tied.select(F.col("doc_id").alias("node"), F.col("rep").alias("root"))))
    reps_found = groups.join(counts, groups["rep"] == counts["doc_id"], "left").drop("doc_id")
    reps_found = reps_found.join(classes, reps_found["rep"] == classes["node"], "left")
    reps_found = reps_found.select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("class")
    )
    return _by_document(texts, signed, reps_found)


def _by_document(texts: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    named = signed.select("doc_id", "digest").join(found, "digest").select("doc_id", "digest", "links", "class")
    every = texts.select("doc_id").withColumn("rows", F.lit(1)).filter("doc_id is not null")
    every = every.select("doc_id", "rows", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("links"),
                         F.col("doc_id").alias("class"))
    named = named.select("doc_id", F.lit(0).alias("rows"), "digest", "links", "class")
    per_text = every.unionByName(named).groupBy("doc_id", "digest").agg(
        F.sum("rows").alias("rows"), F.max("links").alias("links"), F.min("class").alias("class"))
    per_id = per_text.groupBy("doc_id").agg(
        F.min("class").alias("class_id"), F.sum("links").cast("long").alias("n_links"), F.sum("rows").cast("long").alias("n_rows"))
    without = texts.filter("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_rows"))
    return per_id.unionByName(without)


def one_of_each_class(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, in the columns of ``docs``.

    Of rows that repeat an id one stays, the lowest in the order of all columns; rows without
    an id stay.
    """
    kept = found.filter("doc_id = class_id").select(F.col("doc_id").alias("_kept"), F.col("n_rows").alias("_rows"))
    joined = docs.join(kept.hint("merge"), docs[id_col].cast("long") == kept["_kept"])
    once = joined.filter("_rows = 1").select(*[docs[c] for c in docs.columns])
    again = joined.filter("_rows > 1").select("_kept", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    again = again.groupBy("_kept").agg(F.min("_row").alias("_row")).select("_row.*")
    return once.unionByName(again).unionByName(docs.filter(F.col(id_col).isNull()))
