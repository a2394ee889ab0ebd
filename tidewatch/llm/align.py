"""Alignment of two tokenizers' tokens over the same text.

Both tokenizers cut a text's bytes into tokens.  Where an end of the one is an end of the other,
the text can be cut for both; what lies between two neighbouring shared cuts is a group, the least piece
that holds whole tokens of either side.  The cuts are found by divide and conquer: in each interval
the shared end nearest the middle is located by bisecting the other side's ends, then both halves
follow; an interval without a shared end inside is a leaf, a group.  All intervals of a level,
of all texts of a block, are worked off together.

What a pair of ids links to over the corpus is counted by documents.  Of pairs, few are
common and most are rare, so the counts are joined in two parts: those of so many documents that
only ``HOT_PAIRS`` of them can exist are broadcast, the rest is shuffled, and no key of it is hot.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, small_batches
from tidewatch.workspace import written

#: Texts are taken together up to this many characters; a longer text is taken alone.
BLOCK_CHARACTERS = 400_000
#: Pre-tokens whose ids a worker remembers, and the longest that it does (in characters).
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64
#: Pairs whose counts are broadcast, at most.
HOT_PAIRS = 100_000

#: Characters on which all implementations of the pre-token pattern agree: printable ASCII with
#: its white space, and the Latin letters up to U+024F.  Other texts are split by the library itself.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_ELSEWHERE = re.compile(rf"[^\t-\r\x20-\x7e{_LATIN}]")
_PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"
)

#: A pre-token that ends where the next blank begins.
_SPACED = re.compile(rf" [{_LATIN}]+").fullmatch


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte.

    Bytes that are visible characters of Latin-1 stand for themselves, the others follow from U+0100 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(0x100 + k): b for k, b in enumerate(hidden)}}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library, without special tokens.

    ``split`` tells that the file's pre-tokens are those of the usual byte-level pattern; then ids are
    remembered per pre-token, as each is encoded on its own.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.library.encode_special_tokens = True
        described = json.loads(data)
        before = described.get("pre_tokenizer") or {}
        self.split = (
            described.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        )
        own = _byte_alphabet()
        self.bytes: list[bytes] = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, at in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes[at] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode("utf-8")
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: Sequence[str]) -> list[list[int] | None]:
        """Ids of each text; None where their bytes aren't the text's, which is tested once per pre-token."""
        parts = [_PRE_TOKEN.findall(text) if self.split and not _ELSEWHERE.search(text) else [text] for text in texts]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        missing = list(set().union(*parts).difference(known))
        self._learn([part for part in missing if _SPACED(part)])
        others = [part for part in missing if part not in known]
        for part, found in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False)):
            known[part] = found.ids
        odd = {part for part in missing if b"".join(map(self.bytes.__getitem__, known[part])) != part.encode("utf-8")}
        ids = [
            None if odd and not odd.isdisjoint(found) else list(chain.from_iterable(map(known.__getitem__, found))) for found in parts
        ]
        for part in missing:  # what is long or doesn't give back its bytes isn't remembered
            if len(part) > CACHE_LENGTH or part in odd:
                del known[part]
        return ids


    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of words that begin with a blank: in a row they are the same pre-tokens as apart."""
        if not parts:
            return
        ids = self.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids
        reached = np.cumsum(_widths(self)[np.array(ids, np.int64)])
        ends = np.cumsum([len(part.encode("utf-8")) for part in parts])
        cuts = np.searchsorted(reached, ends)
        if cuts[-1] < len(reached) and (reached[cuts] == ends).all():
            cuts = [0, *(cuts + 1).tolist()]
            self.known.update((part, ids[i:j]) for part, i, j in zip(parts, cuts, cuts[1:]))


class Pieces:
    """A ``sentencepiece`` model; it puts a space before a text by itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = self.library.id_to_piece(list(range(self.library.get_piece_size())))
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.library.is_byte(at) else name.replace("▁", " ").encode("utf-8")
            for at, name in enumerate(names)
        ]

    def encode(self, texts: Sequence[str]) -> list[list[int] | None]:
        """Ids of a space and each text; None where their bytes aren't those of the space and the text."""
        every = self.library.encode(list(texts), num_threads=1)
        token = self.bytes.__getitem__
        return [ids if b"".join(map(token, ids)) == b" " + text.encode("utf-8") else None for text, ids in zip(texts, every)]


@lru_cache(maxsize=2)
def _tokenizers(a_file: bytes, b_file: bytes) -> tuple[ByteLevel, Pieces]:
    """Loaded once per worker."""
    return ByteLevel(a_file), Pieces(b_file)


def _nearest_shared(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each range ``low <= i < high`` the i nearest its middle whose ``a_ends[i]`` is in ``b_ends``, or -1.

    The search leaves the middle in both directions, in strides that double, so it costs as much as
    the way to the found end.
    """
    found = np.full(len(low), -1, np.int64)
    middle = (low + high) >> 1
    active = np.flatnonzero(low < high)
    near, far = 0, 1
    while len(active):
        steps = np.arange(near, far)
        at = middle[active][:, None] + np.concatenate([-steps, steps[steps > 0]])[None, :]
        inside = (at >= low[active][:, None]) & (at < high[active][:, None])
        ends = a_ends[np.where(inside, at, 0)]
        meets = np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)
        hit = inside & (b_ends[meets] == ends)
        away = np.where(hit, np.abs(at - middle[active][:, None]), far)
        best = away.argmin(axis=1)
        row = np.arange(len(active))
        got = hit[row, best]
        found[active[got]] = at[row, best][got]
        rest = active[~got]
        active = rest[(middle[rest] - far >= low[rest]) | (middle[rest] + far < high[rest])]
        # A few ranges may be long: their strides grow, but a step of all together stays bounded.
        near, far = far, min(far * 2, far + max(1, 4_000_000 // max(1, len(active))))
    return found


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray) -> np.ndarray:
    """The sorted indices i of tokens with ``a_ends[i]`` in ``b_ends``, by divide and conquer.

    ``a_ends`` and ``b_ends`` rise strictly.  ``a_bounds`` cuts the tokens into texts: text t has the tokens
    ``a_bounds[t]`` to ``a_bounds[t + 1] - 1``, and its last end is shared.
    """
    filled = a_bounds[1:] > a_bounds[:-1]
    low, last = a_bounds[:-1][filled], a_bounds[1:][filled] - 1
    cuts = [last]
    high = last
    while len(low):
        cut = _nearest_shared(a_ends, b_ends, low, high)
        split = cut >= 0  # the others are leaves
        cut, low, high = cut[split], low[split], high[split]
        cuts.append(cut)
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut, high])
        wide = low < high
        low, high = low[wide], high[wide]
    return np.sort(np.concatenate(cuts))


class Block:
    """Some texts with the tokens of both sides, and where they can be cut.

    ``a`` and ``b`` hold the ids of all texts, ``a_bounds`` and ``b_bounds`` tell where each text starts in them,
    ``a_cuts`` and ``b_cuts`` count the tokens before the end of each group.  ``cut_bounds`` tells which groups
    are of which text.
    """

    def __init__(self, texts: Sequence[str | None], a_side: ByteLevel, b_side: Pieces):
        asked = [k for k, text in enumerate(texts) if text]
        a_ids: list[Sequence[int]] = [()] * len(texts)
        b_ids: list[Sequence[int]] = [()] * len(texts)
        own = [texts[k] for k in asked]
        for k, a, b in zip(asked, a_side.encode([" " + text for text in own]), b_side.encode(own)):
            if a is not None and b is not None:
                a_ids[k], b_ids[k] = a, b
        self.a, self.a_bounds, a_ends = _joined(a_ids, _widths(a_side))
        self.b, self.b_bounds, b_ends = _joined(b_ids, _widths(b_side))
        cuts = shared_cuts(a_ends, b_ends, self.a_bounds)
        self.a_cuts = cuts + 1
        self.b_cuts = np.searchsorted(b_ends, a_ends[cuts]) + 1
        self.cut_bounds = np.searchsorted(self.a_cuts, self.a_bounds, "right")
        self.a_ends, self.b_ends = a_ends, b_ends

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair ``a << 32 | b`` and links of it in the text, sorted; each overlap of two tokens is a link.

        Every overlap begins where one of its tokens begins, and at a shared cut both do.
        """
        if not len(self.a):
            return (np.zeros(0, np.int64),) * 3
        a_starts = np.concatenate([[0], self.a_ends[:-1]])
        b_starts = np.concatenate([[0], self.b_ends[:-1]])
        inner = np.ones(len(self.b), bool)
        inner[0] = False
        inner[self.b_cuts[:-1]] = False  # starts at a cut, counted with its A token
        left = np.concatenate([np.arange(len(self.a)), np.searchsorted(self.a_ends, b_starts[inner], "right")])
        right = np.concatenate([np.searchsorted(self.b_ends, a_starts, "right"), np.flatnonzero(inner)])
        text = np.searchsorted(self.a_bounds, left, "right") - 1
        # Sorted as one number where text and ids fit into 63 bits, which they do below 2 ** 23 texts.
        a_bits, b_bits = (int(side.max()).bit_length() for side in (self.a, self.b))
        key = (text << (a_bits + b_bits)) | (self.a[left] << b_bits) | self.b[right]
        key, count = np.unique(key, return_counts=True)
        a = (key >> b_bits) & ((1 << a_bits) - 1)
        return key >> (a_bits + b_bits), (a << 32) | (key & ((1 << b_bits) - 1)), count

    def spelled(self, a_words: Sequence[bytes], b_words: Sequence[bytes]) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``, from the decimal words of the ids."""
        size = max(len(a_words), len(b_words))
        words = [w + s for side, seps in ((a_words, b",|"), (b_words, b",;")) for s in (seps[:1], seps[1:])
                 for w in [*side, *[b""] * (size - len(side))]]
        a_code, b_code = self.a.copy(), self.b + 2 * size
        a_code[self.a_cuts - 1] += size
        b_code[self.b_cuts - 1] += size
        # In a group all A tokens come first, then its B tokens.
        a_before, b_before = np.concatenate([[0], self.a_cuts[:-1]]), np.concatenate([[0], self.b_cuts[:-1]])
        placed = np.empty(len(self.a) + len(self.b), np.int64)
        placed[np.arange(len(self.a)) + np.repeat(b_before, self.a_cuts - a_before)] = a_code
        placed[np.arange(len(self.b)) + np.repeat(self.a_cuts, self.b_cuts - b_before)] = b_code
        every = placed.tolist()
        bounds = (self.a_bounds + self.b_bounds).tolist()
        return [b"".join(map(words.__getitem__, every[i:j]))[:-1] for i, j in zip(bounds, bounds[1:])]


def _widths(side: ByteLevel | Pieces) -> np.ndarray:
    if not hasattr(side, "widths"):
        side.widths = np.array([len(token) for token in side.bytes], np.int64)
    return side.widths


def _joined(ids: Sequence[Sequence[int]], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in one array, where each text starts in it, and the ends of all tokens in bytes."""
    bounds = np.concatenate([[0], np.cumsum([len(one) for one in ids], dtype=np.int64)]).astype(np.int64)
    flat = np.array(list(chain.from_iterable(ids)), np.int64)
    return flat, bounds, np.cumsum(widths[flat])


def _blocks(batches: Iterator[pa.RecordBatch], a_file: bytes, b_file: bytes) -> Iterator[tuple[pa.RecordBatch, Block]]:
    a_side, b_side = _tokenizers(a_file, b_file)
    for batch in small_batches(batches):
        texts = batch.column("text").to_pylist()
        start = size = 0
        for at, text in enumerate(texts):
            length = len(text or "")
            if at > start and size + length > BLOCK_CHARACTERS:
                yield batch.slice(start, at - start), Block(texts[start:at], a_side, b_side)
                start, size = at, 0
            size += length
        if len(texts) > start:
            yield batch.slice(start), Block(texts[start:], a_side, b_side)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_cuts, b_cuts`` per row: the tokens of a space and the text, and its groups.

    Group g (from 0) holds ``a_ids[a_cuts[g - 1]:a_cuts[g]]`` and ``b_ids[b_cuts[g - 1]:b_cuts[g]]``.  Null and empty
    texts, and texts whose tokens of either side don't give back their bytes, have no tokens.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, a_file, b_file):
            groups = np.diff(block.cut_bounds)
            a_before, b_before = np.repeat(block.a_bounds[:-1], groups), np.repeat(block.b_bounds[:-1], groups)
            columns = [
                batch.column("doc_id"),
                _lists(block.a, block.a_bounds, pa.int32()), _lists(block.b, block.b_bounds, pa.int32()),
                _lists(block.a_cuts - a_before, block.cut_bounds, pa.int32()),
                _lists(block.b_cuts - b_before, block.cut_bounds, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def _described(docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str, text_col: str) -> DataFrame:
    """Counts, digest, and the distinct pairs with their links, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = _tokenizers(a_file, b_file)
        a_words, b_words = ([b"%d" % at for at in range(len(side.bytes))] for side in (a_side, b_side))
        for batch, block in _blocks(batches, a_file, b_file):
            n_a, n_b, n_groups = (np.diff(x) for x in (block.a_bounds, block.b_bounds, block.cut_bounds))
            text, pair, links = block.pairs()
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            digests = [hashlib.sha256(one).hexdigest() if one else "" for one in block.spelled(a_words, b_words)]
            columns = [
                batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                pa.array(np.where(n_groups > 0, n_a + n_b - n_groups, 0)), pa.array(digests, pa.string()),
                _lists(pair, bounds, pa.int64()), _lists(links, bounds, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, links array<int>")


def pair_counts(described: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: in how many rows an id pair is linked, and whether no pair of its A id is in more."""
    counts = described.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def linked(
    docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """Alignment of every row in figures: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a_file`` is a byte-level BPE of the ``tokenizers`` library, ``b_file`` a ``sentencepiece`` model.  Every row
    is a document of its own, also if its id is null or repeated; rows without tokens (see :func:`aligned`)
    have zeros and an empty digest.  Only the two columns are read.
    """
    ship(docs.sparkSession)
    # Numbered as they are written, so that the numbers stay what they are.
    rows = written(_described(docs, a_file, b_file, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    # More than ``hot_pairs`` pairs can't each be in more than ``total / hot_pairs`` rows.
    hot = F.col("n_docs") > total / hot_pairs
    each = rows.select("row", F.explode_outer(F.arrays_zip("pairs", "links")).alias("_p"))
    each = each.select("row", F.col("_p.pairs").alias("pair"), F.col("_p.links").alias("links"))
    common, rare = counts.filter(hot), counts.filter(~hot)
    parts = [each.join(F.broadcast(common), "pair")]
    if not rare.isEmpty():
        parts.append(each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair"))
    sums = [
        part.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("n_docs")).alias("count_sum"),
        )
        for part in parts
    ]
    every = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    every = every.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "links").join(every, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
