"""Byte-level BPE encoding and decoding by a file of ranks.

Pre-tokens are merged with a queue of ranks: one bucket of positions per rank, and a bitmap
in levels of 64 bits that tells which buckets hold something, so that the lowest rank is
found with a find-first-set on each level.  Positions form a linked list; entries that a
neighbouring merge has made stale are skipped when they come up.  n bytes take O(n log n),
also as one pre-token of a megabyte.  All pre-tokens of a block of texts that a worker does
not know yet share one queue: no pair reaches over the end of a pre-token, so they don't
affect each other.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.common import ship, small_batches

#: Pre-tokens whose ids a worker remembers, and the longest that it does (in characters).
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64
#: Texts are taken together up to this many characters; a longer text is taken alone.
BLOCK_CHARACTERS = 1_000_000

#: Characters on which the faster pattern and the general one agree: printable ASCII with
#: its white space, and the Latin letters up to U+024F.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_ELSEWHERE = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token to rank from the lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class RankQueue:
    """Positions by rank."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * max(1, ranks))
            if ranks <= 1:
                break

    def open(self, rank: int, positions: list[int]) -> None:
        """Give an empty bucket its positions."""
        self.buckets[rank] = positions
        for words in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            held = words[word]
            words[word] = held | bit
            if held:
                return
            rank = word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def lowest(self) -> int:
        """The lowest rank that holds a position, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for words in reversed(self.levels):
            held = words[at]
            at = (at << 6) | ((held & -held).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """Empty the bucket of ``rank``; its positions from left to right."""
        bucket = self.buckets.pop(rank)
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                break
            rank = word
        bucket.sort()
        return bucket


class Encoder:
    """Encodes and decodes with one set of ranks and one pattern of pre-tokens.

    Every single byte must have a rank.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.token = {rank: token for token, rank in ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: The rank of a token by the ranks of its two parts.
        self.joined = {
            ranks[token[:cut]] * self.size + ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.bytes_joined = np.array(
            [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64
        )
        self.general = regex.compile(pattern)
        latin = pattern.replace(r" ?\p{L}+", f" ?[{_LATIN}]+").replace(r" ?\p{N}+", " ?[0-9]+")
        latin = latin.replace(r"\p{L}", _LATIN).replace(r"\p{N}", "0-9")
        self.latin = None if r"\p" in latin else re.compile(latin)
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token, none of them empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum([len(piece) for piece in pieces])
        joined, size, queue = self.joined.get, self.size, self.queue

        follows = np.arange(1, len(data) + 1)
        follows[ends - 1] = -1  # the last part of a pre-token has no next
        leads = np.arange(-1, len(data) - 1)
        leads[ends[:-1]] = -1
        first = np.full(len(data), -1, np.int64)  # the rank of each part joined with the next
        first[:-1] = self.bytes_joined[data[:-1] * 256 + data[1:]]
        first[ends - 1] = -1
        waiting = np.flatnonzero(first >= 0)
        waiting = waiting[np.argsort(first[waiting], kind="stable")]
        groups, starts = np.unique(first[waiting], return_index=True)
        for rank, positions in zip(groups.tolist(), np.split(waiting, starts[1:])):
            queue.open(rank, positions.tolist())

        ids, pair, after, before = self.byte[data].tolist(), first.tolist(), follows.tolist(), leads.tolist()
        while (rank := queue.lowest()) >= 0:
            bucket = queue.take(rank)
            for done, at in enumerate(bucket, 1):
                if pair[at] != rank:
                    continue  # stale
                gone = after[at]
                following = after[gone]
                ids[at], ids[gone], pair[gone], after[at] = rank, -1, -1, following
                least = size
                if following >= 0:
                    before[following] = at
                    found = pair[at] = joined(rank * size + ids[following], -1)
                    if found >= 0:
                        queue.push(found, at)
                        least = found
                else:
                    pair[at] = -1
                left = before[at]
                if left >= 0:
                    found = pair[left] = joined(ids[left] * size + rank, -1)
                    if found >= 0:
                        queue.push(found, left)
                        least = min(least, found)
                if least < rank:  # a lower rank has come up, which goes before the rest
                    if done < len(bucket):
                        queue.open(rank, bucket[done:])
                    break
        kept = np.array(ids, np.int64)
        alive = kept >= 0
        stops = np.cumsum(alive)[ends - 1]
        packed = kept[alive].astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of pre-tokens; what a later text may repeat is remembered."""
        found, rest = {}, []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.packed.get(data)
            if whole is None:
                rest.append((piece, data))
            else:
                found[piece] = whole
        if rest:
            found.update(zip([p for p, _ in rest], self.merged([d for _, d in rest])))
        if len(self.known) + len(found) > CACHE_ENTRIES:
            self.known.clear()
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= CACHE_LENGTH)
        return found

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null."""
        start = 0
        while start < len(texts):
            stop, characters = start, 0
            while stop < len(texts) and (stop == start or characters < BLOCK_CHARACTERS):
                characters += len(texts[stop] or "")
                stop += 1
            split = [self._split(text) for text in texts[start:stop]]
            known = self.known
            missing = {piece for pieces in split for piece in pieces if piece not in known}
            held = dict(known) if len(known) + len(missing) > CACHE_ENTRIES else known
            found = self._learn(missing)
            for pieces in split:
                yield b"".join([held.get(p) or found[p] for p in pieces])
            start = stop

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        pattern = self.general if self.latin is None or _ELSEWHERE.search(text) else self.latin
        return pattern.findall(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per worker process for each file and pattern."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def encoded(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (binary) of every whole text.

    A null text is encoded as an empty one: no ids and no bytes.  Rows with the same id
    stay apart, a null id is kept, other columns are not read.  ``ranks`` is the content of
    a rank file, a vocabulary of fixed size, which the driver hands to every executor.
    """
    return _mapped(docs, ranks, pattern, id_col, text_col, False, "ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text.

    The ids and the decoded bytes are made and dropped again row by row; only their
    digests leave a task.  Nulls and repeated rows as in :func:`encoded`.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, ranks, pattern, id_col, text_col, True, schema)


def _digest_batch(ids: pa.Array, packed: list[bytes], plain: list[bytes]) -> list[pa.Array]:
    hexes = [[hashlib.sha256(x).hexdigest() for x in side] for side in (packed, plain)]
    return [ids, pa.array([len(x) // 4 for x in packed], pa.int64()), *(pa.array(x, pa.string()) for x in hexes)]


def _content_batch(ids: pa.Array, packed: list[bytes], plain: list[bytes]) -> list[pa.Array]:
    numbers = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
    return [ids, pa.array(numbers, pa.list_(pa.int32())), pa.array(plain, pa.binary())]


def _mapped(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str, text_col: str, digest: bool, schema: str
) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    file = spark.sparkContext.broadcast(ranks)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {schema}"
    names = [id_col, *(part.split()[0] for part in schema.split(", ")[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file.value, pattern)
        for batch in small_batches(batches):
            packed = list(bpe.encode(batch.column(1).to_pylist()))
            plain = [bpe.decode(ids) for ids in packed]
            made = (_digest_batch if digest else _content_batch)(batch.column(0), packed, plain)
            yield pa.RecordBatch.from_arrays(made, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
