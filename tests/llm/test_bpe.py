import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import bpe
from tidewatch.llm.queries import rank_file

FILE = rank_file()
OURS = bpe.encoder(FILE, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})


def ids(text):
    return np.frombuffer(next(OURS.encode([text])), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab th einAr1 \n'sé漢!|")))
def test_same_as_the_library(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(next(OURS.encode([text]))) == text.encode()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh", "ththeinatorsed", "=", " ", "é漢"])
def test_very_long_pre_tokens(alphabet):
    text = "".join(random.Random(3).choices(alphabet, k=30_000))
    assert ids(text) == THEIRS.encode_ordinary(text)


def test_special_strings_are_text_and_the_cache_may_be_small(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "BLOCK_CHARACTERS", 50)
    fresh = bpe.Encoder(bpe.read_ranks(FILE), public_tokenizers.PATTERN)
    texts = ["<|endoftext|> and more", None, "", "sothe onward thereof " * 9, "qzx wvu kjq " * 30, "a"] * 3
    for text, packed in zip(texts, fresh.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == THEIRS.encode_ordinary(text or "")


def test_order_of_ranks_decides():
    """A lower rank that a merge brings up goes before the rest of its bucket."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bab", b"caba", b"cab"]
    ranks = {token: rank for rank, token in enumerate(tokens)}
    ours, theirs = bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k in range(300):
        text = "".join(random.Random(k).choices("abc", k=random.Random(k).randrange(1, 30)))
        assert np.frombuffer(next(ours.encode([text])), "<u4").tolist() == theirs.encode_ordinary(text)


def test_queue():
    rng = random.Random(1)
    queue, held = bpe.RankQueue(70_000), {}
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            rank, at = rng.randrange(70_000), rng.randrange(1000)
            queue.push(rank, at)
            held.setdefault(rank, []).append(at)
        else:
            low = min(held)
            assert queue.lowest() == low and queue.take(low) == sorted(held.pop(low))
    while held:
        assert queue.lowest() == min(held)
        held.pop(min(held)), queue.take(queue.lowest())
    assert queue.lowest() == -1


def test_tables(spark):
    rows = [(1, "the words", "x"), (1, "the words", "x"), (None, None, "x"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.digests(docs, FILE, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (None, 0), (3, 0)]
    assert got[2].ids_sha256 == got[3].decoded_sha256 == empty
    whole = bpe.encoded(docs, FILE, public_tokenizers.PATTERN).collect()
    assert whole[0].ids == THEIRS.encode_ordinary("the words") and bytes(whole[0].decoded) == b"the words"
    assert bpe.digests(docs.filter("false"), FILE, public_tokenizers.PATTERN).collect() == []


def test_query_same_as_the_library(spark, sf_dir):
    from tidewatch.llm.common import table
    from tidewatch.llm.queries import op5_byte_bpe

    got = {r.doc_id: r for r in op5_byte_bpe(spark, sf_dir).collect()}
    for row in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        want = THEIRS.encode_ordinary(row.text or "")
        r = got[row.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
