import hashlib
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import align


def read(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


A_FILE, B_FILE = read("byte_bpe_50k.json"), read("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox don't jump.", "", None, "x", "  two  blanks\tand\n\n lines ", "Überraschung für naïve Leser, 12345 mal",
    "日本語のテキスト", "emoji 🙂🙂 and é", "a▁b", "\x00nul", "<|endoftext|> stays plain", "</s> <unk> <0x41>", "The quick brown fox don't jump.",
    "ﬁ ligature ½", "   ", "\n", "word " * 3000, "x" * 20000, "ñandú ciónñ osllra", "Ⅷ ᲊ new letters",
]


@pytest.fixture(scope="module")
def sides():
    return align._tokenizers(A_FILE, B_FILE)


def model(texts):
    """The contract, token by token, with the plain libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(A_FILE.decode())
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_proto=B_FILE)
    own = align._byte_alphabet()
    rows, links = [], []
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False) if text else None
        a = [] if a is None else list(zip(a.ids, [bytes(own[c] for c in t) for t in a.tokens]))
        b = pieces.encode(text) if text else []
        names = [pieces.id_to_piece(i) for i in b]
        b = [(i, bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode()) for i, n in zip(b, names)]
        if not text or not (b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b)):
            a, b = [], []
        spans = [[], []]
        for side, out in ((a, spans[0]), (b, spans[1])):
            at = 0
            for i, token in side:
                out.append((at, at + len(token), i))
                at += len(token)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in spans))
            start = end
        linked = Counter()
        j = 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    linked[i, spans[1][j][2]] += 1
                j += 1
        links.append(linked)
        rows.append([len(a), len(b), len(groups), sum(linked.values()), ";".join(groups)])
    count = Counter(pair for linked in links for pair in linked)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for row, linked in zip(rows, links):
        spelled = row.pop()
        digest = hashlib.sha256(spelled.encode()).hexdigest() if row[0] else ""
        row += [sum(n for p, n in linked.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in linked.items()), digest]
    return [tuple(row) for row in rows]


def test_equal_to_model(spark):
    rows = [(i, t, "other", "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row string").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in align.linked(docs, A_FILE, B_FILE).collect()}
    assert [found[i] for i in range(len(TEXTS))] == model(TEXTS)


@pytest.mark.parametrize("hot_pairs", [1, 7, 10**9])
def test_common_and_rare_pairs_give_the_same(spark, hot_pairs):
    texts = ["the cat sat on the mat", "the dog sat", "a cat", "ein Hund saß"] * 3
    docs = spark.createDataFrame([(None if i < 2 else i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = sorted(tuple(r)[1:] for r in align.linked(docs, A_FILE, B_FILE, hot_pairs=hot_pairs).collect())
    assert found == sorted(model(texts))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.linked(docs, A_FILE, B_FILE).collect() == []
    assert align.aligned(docs, A_FILE, B_FILE).collect() == []


def test_groups_give_back_the_text(spark, sides):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in align.aligned(docs, A_FILE, B_FILE).collect():
        a_from = b_from = 0
        spelled = b""
        for a_to, b_to in zip(row["a_cuts"], row["b_cuts"]):
            left = b"".join(sides[0].bytes[i] for i in row["a_ids"][a_from:a_to])
            assert left == b"".join(sides[1].bytes[i] for i in row["b_ids"][b_from:b_to]) != b""
            spelled, a_from, b_from = spelled + left, a_to, b_to
        assert (a_from, b_from) == (len(row["a_ids"]), len(row["b_ids"]))
        assert spelled in (b"", (" " + (TEXTS[row["doc_id"]] or "")).encode())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé 's\t\n\r\x0b12.-ÿ日  ª'tLl"), max_size=30), max_size=4))
def test_remembered_ids_equal_the_library(texts):
    side = align._tokenizers(A_FILE, B_FILE)[0]
    spaced = [" " + t for t in texts]
    assert side.encode(spaced) == [e.ids for e in side.library.encode_batch(spaced, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), max_size=5))
def test_cuts_are_the_common_ends(texts):
    a_ends, b_ends, bounds, base = [], [], [0], 0
    for a, b in texts:
        a_ends += [base + e for e in sorted(a | {61})]
        b_ends += [base + e for e in sorted(b | {61})]
        bounds.append(len(a_ends))
        base += 61
    a_ends, b_ends = np.array(a_ends, np.int64), np.array(b_ends, np.int64)
    want = np.flatnonzero(np.isin(a_ends, b_ends))
    assert align.shared_cuts(a_ends, b_ends, np.array(bounds)).tolist() == want.tolist()


def test_long_stretch_without_cuts_is_quick():
    n = 1_000_000
    odd, even = np.arange(1, 2 * n, 2), np.append(np.arange(2, 2 * n - 1, 2), 2 * n - 1)
    start = time.perf_counter()
    assert align.shared_cuts(odd, even, np.array([0, n])).tolist() == [n - 1]
    assert time.perf_counter() - start < 5
