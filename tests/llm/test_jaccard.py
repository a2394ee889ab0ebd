import random

import numpy as np
import pytest

from tests.llm.helpers import classes, grams
from tidewatch.llm import jaccard

SCHEMA = "doc_id bigint, text string, rep string, links string"


def model(rows, threshold=0.8):
    sets = {}
    for i, text, *_ in rows:
        sets.setdefault(i, []).append(grams(text))
    links = [
        (a, b) for a in sets for b in sets if a != b
        and any(x and y and len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b])
    ]
    root = classes(sets, links)
    return {i: (root[i], sum(a == i for a, _ in links)) for i in sets}


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        kind = rng.random()
        if made and kind < 0.25:  # a copy
            text = rng.choice(made)
        elif made and kind < 0.65:  # a near copy
            found = rng.choice(made).split(" ")
            for _ in range(rng.randrange(1, 5)):
                found[rng.randrange(len(found))] = f"x{rng.randrange(9)}"
            text = " ".join(found)
        else:
            text = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 4, 5, 30, 120, 200])))
        made.append(text)
    return [(i * 3 - 7, t if k % 5 else t.replace(" ", "\t\n"), "r", "l") for k, (i, t) in enumerate(enumerate(made))]


@pytest.mark.parametrize("block_texts, block_characters", [(256, 4_000_000), (5, 4_000_000), (256, 1500)])
def test_same_as_all_pairs(spark, block_texts, block_characters):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.similar(df, block_texts=block_texts, block_characters=block_characters).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == model(rows)
    assert max(r.n_links for r in got) > 3


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(text), "", ""))
    got = jaccard.similar(spark.createDataFrame(rows, SCHEMA), block_texts=40).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == model(rows)


def test_nulls_empty_short_repeated_and_nothing(spark):
    rows = [
        (1, None, "", ""), (2, "", "", ""), (3, " \t\n", "", ""), (4, "one two", "", ""), (5, "one  two", "", ""), (6, "two one", "", ""),
        (None, "one two", "", ""), (None, None, "", ""), (7, "a b c d e f g h", "", ""), (7, "a b c d e f g h", "", ""),
        (8, "q r s t u v", "", ""), (8, "one two", "", ""),
    ]
    got = jaccard.similar(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {(r.doc_id, r.class_id, r.n_links, r.n_rows) for r in got if r.doc_id is not None}
    assert found == {(1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 0, 1), (4, 4, 2, 1), (5, 4, 2, 1), (6, 6, 0, 1), (7, 7, 0, 2), (8, 4, 2, 2)}
    assert [(r.class_id, r.n_links, r.n_rows) for r in got if r.doc_id is None] == [(None, 0, 1)] * 2
    assert jaccard.similar(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_of_each_class(spark):
    rows = corpus(9, 60)
    rows += [rows[0], (rows[1][0], "another text of its own here", "r", "l"), (None, "no id", "r", "l")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.one_of_each_class(docs, jaccard.similar(docs))
    assert kept.schema == docs.schema
    want = {root for root, _ in model([r for r in rows if r[0] is not None]).values()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard.bands_and_rows(threshold, 0.999, 512)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 512
    with pytest.raises(ValueError):
        jaccard.bands_and_rows(0.1, 0.9999, 8)


def test_signatures_agree_as_often_as_the_sets():
    rng = np.random.RandomState(4)
    bands, rows = jaccard.bands_and_rows()
    hits, rate = 0, []
    for _ in range(300):
        common, own = rng.randint(0, 2**63, 80).astype(np.uint64), rng.randint(0, 2**63, 20).astype(np.uint64)
        a, b = np.unique(np.append(common, own[:10])), np.unique(np.append(common, own[10:]))
        x, y = jaccard.signature(a, bands, rows), jaccard.signature(b, bands, rows)
        hits += bool((x == y).any())
        rate.append((x == y).mean())
    assert hits == 300 and abs(np.mean(rate) - 0.8**rows) < 0.03
