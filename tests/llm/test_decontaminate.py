import random
import re

from tests.test_plans import plan
from tidewatch.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, key string, w string", "item_id string, text string, fp int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def model(docs, items):
    rows = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(10, len(w))
            for i in range(len(w) - n + 1) if w else ():
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found |= {item_id} - {None}
        spans = [(i, next(k for k in range(i, len(own) + 1) if k not in hit)) for i in sorted(hit) if i - 1 not in hit]
        rows.append((doc_id, len(own), len(hit), sorted(found), spans))
    return sorted(rows, key=repr)


def run(spark, docs, items):
    left = spark.createDataFrame([(*d, "k", "w") for d in docs], DOCS).repartition(3)
    found = contamination(left, spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), [tuple(s) for s in r.spans]) for r in found.collect()), key=repr)


def test_same_as_all_windows(spark):
    rng = random.Random(2)
    draw = lambda n: [rng.choice("abcdefgh") + rng.choice(["", "Ä", "1"]) for _ in range(n)]
    items = [(str(i), " ".join(draw(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [("7", " ".join(draw(14))), (None, " ".join(draw(12))), ("none", None), ("signs", " ?! "), ("same", items[5][1])]
    docs = []
    for i in range(60):
        text = draw(rng.choice([0, 5, 40]))
        for _ in range(rng.randrange(3)):  # a passage, whole or in part, sometimes with a word changed
            passage = words(rng.choice(items)[1])
            start = rng.randrange(len(passage) + 1)
            passage = passage[start // 3 :]
            if passage and rng.random() < 0.3:
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(len(text) + 1)
            text = text[:at] + [p.upper() for p in passage] + text[at:]
        docs.append((i, rng.choice([" ", ", ", "\n\t", "--"]).join(text)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (100, None), (101, ""), (102, "!!"), (103, "a a a a a a a a a a a a a a a")]
    items.append(("run", "a " * 12))
    want = model(docs, items)
    assert run(spark, docs, items) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_long_texts_and_nothing(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    text = ("filler word " * 40_000 + passage + " ") * 2
    assert run(spark, [(1, text)], [("i", passage)]) == [(1, 160_020, 20, ["i"], [(80_000, 80_010), (160_010, 160_020)])]
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], [])]
    assert run(spark, [], [("i", passage)]) == []
    nine = " ".join(passage.split()[:9])
    assert run(spark, [(1, nine)], [("i", passage)]) == [(1, 9, 0, [], [])]
    assert run(spark, [(1, "x " + nine)], [("i", nine)]) == [(1, 10, 9, ["i"], [(1, 10)])]


def test_no_python_in_the_plan(spark):
    docs, items = spark.createDataFrame([(1, "a", "", "")], DOCS), spark.createDataFrame([("1", "a", 1)], ITEMS)
    text = plan(contamination(docs, items))
    assert "Python" not in text and "Arrow" not in text
