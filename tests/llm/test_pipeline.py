"""The pipeline against plain models of its stages, each fed with what the stage before kept."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql.types import IntegerType, StringType

import corpus_pipeline
from tests.llm.helpers import classes, grams, words
from tests.llm.test_mixing import wanted
from tidewatch.llm import bpe, quality
from tidewatch.llm.common import table
from tidewatch.llm.queries import QUALITY_THRESHOLD, rank_file


def read(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    start = read(docs)
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["quality classifier", "n-gram Jaccard join", "secret scan", "source mix", "byte-level BPE"]

    good = named["quality classifier"](spark, docs, sf_dir)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    want = {r["doc_id"] for r in start if quality.score(weights.astype(np.float32), quality.features(r["text"])) >= QUALITY_THRESHOLD}
    kept = read(good)
    assert {r["doc_id"] for r in kept} == want and good.schema == docs.schema and 0 < len(kept) < len(start)
    clean = {r.doc_id for r in table(spark, sf_dir, "labels").filter("quality = 1").collect()}
    assert len(clean - want) <= 0.02 * len(clean)

    alone = named["n-gram Jaccard join"](spark, good, sf_dir)
    sets = {r["doc_id"]: grams(r["text"]) for r in kept}
    held = {}
    for i, found in sets.items():
        for g in found:
            held.setdefault(g, []).append(i)
    shared = {}
    for ids in held.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    single = read(alone)
    assert {r["doc_id"] for r in single} == set(classes(sets, links).values()) and len(single) < len(kept)

    safe = named["secret scan"](spark, alone, sf_dir)
    by = {r["doc_id"]: r for r in single}
    texts = read(safe)
    changed = [r for r in texts if r["text"] != by[r["doc_id"]]["text"]]
    assert len(texts) == len(single) and changed and all(r["n_chars"] == len(r["text"]) for r in texts)
    assert all('token = "[secret]"' in r["text"].lower() for r in changed)
    assert not any('token = "' in r["text"].lower().replace('token = "[secret]"', "") for r in texts)

    mix = named["source mix"](spark, safe, sf_dir)
    rows = read(mix)
    sizes, longest, taken = {}, {}, {}
    for r in texts:
        n = len(words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    for source, target in wanted(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest[source]
    original = {tuple(r.values()) for r in texts}
    assert mix.schema == docs.schema and all(tuple(r.values()) in original for r in rows)

    found = sorted(tuple(r.values()) for r in read(named["byte-level BPE"](spark, mix, sf_dir)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
    want = []
    for r in rows:
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert found == sorted(want)


def test_no_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_odd_documents(spark, sf_dir):
    """Nulls in any column, repeated rows and extra columns go through every stage."""
    schema = table(spark, sf_dir, "documents").schema.add("findings", StringType()).add("size", IntegerType())
    clean = table(spark, sf_dir, "documents").limit(30).collect()
    rows = [(*r, "x", 1) for r in clean] + [(*clean[0], "x", 1), (None, None, None, None, None, None, None), (10**6, "", "en", None, 0, None, 2)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert [f.name for f in docs.schema] == schema.names, name
        docs = spark.createDataFrame(docs.collect(), schema)
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == docs.count()
