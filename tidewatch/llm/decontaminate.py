"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the smallest hashes of ``GRAM`` words among every ``WINDOW - GRAM + 1``
neighbouring ones.  Two texts that share ``WINDOW`` words in a row see the same hashes there and
keep the same one, so a join of the fingerprints misses no shared window.  A hit is extended to all windows
around it, and those are compared word for word with the windows of the benchmark; a chance meeting of hashes
costs time, never a wrong result.

Items of fewer than ``WINDOW`` words are windows as a whole: those of each length are joined on
all runs of that many words, which is winnowing with one hash per window.

Rows with equal texts have equal results, so hits are worked off once per text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.workspace import written

#: Words per window, and per hash.
WINDOW = 10
GRAM = 5

#: What separates words, once A-Z are lower-cased: all ASCII but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """The words of a text in order; none for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.array_remove(split, "")


def _starts(size: Column, length: int) -> Column:
    """0, 1, ... of all runs of ``length`` elements among ``size``; empty if there is none."""
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def _run_hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(length)])


def _fingerprints(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``texts(key, w)`` to one row ``key, fp, pos`` per fingerprint, ``pos`` being its first word.

    The lowest bits of a hash give way to its place in the window, so that the least value
    tells which hash was kept: of equal ones the last.
    """
    per_window = window - gram + 1
    bits = max(1, (per_window - 1).bit_length())
    mask = (1 << bits) - 1
    hashed = texts.select("key", F.transform("w", lambda w: F.xxhash64(w)).alias("_h"))
    grams = hashed.select(
        "key",
        F.transform(_starts(F.size("_h"), gram), lambda i: _run_hash(F.col("_h"), i, gram).bitwiseAND(F.lit(~mask))).alias("_g"),
    )

    def least(start: Column) -> Column:
        marked = [F.get("_g", start + k).bitwiseOR(F.lit(per_window - 1 - k)) for k in range(per_window)]
        return marked[0] if per_window == 1 else F.least(*marked)

    kept = grams.select("key", F.transform(_starts(F.size("_g"), per_window), least).alias("_m"))
    # The outer form, since Spark infers a filter from the other one and would push these arrays into it.
    each = kept.select("key", F.posexplode_outer("_m").alias("_at", "_v")).filter("_v is not null")
    place = (F.col("_at") + (per_window - 1) - F.col("_v").bitwiseAND(F.lit(mask))).cast("int")
    return each.select("key", F.col("_v").bitwiseAND(F.lit(~mask)).alias("fp"), place.alias("pos"))


def _run(w: Column | str, start: Column, length: int) -> Column:
    """``length`` words from ``start`` as one string; words hold no blanks."""
    return F.array_join(F.slice(w, start + 1, length), " ")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """All distinct windows ``item_id, len, run, w`` of the benchmark's texts."""
    length = F.least(F.size("w"), F.lit(window))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - length))
    each = texts.select("item_id", "w", length.alias("len"), F.explode(starts).alias("_at"))
    run = F.slice("w", F.col("_at") + 1, F.col("len"))
    return each.select("item_id", "len", F.array_join(run, " ").alias("run"), run.alias("w")).dropDuplicates(["item_id", "len", "run"])


def _matches(texts: DataFrame, runs: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, at, len, item_set`` where a window of ``window`` words of ``runs(run, w, item_set)`` occurs.

    ``texts(key, text)`` may repeat a key; equal keys are equal texts.
    """
    own = written(_fingerprints(runs.select(F.col("run").alias("key"), "w"), window, gram).select("fp").distinct(), "fingerprints")
    found = _fingerprints(texts.select("key", words("text").alias("w")), window, gram)
    # The kept hash changes seldom from window to window, and only hits are shuffled.
    hits = found.join(own, "fp", "left_semi").select("key", "pos").distinct()
    hits = written(hits.groupBy("key").agg(F.collect_list("pos").alias("pos")), "hits")
    # One text for each key that has a hit: copies meet in their map task first.
    held = texts.join(hits.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    held = held.join(hits, "key").select("key", words("text").alias("w"), "pos")
    before = window - gram
    around = F.transform("pos", lambda p: F.sequence(F.greatest(p - before, F.lit(0)), F.least(p, F.size("w") - window)))
    places = F.array_distinct(F.flatten(around))
    spelled = F.transform(places, lambda at: F.struct(at.alias("at"), _run("w", at, window).alias("run")))
    runs_here = held.select("key", F.explode_outer(spelled).alias("_r"))
    return runs_here.select("key", "_r.*").join(runs.select("run", "item_set"), "run").select(
        "key", "at", F.lit(window).alias("len"), "item_set"
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, spans``.

    ``n_hit`` counts the words inside an occurrence of a window of the benchmark, ``items`` are
    the ids with such a window as sorted strings, ``spans`` the joined runs of hit words as (first, after last).
    A null text has no words, and an item without words no window.  An item without an id hits words and is
    not listed; rows that repeat an item's id are one item with the windows of all.  Only the named
    columns are read; the ids of ``docs`` are passed through, null or repeated.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.md5(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    )
    own = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(item_text_col).alias("w"))
    windows = written(_windows(own, window), "windows")
    # Windows of the same items share one set of ids, so a passage that many items hold is one row per hit.
    per_run = windows.groupBy("len", "run").agg(F.first("w").alias("w"), F.sort_array(F.collect_set("item_id")).alias("items"))
    per_run = per_run.withColumn("item_set", F.sha2(F.to_json("items"), 256))
    runs = written(per_run, "runs")
    sets = written(runs.select("item_set", "items").dropDuplicates(["item_set"]), "item-sets")

    lengths = sorted(row["len"] for row in runs.select("len").distinct().collect())  # at most ``window`` of them
    named = texts.select("key", "text")
    found = [_matches(named, runs.filter(F.col("len") == n), n, gram if n == window else n) for n in lengths]
    if found:
        matched = written(reduce(DataFrame.unionByName, found), "matches")
    else:
        matched = named.limit(0).select(
            "key", F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("item_set"))
    # Written, so that its size is known and Spark may split a text with many copies in the join.
    result = written(_per_text(matched, sets), "contaminated")
    joined = texts.select("doc_id", "key", F.size(words("text")).cast("long").alias("n_words")).join(result, "key", "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,after:int>>")).alias("spans"),
    )


def _per_text(matched: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, n_hit, items, spans`` of each text with a match."""
    places = matched.groupBy("key").agg(F.collect_set(F.struct("at", "len")).alias("_p"))
    inside = F.flatten(F.transform("_p", lambda p: F.sequence(p["at"], p["at"] + p["len"] - 1)))
    hit = places.select("key", F.sort_array(F.array_distinct(inside)).alias("_w"))
    # A run of hit words starts where the word before isn't hit, and ends where the next one isn't.
    first = F.filter("_w", lambda x, i: (i == 0) | (F.get("_w", i - 1) != x - 1))
    last = F.filter("_w", lambda x, i: F.coalesce(F.get("_w", i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("after")))
    hit = hit.select("key", F.size("_w").cast("long").alias("n_hit"), runs.alias("spans"))
    listed = matched.select("key", "item_set").distinct().join(sets, "item_set").select("key", F.explode("items").alias("_item"))
    items = listed.groupBy("key").agg(F.sort_array(F.collect_set("_item")).alias("items"))
    return hit.join(items, "key", "left")
