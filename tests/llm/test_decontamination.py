"""Decontamination against a walk over all windows."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from txnloom.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = []
    for item, text in items:
        words = WORD.findall(lowered(text))
        n = min(10, len(words))
        windows += [(item, tuple(words[i : i + n])) for i in range(len(words) - n + 1) if n]
    found = []
    for key, text in docs:
        words = WORD.findall(lowered(text))
        hit, names = set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    names |= {str(item)} if item is not None else set()
        found.append((key, len(words), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


def ours(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    found = d.find(frame, marks).withColumn("n_hit", d.n_hit())
    rows = found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items"), F.sha2(F.array_join("hit_items", ","), 256), F.col("n_hit") > 0
    )
    return sorted(map(tuple, rows.collect()), key=str)


def corpus(seed, few=30):
    draw = random.Random(seed)
    usual = [f"w{i}" for i in range(few)] + ["Été", "ÉTÉ", "naïve", "日本", "😀", "K"]

    def text(n):
        return "".join(draw.choice(usual) + draw.choice([" ", "\n", " -- ", "\u0001", "_"]) for _ in range(n))

    items = [(draw.randrange(-5, 300), text(draw.choice([10, 11, 14, 30]))) for _ in range(40)]
    docs = []
    for key in range(150):
        parts = [text(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            cut = draw.choice(items)[1]
            parts += [draw.choice([cut, cut.upper(), cut.lower(), cut[draw.randrange(9) :], cut[: -draw.randrange(1, 30)]]), text(draw.randrange(9))]
        docs.append((key, "".join(parts)))
    return docs, items


@pytest.mark.parametrize("few", [2, 30, 300])
def test_equals_walk(spark, few):
    docs, items = corpus(few, few)
    found = ours(spark, docs, items)
    assert found == brute(docs, items) and any(r[5] for r in found) and (few < 30 or not all(r[5] for r in found))


def test_short_items_nulls_and_repeats(spark):
    docs, items = corpus(9)
    docs += [(None, None), (None, "one two three"), (7, ""), docs[3], docs[3], (5, docs[8][1]), (5, "x " * 30000), (8, "three")]
    items += [(1, "Two three"), (1, "Two three"), (2, "three"), (None, "w1 w2"), (3, ""), (4, None), (400, "!!"), (401, "K")]
    assert ours(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(3)
    assert ours(spark, docs, []) == brute(docs, [])
    assert ours(spark, [], items) == []


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WINDOWS", 100)
    docs, items = corpus(4)
    assert ours(spark, docs, items) == brute(docs, items)


def test_same_hash_is_not_enough(spark, monkeypatch):
    whole = d._windows
    monkeypatch.setattr(d, "_windows", lambda hashes, n: F.transform(whole(hashes, n), lambda h: F.lit(7).cast("long")))
    docs, items = corpus(6)
    items = [*items[:8], (500, "two words"), (501, docs[3][1][:12])]
    assert ours(spark, docs[:40], items) == brute(docs[:40], items)


def test_only_capitals_of_ascii_are_lowered(spark):
    """Words that a full lower-casing would join stay apart, also where case depends on what follows."""
    items = [(1, "ΟΔΟΣ ÉTÉ K İx " * 3), (2, "ΟΔΟΣ'x ABC " * 5)]
    docs = [(1, items[0][1].lower()), (2, items[0][1]), (3, "οδοσ été k i̇x " * 3), (4, "ΟΔΟΣ'X abc " * 5), (5, "ΟΔΟΣ x aBc " * 5)]
    found = ours(spark, docs, items)
    assert found == brute(docs, items) and [r[5] for r in found] == [False, True, False, True, True]


def test_clashing_columns_pass(spark):
    docs, items = corpus(2)
    frame = spark.createDataFrame([(k, t, "a", "b", 3) for k, t in docs], "doc_id long, text string, _row string, n_words string, hash int")
    marks = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, words int")
    rows = d.find(frame, marks).select("doc_id", "_row", "hash", "n_words").collect()
    assert sorted(tuple(r) for r in rows) == sorted((r[0], "a", 3, r[1]) for r in brute(docs, items))


def test_removal(spark):
    item = "The quick brown fox jumps over the lazy dog again today"
    docs = [
        (1, f"Before, {item.upper()}! After."),
        (2, "Nothing here."),
        (3, item),
        (4, f"({item})\n\n{item}... end"),
        (5, None),
        (6, ""),
        (7, f"{item} -- and {item}"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    marks = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = {r["doc_id"]: r["text"] for r in d.remove_spans(frame, marks).collect()}
    assert left == {1: "Before, ! After.", 2: "Nothing here.", 3: "", 4: "(... end", 5: None, 6: "", 7: " -- and "}
    assert d.remove_spans(frame, marks).columns == frame.columns
    assert {r["doc_id"] for r in d.remove_documents(frame, marks).collect()} == {2, 5, 6}
    assert {r["doc_id"] for r in d.remove_documents(frame, marks, share=0.9).collect()} == {1, 2, 5, 6}


def test_no_python_in_the_plan(spark):
    docs, items = corpus(1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = d.find(frame, spark.createDataFrame(items, "item_id long, text string"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text
