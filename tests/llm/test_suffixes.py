"""Repeated byte strings against a table of all of them."""

import random
from collections import Counter

import numpy as np
import pytest

from txnloom.llm import suffixes

W = suffixes.WIDTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + W] for d in data for i in range(len(d) - W + 1))
    found = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - W + 1):
            if count[d[i : i + W]] > 1:
                gone[i : i + W] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        found.append((len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return found


def ours(spark, texts):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, document int")
    rows = sorted(suffixes.remove_repeats(frame).collect(), key=lambda r: r["doc_id"])
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows]


def words(draw, count):
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(count))


def corpus(seed):
    draw = random.Random(seed)
    passages = [words(draw, draw.randint(30, 150)) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "ab" * 500, words(draw, 60) * 2]
    for _ in range(50):
        parts = [words(draw, draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            whole = draw.choice(passages)
            start = draw.choice([0, draw.randint(0, len(whole) // 2)])
            parts.append(whole[start : draw.choice([len(whole), draw.randint(start, len(whole))])])
            parts.append(words(draw, draw.randint(0, 30)))
        texts.append(draw.choice([" ", ""]).join(parts))
    base = words(draw, 200)
    for _ in range(25):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = draw.choice("xyz")
        texts.append("".join(copy))
    return [*texts, texts[10], texts[10]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_table_of_strings(spark, seed):
    texts = corpus(seed)
    assert ours(spark, texts) == brute(texts)


def test_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FREQUENT", 2)
    texts = corpus(3)
    assert ours(spark, texts) == brute(texts)


def test_equal_rows_are_two_places(spark):
    frame = spark.createDataFrame([(1, "q" + "word " * 3 + "z" * 0 + "".join(map(str, range(90))))] * 2, "doc_id long, text string")
    rows = suffixes.remove_repeats(frame).collect()
    assert [r["n_removed"] for r in rows] == [r["n_bytes"] if r["n_bytes"] >= W else 0 for r in rows]


def test_many_contexts_of_one_gram():
    draw = random.Random(4)
    core = bytes(draw.choice(b"abc") for _ in range(900))
    texts = []
    for _ in range(150):
        copy = bytearray(core)
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(900)] = draw.choice(b"xy")
        copy[440:480] = core[440:480]
        texts.append(bytes(copy))
    datas = [np.frombuffer(t, np.uint8) for t in texts]
    keys = Counter(suffixes._contexts(d, np.array([440])).tobytes() for d in datas)
    few = sorted(keys)
    many = [keys[k] for k in few]
    shared = suffixes.front_coded(few)[0].tolist()
    found = suffixes.extremes(few, many, shared)
    assert found == suffixes._few_extremes(few, many, shared)
    for key, (low, high) in zip(few, found):
        offsets = [
            o for o in range(suffixes.REACH + 1)
            if sum(n for k, n in keys.items() if k[: W - o] == key[: W - o] and k[W : W + o] == key[W : W + o]) > 1
        ]
        assert (low, high) == ((offsets[0], offsets[-1]) if offsets else (1, 0))


def test_merge_is_sorted_and_knows_prefixes():
    draw = random.Random(5)
    runs, everything = [], []
    for _ in range(13):
        keys = sorted({bytes(draw.choice(b"ab") for _ in range(9)).ljust(suffixes._KEY, b"\0") for _ in range(draw.randint(1, 60))})
        shared, rest = suffixes.front_coded(keys)
        number = np.ones(len(keys), np.int32)
        runs.append(suffixes.Run(shared, rest, number, np.arange(len(keys)), np.arange(len(keys))))
        everything += keys
    before = b""
    merged = []
    for key, shared, _ in suffixes.merge(runs):
        true = next((i for i in range(len(before)) if key[i] != before[i]), len(before))
        assert shared == true
        merged.append(key)
        before = key
    assert merged == sorted(everything)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(frame).count() == 0
