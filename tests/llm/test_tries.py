"""Conversation tries against prefixes counted one by one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from txnloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def remainder(c, n):
    return c - int(c / n) * n


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - remainder(c, 20), [])[:h] + ts[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    found = set()
    for prefix, convs in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in under if len(p) == len(prefix) + 1]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under) for p in under)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(prefix))
        up = min(members[prefix[:-1]]) if prefix else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.add((min(convs), len(prefix), up, len(convs), len(children), leaves, saved, digest))
    return found


def ours(spark, rows, capacity=tries.CAPACITY, parts=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    listed = tries.trie(tries.rebuilt(frame), capacity).collect()
    assert len(listed) == len({tuple(r) for r in listed})
    return {tuple(r) for r in listed}


def corpus(seed, convs=70):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 20 == 0 and draw.random() < 0.3:
            continue
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9])):
            role = draw.choice(["user", "assistant", None, ""])
            rows.append((c, turn, role, draw.choice([f"a b{draw.randrange(2)}", "", None, "c d\te"])))
    # Copies, one of them an extension of the others, and conversations that differ late.
    for c in range(100, 130):
        rows += [(c, t, "user", f"same {t}") for t in range(6 + (c == 111))]
    for c in range(140, 150):
        rows += [(c, t, "user", "long run" if t < 30 else f"{c} {t}") for t in range(33)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity", [tries.CAPACITY, 40, 0])
def test_equals_counting(spark, capacity):
    rows = corpus(capacity)
    assert ours(spark, rows, capacity) == brute(rebuilt(rows))


def test_nulls_ties_and_ids(spark):
    rows = [(-3, 0, "u", "x y"), (0, 0, "u", "x y"), (None, 0, "u", "lost"), (5, None, "u", "first"), (5, 1, "u", "second")]
    rows += [(7, 1, "u", "tie"), (7, 1, "u", "tie"), (7, 0, "u", "z"), (2**62, 1, None, None), (5, 2, "u", "w " * 20000)]
    rows += [(c, t, "u", f"{c}") for c in (8, 9) for t in range(4)]
    assert ours(spark, rows) == brute(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert ours(spark, []) == set()
    # The family's first conversation is absent and all own turns are skipped.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "only")]
    assert rebuilt(rows) == {c: []}
    assert ours(spark, rows) == brute(rebuilt(rows))


def test_extra_columns_do_not_clash(spark):
    rows = corpus(5, 30)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", turns string, seq int")
    assert {tuple(r) for r in tries.trie(tries.rebuilt(frame)).collect()} == brute(rebuilt(rows))


def test_members_in_many_runs(spark):
    rows = spark.createDataFrame([("a", i * 7 % 50) for i in range(50)] + [("b", -1)], "seq string, conv_id long")
    found = {r["seq"]: tuple(r)[1:] for r in tries.endings(rows.repartition(5), run=3).collect()}
    listed = ",".join(map(str, range(50)))
    assert found == {
        "a": (50, 0, hashlib.sha256(listed.encode()).hexdigest()),
        "b": (1, -1, hashlib.sha256(b"-1").hexdigest()),
    }
