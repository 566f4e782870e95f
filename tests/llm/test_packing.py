"""Packing: exact ids, whole pieces, full sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from txnloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string")
    return packing.pieces(frame, PATH, public_tokenizers.PATTERN)


def test_pieces_are_the_library_ids(spark):
    rows = [
        (1, "plain text, isn't it?  \n\n tabs\t", ""),
        (2, None, ""),
        (3, "", ""),
        (4, "日本 <|endoftext|> ​ x", ""),
        (5, "word " * 5000, ""),
        (5, "word " * 5000, ""),
        (None, "é" * 10, ""),
    ]
    reference = Tokenizer.from_file(PATH)
    found = {}
    for r in pieces_of(spark, rows).collect():
        assert r["length"] == len(r["ids"]) <= packing.CAPACITY
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        found.setdefault(r["doc_id"], []).append(r)
    for key, text, _ in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(found[key], key=lambda r: r["start"])
        if key != 5:
            assert sum([list(r["ids"]) for r in own], []) == ids
        else:
            half = sorted(own, key=lambda r: r["piece"])[::2]
            assert sum([list(r["ids"]) for r in half], []) == ids
            assert all(r["length"] == packing.CAPACITY for r in half if r["piece"])


def check(counts, bins, capacity):
    left = dict(counts)
    for used in bins:
        assert sum(used) <= capacity
        for size in used:
            left[size] -= 1
    assert not any(left.values())


def fewest(sizes, capacity):
    """Optimum by trying every bin for every piece."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(room)
            go(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_small_cases_are_optimal():
    draw = random.Random(2)
    better = 0
    for _ in range(150):
        sizes = sorted((draw.randint(18, 48) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        bins = packing.pack_counts(counts, 100)
        check(counts, bins, 100)
        assert len(bins) == fewest(sizes, 100) >= packing.lower_bound(counts, 100)
        better += len(packing.best_fit(counts, 100)) > len(bins)
    assert better > 0


def test_many_bins_do_not_use_up_the_search():
    draw = random.Random(2)
    better = 0
    for _ in range(60):
        sizes = [draw.randint(18, 48) for _ in range(9)]
        counts = {s: sizes.count(s) for s in sizes}
        alone = packing.pack_counts(counts, 100)
        if len(packing.best_fit(counts, 100)) > len(alone):
            better += 1
            # Pieces that leave no room, whole or nearly so, only add their bins.
            for size in (100, 99):
                many = counts | {size: packing.OPENED}
                bins = packing.pack_counts(many, 100)
                check(many, bins, 100)
                assert len(bins) == packing.OPENED + len(alone)
    assert better > 0


def test_domination():
    assert packing.dominates((5, 3), (4, 3))
    assert packing.dominates((7,), (4, 3))
    assert not packing.dominates((4, 3), (7,))


def test_placement(spark):
    draw = random.Random(3)
    rows = [(i, 0, draw.randint(1, 2048), "x") for i in range(3000)] + [(1, 0, 7, "x")] * 500 + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string")
    placed = packing.pack(frame, ["doc_id", "piece"], 3501).collect()
    assert len(placed) == len(rows)
    by_bin = {}
    for r in placed:
        if r["length"] is None:
            assert r["sequence_id"] is None and r["offset"] is None
        else:
            by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    counts = {}
    for r in rows:
        if r[2]:
            counts[r[2]] = counts.get(r[2], 0) + 1
    assert len(by_bin) <= 1.005 * packing.lower_bound(counts, packing.CAPACITY)


def test_sequences(spark):
    rows = [(1, "one two", ""), (2, "three", "")]
    cut = pieces_of(spark, rows)
    placed = packing.pack(cut, ["doc_id", "piece"], 2)
    (only,) = packing.sequences(placed).collect()
    assert sorted(only["ids"]) == sorted(i for r in cut.collect() for i in r["ids"])


def test_empty(spark):
    assert packing.pack(pieces_of(spark, []), ["doc_id"], 0).count() == 0


def test_clashing_columns_pass(spark):
    rows = [(k, 0, 100 + k, "a", 7) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, length long, _shard string, sequence_id int")
    placed = packing.pack(frame, ["doc_id", "piece"], rows_expected=40)
    assert placed.columns == ["doc_id", "piece", "length", "_shard", "sequence_id", "offset"]
    found = placed.collect()
    assert {r["_shard"] for r in found} == {"a"} and len(found) == 40
    used = {}
    for r in found:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= packing.CAPACITY for n in used.values())
