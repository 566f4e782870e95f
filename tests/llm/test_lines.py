"""Line dedup against a plain walk over documents in order."""

import random
from collections import Counter

import xxhash

from txnloom.llm import lines

SCHEMA = "doc_id long, text string, removed_lines string"


def blocks(text):
    """Chunks by their rules, from the boundaries alone: sets of line numbers and their bytes."""
    rows = (text or "").split("\n")
    spoken = [n for n, line in enumerate(rows) if line.strip()]
    ends = lines.cuts([xxhash.xxh3_64_intdigest(rows[n].encode()) for n in spoken])
    pieces = [spoken[a:b] for a, b in zip([0, *ends], ends)]
    joined = []
    for k, piece in enumerate(pieces):
        if len(piece) >= 2:
            joined.append(piece)
        elif k + 1 < len(pieces):
            joined.append(piece + pieces[k + 1])
        elif k:
            joined.append(pieces[k - 1] + piece)
    out = {}
    for piece in joined:
        whole = tuple(range(piece[0], piece[-1] + 1))
        out[whole] = "\n".join(rows[n] for n in whole)
    return out


def brute(rows):
    """What is left of each (key, text): of equal chunks the first one in order of keys stays."""
    order = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    places = {}
    for key, text in order:
        for at, body in blocks(text).items():
            places.setdefault(body, []).append(((key, text), at))
    drop, hold = {}, {}
    for found in places.values():
        for doc, at in found[1:]:
            drop.setdefault(doc, set()).update(at)
        if len(found) > 1:
            hold.setdefault(found[0][0], set()).update(found[0][1])
    expected = {}
    for doc in rows:
        gone = drop.get(doc, set()) - hold.get(doc, set())
        left = doc[1] and "\n".join(x for n, x in enumerate(doc[1].split("\n")) if n not in gone)
        expected[doc] = (left, len(gone))
    return expected


def ours(spark, rows):
    return lines.dedupe(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)).collect()


def corpus():
    draw = random.Random(1)
    block = [f"shared line {i}" for i in range(12)]
    rows = []
    for key in range(120):
        own = [draw.choice(["", " ", "common", f"line {draw.randrange(40)}", f"own {key} {i}"]) for i in range(draw.randint(0, 12))]
        at, cut = draw.randint(0, len(own)), draw.randint(0, 11)
        rows.append((key, "\n".join(own[:at] + (block[cut:] if key % 3 == 0 else []) + own[at:])))
    return rows + [(200, None), (201, ""), (None, "\n".join(block)), rows[3], (202, "a\n" * 3000), (203, "x" * 200_000 + "\ny")]


def test_equals_walk(spark):
    rows = corpus()
    expected = brute(rows)
    found = ours(spark, rows)
    assert len(found) == len(rows)
    for r in found:
        given = next(t for k, t in rows if k == r["doc_id"])
        assert (r["text"], r["removed_lines"]) == expected[r["doc_id"], given]
    assert sum(r["removed_lines"] for r in found) > 100


def test_first_occurrences_stay_whole(spark):
    rows = corpus() + [(300 + i, "\n".join(f"run {i + j}" for j in range(6))) for i in range(30)]
    found = {(r["doc_id"], r["text"]) for r in ours(spark, rows)}
    left = "\n\0\n".join(t or "" for _, t in found)
    # A chunk that stands once only may lose lines that another, repeated one has.
    places = Counter(body for _, text in set(rows) for body in blocks(text).values())
    repeated = [body for body, n in places.items() if n > 1]
    assert len(repeated) > 20 and all(body in left for body in repeated)


def test_no_line_is_lost_between_overlapping_blocks(spark):
    """A/B, A/B/C, B/C: whatever goes, A/B and B/C stay somewhere as blocks."""
    rows = []
    for s in range(40):
        a, b, c = (f"{s} line {x}" for x in "abc")
        rows += [(3 * s, f"{a}\n{b}"), (3 * s + 1, f"{a}\n{b}\n{c}"), (3 * s + 2, f"{b}\n{c}")]
    found = {r["doc_id"]: r["text"] for r in ours(spark, rows)}
    for s in range(40):
        texts = [found[3 * s + k] for k in range(3)]
        assert any(f"{s} line a\n{s} line b" in t for t in texts)
        assert any(f"{s} line b\n{s} line c" in t for t in texts)


def test_planted_passages_are_found(spark):
    """Passages of 2 to 50 lines between other neighbours, some with blank lines inside."""
    draw = random.Random(3)
    rows, planted = [], {}
    for pair in range(300):
        n = draw.choice([2, 3, 4, 5, 8, 20, 50])
        passage = [f"passage {pair} line {i}" for i in range(n)]
        if pair % 3 == 0:
            passage = "\n\n".join(passage).split("\n")
        for copy in range(2):
            around = [[f"own {pair} {copy} {side} {i}" for i in range(draw.randint(0, 4))] for side in "ab"]
            rows.append((2 * pair + copy, "\n".join([*around[0], *passage, *around[1]])))
        planted[2 * pair + 1] = (n, len(passage))
    found = {r["doc_id"]: r["removed_lines"] for r in ours(spark, rows)}
    assert not any(n for key, n in found.items() if key % 2 == 0)
    recall = sum(found[k] for k in planted) / sum(n for _, n in planted.values())
    by_size = {s: round(sum(found[k] for k, p in planted.items() if p[0] == s) / sum(p[1] for p in planted.values() if p[0] == s), 2) for s in (2, 3, 4, 5, 8, 20, 50)}
    print(recall, by_size)
    assert recall >= 0.9, by_size


def test_cuts_resist_shifts():
    hashes = [xxhash.xxh3_64_intdigest(f"line {i * 7919 % 1000}".encode()) for i in range(400)]
    ends = set(lines.cuts(hashes))
    assert 0.8 < len(ends) / len(hashes) < 0.95
    # Boundaries depend on the lines beside them: an insertion changes those at its place only.
    moved = {e if e <= 200 else e - 3 for e in lines.cuts([*hashes[:200], 1, 2, 3, *hashes[200:]]) if not 200 < e <= 203}
    assert len(ends ^ moved) <= lines.WINDOW
    assert lines.cuts([]) == [] and lines.cuts([5])[-1] == 1


def test_same_hash_is_not_enough(spark, monkeypatch):
    monkeypatch.setattr(lines, "_hash", lambda chunk: 7)
    rows = [(1, "alpha\nbeta"), (2, "gamma\ndelta")]
    assert [r["removed_lines"] for r in ours(spark, rows)] == [0, 0]


def test_clashing_columns_pass(spark):
    names = ["doc", "chunk", "chunks", "hash", "of", "stay", "leave", "row", "n", "_leave", "_lines", "_doc"]
    rows = [(1, "a\nb", *range(12)), (2, "a\nb", *range(12))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    done = lines.dedupe(frame)
    assert done.columns == [*frame.columns, "removed_lines"]
    assert sorted(tuple(r) for r in done.collect()) == [(1, "a\nb", *range(12), 0), (2, "", *range(12), 2)]


def test_empty(spark):
    assert ours(spark, []) == []
