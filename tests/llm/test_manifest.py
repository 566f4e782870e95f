"""Manifests against a tree that is built whole for every version."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from txnloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0]


def proof(nodes, at):
    out = []
    while len(nodes) > 1:
        run = at // 8 * 8
        out += [n for i, n in enumerate(nodes[run : run + 8], run) if i != at]
        nodes, at = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return out


def tampered(row):
    chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
    text = row[4]
    if chosen and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return (*row[:4], text)


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for rows_of in groups.values():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [up([leaf(r) for r in groups[g]]) for g in order]
    root, found = up(subroots), []
    for g, subroot in zip(order, subroots):
        nodes = [leaf(r) for r in groups[g]]
        for at, row in enumerate(groups[g]):
            other = [*nodes]
            other[at] = leaf(tampered(row))
            tops = [*subroots]
            tops[order.index(g)] = up(other)
            sides = proof(nodes, at) + proof(subroots, order.index(g))
            found.append((row[0], nodes[at], subroot, root, digest(*sides), up(tops), up(tops) == root))
    return sorted(found, key=str)


def ours(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", position string, total int")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest.audit(frame, changed={"text": F.when(chosen, lowered).otherwise(F.col("text"))}, **options)
    listed = found.collect()
    changed = {leaf(r) for r in rows if tampered(r) != r}
    assert all((r["copied"] is not None) == (r["leaf"] in changed) for r in listed)
    return sorted((tuple(r[n] for n in found.columns if n != "copied") for r in listed), key=str)


def corpus(n, langs):
    draw = random.Random(n)
    rows = []
    for i in range(n):
        text = draw.choice([None, "", "Plain", "no capitals", f"Text {i} ÄÖ", "é" * 50])
        rows.append((i * 3 - 7, draw.choice([None, "web"]), draw.choice(langs), draw.choice([None, i]), text))
    return rows


@pytest.mark.parametrize("n", [1, 7, 8, 9, 65, 700])
def test_equals_whole_trees(spark, n):
    rows = corpus(n, ["en", "en", "en", None, "de", "é", ""])
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_continue_above(spark, levels):
    """Small blocks, so that trees have several layers of them."""
    rows = corpus(600, [f"l{i}" for i in range(20)] + ["en"] * 60)
    assert ours(spark, rows, levels=levels) == brute(rows)


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, "A"), (4, "s", "en", 1, "Twice"), (4, "s", "en", 1, "Twice")]
    rows += [(4, "s", "en", 2, "Other"), (5, "", "", 0, ""), (9, "1:a", "en", 3, "B" * 300_000)]
    assert ours(spark, rows) == brute(rows)


def test_empty(spark):
    made = manifest.Manifest(spark.createDataFrame([], SCHEMA), "doc_id", "lang", ["doc_id", "text"])
    assert made.root() is None and made.audit().collect() == []


def test_versions_share_all_but_the_way():
    digests = [str(i) for i in range(30)]
    root = manifest.grown(digests, manifest.height(30))
    copied = manifest.replaced(root, 13, "new", 2)
    assert [len(n.children) for n in copied] == [0, 8, 4]
    assert copied[-1].digest == up([*digests[:13], "new", *digests[14:]])
    assert root.digest == up(digests)
    assert copied[-1].children[0] is root.children[0] and copied[1].children[4] is root.children[1].children[4]
    way = manifest.siblings(root, 13, 2)
    assert manifest.folded("13", way)[-1] == root.digest and manifest.folded("new", way) == [n.digest for n in copied[1:]]


def test_kept_proofs(spark):
    rows = corpus(40, ["en", "de"])
    made = manifest.Manifest(spark.createDataFrame(rows, SCHEMA), "doc_id", "lang", SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    for r in made.audit(keep_proofs=True).collect():
        assert digest(r["proof"]) == r["proof_sha256"] and r["verified"] and r["root"] == made.root()
