"""Prefix trie of conversations, built as a burst trie.

A conversation is the sequence of its turns.  Equal sequences are first counted
as one.  All sequences start in one container under the root.  A container that
holds too many turns bursts: its node becomes a head of the trie and its
sequences move to one container for each next turn id, until every container
left is small.  As a prefix that many sequences share would take one burst for
each of its turns, the turns looked at double with every round.

The containers left are dealt to shards, sorted, and swept once: every sequence shares some
nodes with the one before it and opens others, so a sweep holds one container at
most.  Sums over subtrees add up inside containers and then once for every head
above a container.

Turn ids are 128 bits of a SHA-256 over role and text, and a prefix is known by
the SHA-256 of its turn ids, so nothing is compared by a short hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txnloom.llm.shared import ROWS_AT_ONCE, written

# Turns (below its head) that a container of two or more sequences holds at most.
CAPACITY = 1 << 16
# Bytes of one turn id.
ID = 16
# Conversation ids that travel as one row when the members of a node are listed.
RUN = 4096
ROUNDS = 64

WORD = r"[^\x20\x09-\x0D]+"
_NOBODY = sha256(b"").hexdigest()

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns (id, words) in order.

    Turns are ordered by ``turn``, null first; equal ones by their id.  A null
    role or text is empty.  Rows without conv_id are no conversation.  Repeated
    rows are turns of their own.  Texts are read whole but do not travel.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.sha2(marked, 256), 1, 2 * ID).alias("id"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("turn"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"], t["words"])).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Conversations that start with turns of the first of their family.

    Conversation c takes the first h turns of conversation c - c % family (all
    if there are fewer, none if there is no such one), then its own after its
    first h; h is the CRC-32 of the decimal c, modulo ``shared``.  A row for
    every conversation, also one without turns left.
    """
    own = written(turns(conversations), "turns")
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = own.filter(F.col("conv_id") % family == 0)
    heads = heads.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, shared).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    rows = own.select("*", first.alias("_first"), h.alias("_h")).join(heads, "_first", "left")
    start = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast("array<struct<id:string,words:bigint>>"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return rows.select("conv_id", F.concat(start, rest).alias("turns"))


def _rows(df: DataFrame, schema: str, work) -> DataFrame:
    """Rows that ``work`` makes of the rows of a partition, a bounded number at a time."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        parts = (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        for row in work(r for part in parts for r in part.to_pylist()):
            out.append(dict(zip(arrow.names, row, strict=True)))
            if len(out) >= RUN:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


def endings(members: DataFrame, run: int = RUN) -> DataFrame:
    """(seq, n, conv, ends_sha256) from (seq, conv_id): the members of every sequence, hashed in order.

    Members are sorted by ranges and travel in runs of ``run`` ids, so that a
    sequence that a third of all conversations share costs one row for each run;
    a digest runs over its ids one after the other by definition.
    """

    def pack(rows: Iterator[dict]) -> Iterator[tuple]:
        seq, ids = None, []
        for row in rows:
            if row["seq"] != seq or len(ids) >= run:
                if ids:
                    yield seq, ids[0], len(ids), ",".join(map(str, ids))
                seq, ids = row["seq"], []
            ids.append(row["conv_id"])
        if ids:
            yield seq, ids[0], len(ids), ",".join(map(str, ids))

    def digest(rows: Iterator[dict]) -> Iterator[tuple]:
        seq = None
        for row in rows:
            if row["seq"] != seq:
                if seq is not None:
                    yield seq, n, first, state.hexdigest()
                seq, n, first, state = row["seq"], 0, row["first"], sha256()
            state.update((("," if n else "") + row["ids"]).encode())
            n += row["n"]
        if seq is not None:
            yield seq, n, first, state.hexdigest()

    ranges = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    runs = _rows(ranges, "seq string, first long, n long, ids string", pack)
    return _rows(
        runs.repartition("seq").sortWithinPartitions("seq", "first"),
        "seq string, n long, conv long, ends_sha256 string",
        digest,
    )


def prefix_ids(ids: bytes, first: int, last: int) -> list[str]:
    """Ids of the prefixes of ``first`` to ``last`` turns (at most all)."""
    state = sha256(ids[: first * ID])
    out = [state.hexdigest()]
    for at in range(first, min(last, len(ids) // ID)):
        state.update(ids[at * ID : (at + 1) * ID])
        out.append(state.hexdigest())
    return out


def _sequences(paths: DataFrame) -> DataFrame:
    """Distinct sequences: seq, ids (packed), words, length, n, conv (least member) and ends_sha256."""
    packed = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = paths.select("conv_id", packed.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = written(rows.withColumn("seq", F.sha2("ids", 256)), "rebuilt")
    # One member stands for all that are equal; it is the least, so it is a row of its own.
    return rows.withColumnRenamed("conv_id", "conv").join(endings(rows), ["seq", "conv"]).withColumn("length", F.size("words"))


@dataclass(frozen=True)
class Burst:
    """What bursting leaves: the heads, and for each sequence the depth of its last head."""

    heads: DataFrame
    cuts: DataFrame


def burst(sequences: DataFrame, capacity: int = CAPACITY) -> Burst:
    """Burst the root's container and all others above ``capacity``.

    Returns heads (prefix, depth, conv, n_convs, words of the last turn; the
    root is always one) and cuts (conv, cut), the number of heads below the root
    on the way of a sequence, for all sequences that meet any.
    """

    def look(first: int, last: int):
        def work(rows: Iterator[dict]) -> Iterator[tuple]:
            for row in rows:
                found = prefix_ids(row["ids"], first, last)
                for depth, prefix in enumerate(found, first):
                    yield prefix, depth, row["conv"], row["n"], row["length"] - depth, row["words"][depth - 1]

        return work

    root = sequences.agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs")).filter("conv IS NOT NULL")
    root = root.select(
        F.lit(_NOBODY).alias("prefix"), F.lit(0).alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("words")
    )
    heads, cuts, waiting, first, last = [root], [], sequences, 1, 1
    for _ in range(ROUNDS):
        deep = waiting.filter(F.col("length") >= first)
        seen = _rows(deep, "prefix string, depth int, conv long, n long, below long, words long", look(first, last))
        seen = written(seen, "burst")
        held = seen.groupBy("prefix").agg(
            F.min("depth").alias("depth"),
            F.min("conv").alias("conv"),
            F.sum("n").alias("n_convs"),
            F.max("words").alias("words"),
            F.count("*").alias("_sequences"),
            F.sum(F.col("below") + 1).alias("_turns"),
        )
        oversized = (F.col("_turns") > capacity) & (F.col("_sequences") > 1)
        over = written(held.filter(oversized).drop("_sequences", "_turns"), "heads")
        if over.isEmpty():
            break
        heads.append(over)
        inside = written(
            seen.join(over.select("prefix"), "prefix", "left_semi").groupBy("conv").agg(F.max("depth").alias("cut")), "cuts"
        )
        cuts.append(inside)
        waiting = written(waiting.join(inside.filter(F.col("cut") == last).select("conv"), "conv", "left_semi"), "waiting")
        first, last = last + 1, last + 2 * (last - first + 1)
    else:
        raise RuntimeError(f"containers did not settle in {ROUNDS} rounds")
    none = sequences.sparkSession.createDataFrame([], "conv long, cut int")
    for found in cuts:
        none = none.unionByName(found)
    all_heads = heads[0]
    for found in heads[1:]:
        all_heads = all_heads.unionByName(found.select(all_heads.columns))
    return Burst(written(all_heads, "heads"), none.groupBy("conv").agg(F.max("cut").alias("cut")))


def _sweep(rows: Iterator[dict]) -> Iterator[tuple]:
    """Nodes of containers, from their sequences in order of (container, ids).

    Yields the columns of NODE, with the prefix of the head above in front where
    a node is the top of its container (its parent's conversation is not known
    here then).
    """
    path: list[dict] = []
    container, before, cut = None, b"", 0

    def close(depth: int) -> Iterator[tuple]:
        while path and path[-1]["depth"] > depth:
            node = path.pop()
            saved = node["saved"] + (node["n"] - 1) * node["words"]
            leaves = node["leaves"] or 1
            if path:
                up = path[-1]
                up["n"] += node["n"]
                up["conv"] = min(up["conv"], node["conv"])
                up["children"] += 1
                up["leaves"] += leaves
                up["saved"] += saved
                up["open"].append(node)
            # A node is known when its parent is: the least member of that may still come.
            node |= {"leaves": leaves, "saved": saved}
            if not path:
                yield from listed(node)

    def listed(top: dict) -> Iterator[tuple]:
        stack = [(top, None)]
        while stack:
            node, up = stack.pop()
            stack += [(child, node["conv"]) for child in node["open"]]
            above = node["above"] if up is None else None
            yield above, node["conv"], node["depth"], up, node["n"], node["children"], node["leaves"], node["saved"], node["ends"]

    for row in rows:
        ids, words = row["ids"], row["words"]
        if row["container"] != container:
            yield from close(-1)
            container, before, cut = row["container"], b"", row["cut"]
        shared, most = cut, min(len(ids), len(before)) // ID
        while shared < most and ids[shared * ID : (shared + 1) * ID] == before[shared * ID : (shared + 1) * ID]:
            shared += 1
        yield from close(shared)
        for depth in range(shared + 1, len(words) + 1):
            above = prefix_ids(ids, cut, cut)[0] if depth == cut + 1 else None
            path.append(
                {"depth": depth, "words": words[depth - 1], "n": 0, "conv": row["conv"], "children": 0, "leaves": 0}
                | {"saved": 0, "ends": _NOBODY, "open": [], "above": above}
            )
        last = path[-1]
        last["n"] += row["n"]
        last["conv"] = min(last["conv"], row["conv"])
        last["ends"] = row["ends_sha256"]
        before = ids
    yield from close(-1)


def _above(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """A row (conv, depth, leaves, saved, prefix, next) for each node and each depth above it.

    ``nodes`` has conv, depth, leaves and saved; ``next`` marks the parent.
    """

    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            for depth, prefix in enumerate(prefix_ids(row["ids"], 0, row["depth"] - 1)):
                yield row["conv"], row["depth"], row["leaves"], row["saved"], prefix, depth == row["depth"] - 1

    joined = nodes.join(sequences.select("conv", "ids"), "conv")
    return _rows(joined, "conv long, depth long, leaves long, saved long, prefix string, next boolean", work)


def trie(paths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The nodes of the trie over ``paths`` (conv_id, turns as of ``turns``), one row each, as NODE.

    A node is known by its least conversation and its depth.  The root has depth
    0 and no parent; an empty table has no root.  A conversation without turns
    ends at the root.  n_convs counts members (their sequences start with the
    node's), n_children next turns, n_leaves nodes without children at or below;
    saved_tokens adds up (members - 1) * words of the last turn, at or below;
    ends_sha256 is the digest of the ids of members that end here, ascending and
    joined by commas.  A conversation id that repeats counts as often.
    """
    sequences = written(_sequences(paths), "sequences")
    found = burst(sequences, capacity)
    placed = sequences.join(found.cuts, "conv", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    placed = written(placed, "placed")
    container = F.sha2(F.substring("ids", F.lit(1), (F.col("cut") + 1) * ID), 256).alias("container")
    shards = placed.filter("length > cut").select(container, "cut", "conv", "ids", "words", "n", "ends_sha256")
    swept = _rows(shards.repartition("container").sortWithinPartitions("container", "ids"), f"above string, {NODE}", _sweep)
    swept = written(swept, "swept")
    tops = swept.filter("above IS NOT NULL")

    own = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    below = found.heads.filter("depth > 0").select("conv", "depth", F.lit(0).cast("long").alias("leaves"), own)
    below = below.unionByName(
        tops.select(
            F.col("conv_id").alias("conv"), "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
        )
    )
    above = written(_above(below, sequences), "above")
    sums = above.groupBy("prefix").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("_saved"), F.count_if("next").alias("n_children")
    )
    ends = placed.filter("length = cut").select(F.col("seq").alias("prefix"), "ends_sha256")
    names = found.heads.select(F.col("prefix").alias("above"), F.col("conv").alias("_parent"))
    parents = above.filter("next").select("conv", "depth", F.col("prefix").alias("above")).distinct()
    heads = (
        found.heads.join(sums, "prefix", "left")
        .join(ends, "prefix", "left")
        .join(parents, ["conv", "depth"], "left")
        .join(names, "above", "left")
        .select(
            F.col("conv").alias("conv_id"),
            F.col("depth").cast("long"),
            F.col("_parent").alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("_saved", F.lit(0)) + own).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"),
        )
    )
    known = tops.join(names, "above", "left").withColumn("parent_conv_id", F.col("_parent")).select(heads.columns)
    return heads.unionByName(known).unionByName(swept.filter("above IS NULL").select(heads.columns))
