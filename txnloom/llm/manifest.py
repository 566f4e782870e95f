"""Merkle manifest of a dataset, kept as a persistent tree.

Every row is a leaf.  Within a group (a language) leaves are ordered by key, and
every FANOUT neighbouring nodes become one until a single one is left, the
group's subroot; subroots in the order of their groups become the root in the
same way.

The tree is dealt to aligned blocks of FANOUT ** LEVELS nodes.  One task builds
one block, the tops of the blocks are the nodes of the next, smaller layer, and
so on.  A changed leaf makes a new version of the tree: inside its block only
the ancestors of the leaf are copied, all other nodes are shared with the old
version; the copy of the block's top goes on along the path that the block has
through the layers above, which travels down to the block as text of a few
kilobytes.  So no task ever holds more than a block and one path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.llm.shared import written

# Children of a node, and levels of the tree that one task holds.
FANOUT = 8
LEVELS = 4

_PATH = "array<struct<left:string,right:string>>"


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text, or ``-`` for null."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Node(NamedTuple):
    """A node of one or more versions; nothing ever changes it."""

    digest: str
    children: tuple[Node, ...] = ()


def parent(children: Sequence[Node]) -> Node:
    return Node(sha256("".join([c.digest for c in children]).encode()).hexdigest(), tuple(children))


def height(leaves: int) -> int:
    """Levels above ``leaves`` nodes until one is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def grown(digests: Sequence[str], levels: int) -> Node:
    """The tree of ``levels`` levels above some leaves; a run of one node gets a parent too."""
    nodes = [Node(d) for d in digests]
    for _ in range(levels):
        nodes = [parent(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
    return nodes[0]


def replaced(root: Node, slot: int, digest: str, levels: int) -> list[Node]:
    """A new version in which leaf ``slot`` has another digest.

    Returns the nodes copied for it, from the leaf up to the new root; every
    other node is the old version's own.
    """
    if not levels:
        return [Node(digest)]
    at, rest = divmod(slot, FANOUT ** (levels - 1))
    copied = replaced(root.children[at], rest, digest, levels - 1)
    return [*copied, parent([*root.children[:at], copied[-1], *root.children[at + 1 :]])]


def siblings(root: Node, slot: int, levels: int) -> list[tuple[str, str]]:
    """(left, right) digests beside the way from leaf ``slot`` to the root, lowest level first."""
    if not levels:
        return []
    at, rest = divmod(slot, FANOUT ** (levels - 1))
    sides = tuple("".join([c.digest for c in part]) for part in (root.children[:at], root.children[at + 1 :]))
    return [*siblings(root.children[at], rest, levels - 1), sides]


def folded(digest: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """Digests of the ancestors that a node with these siblings on its path has."""
    out = []
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
        out.append(digest)
    return out


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``position`` of every row in its group, from 0, and the group's ``total``.

    Rows are sorted by ranges, so that a group holding most rows is spread over
    many tasks; the few counts of (group, range) say how many rows stand before
    a range.  Group columns must not be null (wrap them in a struct).
    """
    ranges = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = written(ranges.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    # The id has the number of its range above bit 33 and the place there below.
    placed = placed.withColumn("_range", F.shiftright("_id", 33))
    counts = placed.groupBy(*group, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    all_of = Window.partitionBy(*group)
    before = all_of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *group,
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(all_of).alias("total"),
    )
    joined = placed.join(counts, [*group, "_range"])
    return joined.withColumn("position", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def _block(nodes: pa.Table, most: int) -> tuple[pa.Table, Node, int]:
    """The nodes of a block in order, their tree and its height.

    A group that needs more than ``most`` levels has full blocks of that height
    (the last one is lifted as high); else its only block is as high as it must.
    """
    nodes = nodes.sort_by("position")
    levels = min(most, height(nodes.column("total")[0].as_py()))
    return nodes, grown(nodes.column("digest").to_pylist(), levels), levels


def _by_block(nodes: DataFrame, most: int):
    block = F.floor(F.col("position") / FANOUT**most).cast("long")
    return nodes.withColumn("block", block).groupBy("group", "block")


def _tops(nodes: DataFrame, most: int) -> DataFrame:
    """The layer above: one node for each block."""

    def build(block: pa.Table) -> pa.Table:
        nodes, root, _ = _block(block, most)
        first = nodes.slice(0, 1).to_pylist()[0]
        top = (first["group"], first["block"], -(-first["total"] // FANOUT**most), root.digest)
        return pa.table({n: [v] for n, v in zip(("group", "position", "total", "digest"), top, strict=True)})

    return _by_block(nodes.select("group", "position", "total", "digest"), most).applyInArrow(
        build, "group long, position long, total long, digest string"
    )


def _layers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All layers from ``nodes`` up to one node per group; each is a written table."""
    layers = [nodes]
    while True:
        layers.append(written(_tops(layers[-1], most), "manifest"))
        if (layers[-1].agg(F.max("total")).first()[0] or 0) <= 1:
            return layers


def _with_paths(
    nodes: DataFrame, paths: DataFrame, out: str, rows: Callable[[pa.Table, dict], Iterator[tuple]], most: int
) -> DataFrame:
    """Rows that ``rows`` makes of every block of ``nodes`` and the block's own row of ``paths``."""
    names = T._parse_datatype_string(out).fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(out))

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        columns = zip(*rows(block, above.to_pylist()[0]), strict=True)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=names)

    upper = paths.withColumnRenamed("position", "block").groupBy("group", "block")
    return _by_block(nodes, most).cogroup(upper).applyInArrow(run, out)


def _descended(nodes: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """Paths of the nodes of a layer, from those of the layer above."""

    def rows(block: pa.Table, above: dict) -> Iterator[tuple]:
        nodes, root, levels = _block(block, most)
        upper = [(s["left"], s["right"]) for s in above["path"]]
        for slot, position in enumerate(nodes.column("position").to_pylist()):
            path = [*siblings(root, slot, levels), *upper]
            yield above["group"], position, [{"left": a, "right": b} for a, b in path], above["subroot"], above["root"]

    out = f"group long, position long, path {_PATH}, subroot string, root string"
    return written(_with_paths(nodes, paths, out, rows, most), "manifest-paths")


class Manifest:
    """The tree of one version of a dataset.

    ``leaves`` has group (number of the group in order), position, total, the
    group's value, key, digest and, where the row is to change, ``changed``.
    """

    def __init__(
        self,
        docs: DataFrame,
        key: str,
        group: str,
        columns: Sequence[str],
        changed: Mapping[str, Column] | None = None,
        levels: int = LEVELS,
    ):
        """Rows of equal key are ordered by their digests; null keys and groups come first.

        ``changed`` maps columns to their changed values; a row counts as changed
        when its digest is another one then.  All other columns are left out, so
        their names cannot clash.
        """
        self._levels = levels
        before, changes = leaf([F.col(c) for c in columns]), changed or {}
        after = leaf([changes.get(c, F.col(c)) for c in columns])
        rows = docs.select(
            F.struct(F.col(group).alias("value")).alias("_group"),
            F.struct(F.col(key).alias("value")).alias("_key"),
            before.alias("digest"),
            (after if changes else F.lit(None).cast("string")).alias("_after"),
        )
        changed_digest = F.when(F.col("_after") != F.col("digest"), F.col("_after")).alias("changed")
        rows = written(rows.select("_group", "_key", "digest", changed_digest), "leaves")
        groups = numbered(rows.select("_group").distinct(), [], ["_group"])
        groups = written(groups.select("_group", F.col("position").alias("group"), F.col("total").alias("_groups")), "groups")
        placed = numbered(rows, ["_group"], ["_key", "digest"]).join(groups, "_group")
        self.leaves = written(
            placed.select("group", "position", "total", "_groups", "_key", "digest", "changed"), "placed"
        )
        self._below = _layers(self.leaves, levels)
        counts = groups.select("group", "_groups")
        subroots = self._below[-1].join(counts, "group").select(
            F.lit(0).cast("long").alias("group"), F.col("group").alias("position"), F.col("_groups").alias("total"), "digest"
        )
        self._above = _layers(written(subroots, "subroots"), levels)

    def root(self) -> str | None:
        """The digest of all; None for an empty dataset."""
        top = self._above[-1].select("digest").first()
        return top[0] if top else None

    def paths(self) -> DataFrame:
        """group, position (of a block of leaves), path, subroot and root."""
        none = F.array().cast(_PATH).alias("path")
        paths = self._above[-1].select("group", "position", none, F.lit("").alias("subroot"), F.col("digest").alias("root"))
        for layer in reversed(self._above[:-1]):
            paths = _descended(layer, paths, self._levels)
        subroots = self._above[0].select("position", F.col("digest").alias("subroot"))
        paths = paths.drop("subroot").join(subroots, "position")
        paths = paths.select(F.col("position").alias("group"), F.lit(0).cast("long").alias("position"), "path", "subroot", "root")
        for layer in reversed(self._below[1:-1]):
            paths = _descended(layer, paths, self._levels)
        return paths

    def audit(self, key: str = "doc_id", keep_proofs: bool = False) -> DataFrame:
        """Every row with its proof, and the version that its change makes.

        Returns ``key``, leaf, subroot, root, proof_sha256 (digest of all
        siblings on the way up, left to right, level by level), copied (digests
        of the nodes that the row's version does not share, from the leaf up to
        its root; null for an unchanged row), folded_root (the root that the row
        as it is now leads to) and verified (whether that is still the root).
        ``keep_proofs`` adds proof, the siblings themselves as text.
        """

        most = self._levels

        def rows(block: pa.Table, above: dict) -> Iterator[tuple]:
            nodes, root, levels = _block(block, most)
            upper = [(s["left"], s["right"]) for s in above["path"]]
            rest = "".join([a + b for a, b in upper])
            keys, changes = (nodes.column(n).to_pylist() for n in ("_key", "changed"))
            for slot, (row, change) in enumerate(zip(keys, changes, strict=True)):
                way = siblings(root, slot, levels)
                proof = "".join([a + b for a, b in way]) + rest
                copied = None
                if change is not None:
                    copied = [n.digest for n in replaced(root, slot, change, levels)]
                    copied += folded(copied[-1], upper)
                yield (
                    row["value"],
                    nodes.column("digest")[slot].as_py(),
                    above["subroot"],
                    above["root"],
                    sha256(proof.encode()).hexdigest(),
                    copied,
                    copied[-1] if copied else above["root"],
                    not copied or copied[-1] == above["root"],
                    *([proof] if keep_proofs else []),
                )

        kind = self.leaves.schema["_key"].dataType["value"].dataType.simpleString()
        out = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, copied array<string>, "
        out += "folded_root string, verified boolean" + (", proof string" if keep_proofs else "")
        return _with_paths(self.leaves, self.paths(), out, rows, most)


def audit(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    changed: Mapping[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``Manifest.audit`` of a table and of one changed version for each row that ``changed`` alters.

    Null values, empty and very long texts are leaves like others; repeated rows
    are leaves of their own; an empty table has no rows and no root.
    """
    return Manifest(docs, key, group, columns, changed, levels).audit(key)
