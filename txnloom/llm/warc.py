"""Fixity audit of WARC replicas by Merkle trees.

Records are leaves.  The records that start in one range of offsets of a file
make a node, neighbouring ranges make the next one, up to the file and, by
neighbouring files, up to the replica's root.  Two replicas with one root are
equal; else only children of nodes that differ are compared, level by level,
until the records that differ are found.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnloom.llm.shared import written

RECORDS_PER_FILE = 1000
# Bytes of a file that make one lowest node, and children of each higher node.
RANGE = 1 << 16
FANOUT = 16

_LENGTH = re.compile(rb"^content-length:\s*(\d+)\s*$", re.IGNORECASE | re.MULTILINE)


def records(pages: DataFrame, rows_expected: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One resource record per page, dealt to files, with its place there.

    Adds file, offset, length and data (the record's bytes) to ``key``.  Null
    address or body count as empty.  Rows are dealt by hash, repeated rows also
    by partition, so that every file holds about RECORDS_PER_FILE.  As the place
    of equal rows depends on the partitions, write the result before using it
    twice.
    """
    files = max(1, -(-rows_expected // RECORDS_PER_FILE))
    address, content = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(key).cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        address,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    dealt = F.pmod(F.xxhash64(key, url, body, F.spark_partition_id()), F.lit(files)).alias("file")
    rows = pages.select(F.col(key), F.encode(F.concat(head, content, F.lit("\r\n\r\n")), "UTF-8").alias("data"), dealt)
    rows = rows.withColumn("length", F.octet_length("data").cast("long"))
    before = Window.partitionBy("file").orderBy(F.col(key), F.xxhash64("data"))
    end = F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("offset", end - F.col("length")).select(key, "file", "offset", "length", "data")


def parse(files: DataFrame) -> DataFrame:
    """Records of WARC files read as binaryFile (columns path, content).

    Returns path, offset, length and data of every record, gzip members
    unpacked first (offsets then count unpacked bytes).  A record whose header
    has no length, or that the file cuts short, ends the file with the rest as
    its data.  Null contents have no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw = content or b""
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                at, found = 0, []
                while at < len(raw):
                    end = raw.find(b"\r\n\r\n", at)
                    size = _LENGTH.search(raw, at, end) if end >= 0 else None
                    stop = min(len(raw), end + 4 + int(size[1]) + 4) if size else len(raw)
                    found.append({"path": path, "offset": at, "length": stop - at, "data": raw[at:stop]})
                    at = stop
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])
    return files.select("path", "content").mapInArrow(run, "path string, offset bigint, length bigint, data binary")


class Tree:
    """Digests of one replica, level 0 being records; all levels are written tables."""

    def __init__(self, records: DataFrame):
        """``records`` has file, offset and data; places that occur twice are one leaf of both digests.

        Null data count as empty; rows with a null file or offset have no place
        and raise.
        """
        digest = F.sha2(F.coalesce(F.col("data"), F.lit(b"")), 256)
        placed = records.select(
            F.when(F.col("file").isNull() | F.col("offset").isNull(), F.raise_error(F.lit("a record has no place")))
            .otherwise(F.col("file"))
            .cast("long")
            .alias("file"),
            F.col("offset").cast("long").alias("node"),
            digest.alias("digest"),
        )
        leaves = placed.groupBy("file", "node").agg(F.array_join(F.array_sort(F.collect_set("digest")), "").alias("digest"))
        self.levels = [written(leaves, "merkle")]
        self.steps: list[tuple[str, int]] = []
        self._grow("node", RANGE)
        while self._most("node") > 0:
            self._grow("node", FANOUT)
        while self._most("file") > 0:
            self._grow("file", FANOUT)

    def _most(self, column: str) -> int:
        return self.levels[-1].agg(F.max(column)).first()[0] or 0

    def _grow(self, column: str, width: int) -> None:
        parent = F.floor(F.col(column) / width).cast("long")
        keys = [parent.alias(c) if c == column else F.col(c) for c in ("file", "node")]
        ordered = F.array_sort(F.collect_list(F.struct(F.col(column).alias("at"), "digest")))
        joined = F.transform(ordered, lambda c: F.concat(c["at"].cast("string"), F.lit(":"), c["digest"]))
        level = self.levels[-1].groupBy(*keys).agg(F.sha2(F.array_join(joined, ","), 256).alias("digest"))
        self.levels.append(written(level, "merkle"))
        self.steps.append((column, width))

    def root(self) -> str | None:
        top = self.levels[-1].select("digest").first()
        return top[0] if top else None


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places where two replicas differ: file, offset and status.

    Status is ``changed``, ``missing`` (in ``right``) or ``extra`` (in
    ``right`` only).  Equal replicas, empty ones too, give no row.
    """
    a, b = Tree(left), Tree(right)
    found = a.levels[0].select("file", "node", F.lit("changed").alias("status")).limit(0)
    if a.root() != b.root():
        # The trees may differ in height; their equal steps cover the same ranges.
        depth = min(len(a.levels), len(b.levels))
        while a.steps[: depth - 1] != b.steps[: depth - 1]:
            depth -= 1
        parents = None
        for level in range(depth - 1, -1, -1):
            sides = [t.levels[level].withColumnRenamed("digest", n) for t, n in ((a, "_left"), (b, "_right"))]
            if parents is not None:
                column, width = a.steps[level]
                up = [F.floor(F.col(c) / width).cast("long").alias(f"_{c}") if c == column else F.col(c).alias(f"_{c}") for c in ("file", "node")]
                marks = parents.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
                sides = [s.select("*", *up).join(marks, ["_file", "_node"], "left_semi").drop("_file", "_node") for s in sides]
            both = sides[0].join(sides[1], ["file", "node"], "full")
            parents = both.filter(~F.col("_left").eqNullSafe(F.col("_right")))
        status = F.when(F.col("_right").isNull(), "missing").when(F.col("_left").isNull(), "extra").otherwise("changed")
        found = parents.select("file", "node", status.alias("status"))
    return found.withColumnRenamed("node", "offset")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``primary`` with its status in ``replica``, data left out.

    ``status`` is intact, changed or missing; a column of that name is replaced.
    Records only in ``replica`` are not listed, see ``mismatches``.
    """
    bad = mismatches(primary, replica).filter("status <> 'extra'")
    rest = primary.drop("data", "status")
    return rest.join(bad, ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
