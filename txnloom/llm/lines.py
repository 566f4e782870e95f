"""Removal of repeated blocks of lines by content-defined chunks.

A rolling hash over the hashes of the last WINDOW lines says where a text is
cut: the boundaries depend on the lines beside them only, so text inserted or
removed elsewhere moves none of them.  A piece between two boundaries that has
LEAST_LINES lines or more is a chunk; a shorter one is a chunk together with the
piece behind it (the last one with the piece before it), so that every chunk is
a block of several lines and none is left out.  Chunks that occur again anywhere
meet by a hash and count as equal only if their bytes are; the first occurrence
stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txnloom.llm.shared import ROWS_AT_ONCE, other_fields, written

# Lines with a word that the rolling hash covers.
WINDOW = 2
# One of so many places is no boundary; passages of two lines are found the more often the more there are.
DIVISOR = 8
# Lines with a word that make a chunk of one piece.
LEAST_LINES = 2

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_OUT = pow(_BASE, WINDOW, 1 << 64)


def cuts(hashes: list[int]) -> list[int]:
    """Ends of the pieces, as numbers of lines, from the hashes of a text's lines with a word."""
    roll, out = 0, []
    for n, value in enumerate(hashes, 1):
        gone = hashes[n - 1 - WINDOW] if n > WINDOW else 0
        roll = (roll * _BASE + value - gone * _OUT) & _MASK
        # Mixed, as the low bits of a product depend on few bits of it.
        if ((roll ^ roll >> 32) * _BASE & _MASK) >> 48 & (DIVISOR - 1):
            out.append(n)
    if hashes and (not out or out[-1] < len(hashes)):
        out.append(len(hashes))
    return out


def chunks(text: str | None) -> list[tuple[int, int, str]]:
    """(first line, end line, bytes as text) of every chunk, with the blank lines inside it."""
    if not text:
        return []
    lines = text.split("\n")
    at = [n for n, line in enumerate(lines) if line and not line.isspace()]
    ends = cuts([xxhash.xxh3_64_intdigest(lines[n].encode()) for n in at])
    found = set()
    for k, end in enumerate(ends):
        start = ends[k - 1] if k else 0
        if end - start < LEAST_LINES:
            if k + 1 < len(ends):
                end = ends[k + 1]
            else:
                start = ends[k - 2] if k > 1 else 0
        if end - start >= LEAST_LINES:
            found.add((at[start], at[end - 1] + 1))
    return [(first, end, "\n".join(lines[first:end])) for first, end in sorted(found)]


def _rows(df: DataFrame, schema: str, make_rows) -> DataFrame:
    """Rows that ``make_rows`` derives from each input row, a few texts at a time."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                found = [r for row in batch.slice(at, ROWS_AT_ONCE).to_pylist() for r in make_rows(row)]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], arrow)

    return df.mapInArrow(run, schema)


def _hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode()) - (1 << 63)


def without(text: str, leaving: list[int], staying: list[int]) -> tuple[str, int]:
    """The text without the lines of its ``leaving`` chunks that no ``staying`` one has, and their number."""
    blocks = chunks(text)
    drop = {n for k in leaving for n in range(*blocks[k][:2])} - {n for k in staying for n in range(*blocks[k][:2])}
    return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop), len(drop)


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed_lines") -> DataFrame:
    """Take repeated chunks out of ``text`` and add the number of lines taken.

    Of equal chunks the one with the least (key, place) stays whole; nulls come
    before all keys.  A line goes if a chunk it stands in goes and none that
    stays has it.  Rows equal in key and text are one document and lose the same
    lines.  A null or empty text stays as it is with 0; a text may become empty.
    A column already named ``removed`` is replaced, all others pass unchanged
    whatever their names; an empty table stays empty.
    """
    kept = [f.name for f in other_fields(docs, [removed])]
    others = [n for n in kept if n != text]
    named = docs.select(
        F.struct(*others).alias("row"),
        F.col(text).alias("text"),
        F.struct(F.col(key).alias("key"), F.xxhash64(key, text).alias("hash")).alias("doc"),
    )
    kind = named.schema["doc"].dataType.simpleString()

    def places(row: dict) -> Iterator[tuple]:
        return ((row["of"], k, _hash(c[2])) for k, c in enumerate(chunks(row["text"])))

    # Chunks of documents that share a hash only are candidates too many: bytes decide.
    found = _rows(named.select(F.col("doc.hash").alias("of"), "text"), "of bigint, chunk int, hash bigint", places)
    again = found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    listed = found.join(again, "hash", "left_semi").groupBy("of").agg(F.collect_set("chunk").alias("chunks"))
    marked = written(named.join(listed, named["doc.hash"] == listed["of"], "left").drop("of"), "lines")
    affected = marked.filter("chunks IS NOT NULL")

    def contents(row: dict) -> Iterator[tuple]:
        blocks = chunks(row["text"])
        return ((row["doc"], k, blocks[k][2]) for k in row["chunks"])

    repeated = _rows(affected.select("doc", "chunks", "text"), f"doc {kind}, chunk int, body string", contents)
    place = F.struct("doc", "chunk")
    places_of = repeated.groupBy("body").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Equal rows are one document: what only they have does not occur again.
    first = places_of.select("first.*", (F.col("first") != F.col("last")).alias("again"))
    staying = first.groupBy("doc").agg(
        F.collect_set("chunk").alias("firsts"), F.collect_set(F.when(F.col("again"), F.col("chunk"))).alias("stay")
    )
    none = F.array().cast("array<int>")
    decided = affected.join(staying, "doc", "left")
    leave = F.array_except("chunks", F.coalesce("firsts", none)).alias("leave")
    decided = decided.select("row", "text", leave, F.coalesce("stay", none).alias("stay"))
    schema = T.StructType([decided.schema["row"], T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "leave", "stay")), strict=True)
                done = [without(*r) if r[1] else (r[0], 0) for r in rows]
                columns = [part.column("row"), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n"])

    same = marked.filter("chunks IS NULL").select("row", "text", F.lit(0).alias("n"))
    left = decided.mapInArrow(strip, schema).unionByName(same)
    return left.select(*[F.col("text").alias(n) if n == text else F.col(f"row.`{n}`") for n in kept], F.col("n").alias(removed))
