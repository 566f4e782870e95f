"""Best-fit packing of token sequences by bin completion.

Pieces are dealt by hash into shards of about ``SHARD`` pieces, so shards are
even whatever the data.  A shard first packs best-fit decreasing.  If that uses
more bins than the lower bound, a branch-and-bound looks for fewer: it fills
one bin at a time around the largest piece left, tries the undominated fillings
of the room beside it, and gives up a branch when its waste exceeds what a
better solution may waste.  The best-fit packing is the first incumbent.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from txnloom.llm.shared import ROWS_AT_ONCE, other_fields

CAPACITY = 2048
# Pieces that are packed together; at most one bin of a shard stays open.
SHARD = 4096
# Bounds on the work of a search: bins opened beyond those of one packing,
# fillings looked at and kept for one bin.  Beyond them the incumbent stands.
OPENED = 3000
LOOKED_AT = 150
KEPT = 6
# Characters on which the fast and the reference splitter surely agree.
PLAIN = regex.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")


class Ids:
    """Ids of whole texts as ``tokenizers`` gives them, without special tokens added.

    Text that holds the name of an added token, or characters whose class the
    two libraries may see differently, goes to ``tokenizers`` itself; the rest
    to the faster byte-pair library with the same vocabulary.
    """

    def __init__(self, path: str, pattern: str):
        self.reference = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.added = [t["content"] for t in model.get("added_tokens", ())]
        visible = self._visible_bytes()
        ranks = {
            bytes(visible[c] for c in token): rank
            for token, rank in model["model"]["vocab"].items()
            if token not in self.added
        }
        self.fast = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _visible_bytes() -> dict[str, int]:
        """Byte of each character that byte-level vocabularies write for it.

        Printable bytes stand for themselves, the others for characters from 256 on.
        """
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(name in text for name in self.added):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.reference.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def ids_of(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def pieces(
    df: DataFrame, path: str, pattern: str, text: str = "text", end_id: int = 0, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece of each text: other columns, piece, start, length, ids, ids_crc32.

    A text is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    One of more than ``capacity`` ids is cut so that only its first piece may be
    shorter.  The text column goes; a column named like an output is replaced.
    """
    fields = [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_crc32", T.LongType()),
    ]
    kept = other_fields(df, [text, *(f.name for f in fields)])
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])

    def cut(batch: pa.RecordBatch, encode: Ids) -> pa.RecordBatch:
        row, number, start, ids = [], [], [], []
        for i, value in enumerate(batch.column(text).to_pylist()):
            whole = np.append(encode(value or ""), np.uint32(end_id)).astype("<u4")
            first = (len(whole) - 1) % capacity + 1
            for k, at in enumerate([0, *range(first, len(whole), capacity)]):
                row.append(i)
                number.append(k)
                start.append(at)
                ids.append(whole[at : first if k == 0 else at + capacity])
        lengths = np.array([len(x) for x in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        new = [
            pa.array(number, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(lengths),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
        ]
        old = batch.select(names).take(pa.array(row, pa.int64())) if names else None
        return pa.RecordBatch.from_arrays([*(old.columns if old else ()), *new], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield cut(batch.slice(at, ROWS_AT_ONCE), encode)

    return df.mapInArrow(run, schema)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces that exclude each other.

    For each k up to half the capacity, pieces over ``capacity - k`` stay alone,
    those over half need a bin each, and what pieces of k and more do not find
    beside the latter needs further bins.
    """
    total = sum(size * n for size, n in counts.items())
    best = -(-total // capacity)
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[s] for s in sizes.tolist()], np.int64)
    for k in [0, *(int(s) for s in sizes if 2 * s <= capacity)]:
        alone = sizes > capacity - k
        large = ~alone & (2 * sizes > capacity)
        small = ~alone & ~large & (sizes >= k)
        room = capacity * number[large].sum() - (sizes * number)[large].sum()
        rest = (sizes * number)[small].sum() - room
        best = max(best, int(number[alone].sum() + number[large].sum() + max(0, -(-int(rest) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Largest pieces first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fitting = rooms >> size
            if fitting:
                room = (fitting & -fitting).bit_length() - 1 + size
                where = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, where = capacity, len(bins)
                bins.append([])
            bins[where].append(size)
            by_room.setdefault(room - size, []).append(where)
            rooms |= 1 << (room - size)
    return [tuple(b) for b in bins]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit into the places of the pieces of ``a``."""
    if not b:
        return True
    tried = set()
    for i, place in enumerate(a):
        if place >= b[0] and place not in tried:
            tried.add(place)
            left = (place - b[0],) if place > b[0] else ()
            if dominates(tuple(sorted((*a[:i], *a[i + 1 :], *left), reverse=True)), b[1:]):
                return True
    return False


def fillings(counts: dict[int, int], sizes: list[int], room: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated sets of pieces for ``room`` that leave at most ``waste``, fullest first."""
    found: list[tuple[int, tuple[int, ...]]] = []
    looked, falling = 0, [-s for s in sizes]

    def grow(at: int, left: int, chosen: tuple[int, ...]) -> bool:
        """Extend by pieces from ``sizes[at]`` down; False ends the enumeration."""
        nonlocal looked
        looked += 1
        maximal = True
        for i in range(max(at, bisect_left(falling, -left)), len(sizes)):
            size = sizes[i]
            if chosen.count(size) >= counts[size]:
                continue
            maximal = False
            if not grow(i, left - size, (*chosen, size)):
                return False
        if maximal and left <= waste:
            found.append((left, chosen))
        return looked < LOOKED_AT and not (maximal and left == 0 and len(found) >= KEPT)

    grow(0, room, ())
    found.sort(key=lambda f: (f[0], [-s for s in f[1]]))
    kept: list[tuple[int, ...]] = []
    for _, chosen in found:
        if not any(dominates(k, chosen) for k in kept):
            kept.append(chosen)
            if len(kept) == KEPT:
                break
    return kept


def complete(counts: dict[int, int], capacity: int, bins_used: int) -> list[tuple[int, ...]] | None:
    """A packing into fewer than ``bins_used`` bins, or None if the search ends without one."""
    total = sum(size * n for size, n in counts.items())
    left = dict(counts)
    spare = (bins_used - 1) * capacity - total
    if spare < 0:
        return None
    path: list[tuple[tuple[int, ...], Iterator[tuple[int, ...]], int]] = []
    opened = 0

    def options(spare: int) -> tuple[int, Iterator[tuple[int, ...]]]:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        largest = sizes[0]
        left[largest] -= 1
        rest = [s for s in sizes if left[s]]
        sets = fillings(left, rest, capacity - largest, spare)
        left[largest] += 1
        return largest, iter(sets)

    largest, tries = options(spare)
    while opened < OPENED + bins_used:
        chosen = next(tries, None)
        if chosen is None:
            if not path:
                return None
            used, tries, spare = path.pop()
            largest = used[0]
            for size in used:
                left[size] += 1
            continue
        opened += 1
        used = (largest, *chosen)
        for size in used:
            left[size] -= 1
        path.append((used, tries, spare))
        spare -= capacity - sum(used)
        if not any(left.values()):
            return [p[0] for p in path]
        largest, tries = options(spare)
    return None


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Bins (the sizes in each) for ``counts`` pieces of each size."""
    full = [(capacity,)] * counts.get(capacity, 0)
    counts = {size: n for size, n in counts.items() if size != capacity}
    bins = best_fit(counts, capacity)
    target = lower_bound(counts, capacity) if counts else 0
    while len(bins) > target:
        better = complete(counts, capacity, len(bins))
        if better is None:
            break
        bins = better
    return full + bins


def pack(
    df: DataFrame, keys: list[str], rows_expected: int, length: str = "length", capacity: int = CAPACITY
) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` tokens.

    About ``rows_expected`` rows go to shards by the hash of ``keys``, length
    and partition, so that repeated rows and null keys spread as well.  Null or
    non-positive lengths get a null place, lengths over ``capacity`` fail.  An
    empty table stays empty; columns named like an output are replaced.
    """
    shards = max(1, -(-rows_expected // SHARD))
    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    kept = other_fields(df, ["sequence_id", "offset"])
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])
    dealt = F.xxhash64(*keys, length, F.spark_partition_id())
    shard = "_shard"
    while shard in {n.lower() for n in df.columns}:
        shard += "_"
    rows = df.select(names).withColumn(shard, F.pmod(dealt, F.lit(shards)))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows[length].to_numpy(np.float64, na_value=0)
        if (sizes > capacity).any():
            raise ValueError(f"a piece is longer than {capacity}")
        waiting: dict[int, list[int]] = {}
        for i, size in enumerate(sizes.astype(np.int64).tolist()):
            if size > 0:
                waiting.setdefault(size, []).append(i)
        sequence, offset = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        for number, used in enumerate(pack_counts({s: len(w) for s, w in waiting.items()}, capacity)):
            at = 0
            for size in used:
                i = waiting[size].pop()
                sequence[i], offset[i] = (int(key[0]) << 31) + number, at
                at += size
        out = rows[names].copy()
        out["sequence_id"] = pd.array(np.where(sequence < 0, 0, sequence), "Int64")
        out["offset"] = pd.array(offset, "Int64")
        out.loc[sequence < 0, ["sequence_id", "offset"]] = pd.NA
        return out

    return rows.groupBy(shard).applyInPandas(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, its ids in order, and the doc of each piece."""
    gathered = placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts")
    )
    return gathered.select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("sources"),
    )
