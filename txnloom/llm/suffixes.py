"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of WIDTH bytes around it starts at another place too.
Such a string holds the leftmost of its least hashed GRAM-byte windows, its
anchor, at the same offset in both places.  So only anchors whose gram occurs
twice matter, and for each of them the suffix that starts at the anchor, with
the bytes before it in reverse behind it.

Every task sorts the suffixes of its documents into one run per range of gram
hashes and sends it front-coded: the length shared with the suffix before, and
the rest.  The receiving task merges the runs with a loser tree that knows how
much each head shares with the last winner and compares bytes beyond that only.
Its output is sorted and carries common prefixes, so equal contexts fall
together and the suffixes of one gram are a run of common prefixes of GRAM or
more.  Within that run the strings around an anchor that occur elsewhere follow
from the shared lengths to both sides.

Grams of very many places do not gather in one task: their strings are reduced
to digests in the sending task, where repeats are settled at once, and only one
row per task and string is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.llm.shared import other_fields, written

WIDTH = 200
GRAM = 40
#: Offsets an anchor can have inside a string, less one.
REACH = WIDTH - GRAM
# Places of a gram beyond which its strings are exchanged as digests.
FREQUENT = 1000
# Ranges of gram hashes for each shuffle partition, and bounds on what a task
# holds before it sends a run (suffixes) or settles strings (digests).
RANGES = 3
RUN = 60_000
DIGESTS = 400_000
# Contexts of one gram that are compared pair by pair in plain code, and in
# arrays; more are compared by sorting once for each offset.
FEW = 12
PAIRWISE = 48

_MULTIPLIERS = np.random.default_rng(40).integers(1 << 62, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_BYTES = np.random.default_rng(41).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_KNOWN_POWERS: dict[int, np.ndarray] = {}
_KEY = WIDTH + REACH + 2


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _powers(base: int, count: int) -> np.ndarray:
    """base to the powers 0, 1, ... modulo 2^64, kept from call to call."""
    known = _KNOWN_POWERS.setdefault(base, np.ones(1, np.uint64))
    while len(known) < count:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        _KNOWN_POWERS[base] = known
    return known[:count]


def _rolling(data: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hashes of all windows of ``width`` bytes.

    The sum of byte * base^place over a window is a difference of prefix sums;
    dividing it by base^start makes equal windows equal.
    """
    if len(data) < width:
        return np.empty(0, np.uint64)
    base = int(_MULTIPLIERS[family])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[family][data] * _powers(base, len(data)), out=sums[1:])
    windows = sums[width:] - sums[:-width]
    return _mixed(windows * _powers(pow(base, -1, 1 << 64), len(windows)))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray) -> np.ndarray:
    """Places whose gram hash is the least of some string that holds them."""
    if len(grams) <= REACH:
        return np.empty(0, np.int64)
    least = _sliding(grams, REACH + 1, np.minimum)
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    return np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == grams)


def _bytes(value: str | None) -> np.ndarray:
    return np.frombuffer((value or "").encode(), np.uint8)


def _contexts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One key per anchor: bytes from it on, bytes before it in reverse, both lengths."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WIDTH, np.uint8)])
    keys = np.empty((len(places), _KEY), np.uint8)
    keys[:, :WIDTH] = padded[places[:, None] + REACH + np.arange(WIDTH)]
    keys[:, WIDTH : WIDTH + REACH] = padded[places[:, None] + REACH - 1 - np.arange(REACH)]
    keys[:, -2] = np.minimum(len(data) - places, WIDTH)
    keys[:, -1] = np.minimum(places, REACH)
    return keys


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared lengths with the key before, and the rests joined, of sorted unequal keys."""
    grid = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), _KEY)
    shared = np.zeros(len(keys), np.uint16)
    if len(keys) > 1:
        shared[1:] = (grid[1:] != grid[:-1]).argmax(axis=1)
    return shared, b"".join(key[n:] for key, n in zip(keys, shared.tolist(), strict=True))


class Run:
    """A sorted front-coded run, read one key at a time."""

    def __init__(self, shared: np.ndarray, rest: bytes, counts: np.ndarray, documents: np.ndarray, places: np.ndarray):
        self.shared, self.rest = shared.tolist(), rest
        self.ends = np.cumsum(counts).tolist()
        self.documents, self.places = documents, places
        self.at, self.read, self.key = -1, 0, b""

    def advance(self) -> int:
        """Move to the next key; its shared length with the one before, or -1 at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return -1
        same = self.shared[self.at]
        end = self.read + _KEY - same
        self.key = self.key[:same] + self.rest[self.read : end]
        self.read = end
        return same

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.ends[self.at - 1] if self.at else 0, self.ends[self.at])
        return self.documents[here], self.places[here]


def _shared_length(a: bytes, b: bytes, known: int) -> int:
    """How many leading bytes agree, of which ``known`` are known to."""
    step = 16
    while known < _KEY:
        if a[known : known + step] == b[known : known + step]:
            known += step
            continue
        while known < _KEY and a[known] == b[known]:
            known += 1
        break
    return min(known, _KEY)


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, Run]]:
    """Keys of all runs in order, with the length shared with the key before.

    A tree of losers: every inner node holds the run that lost there and the
    length its key shares with the key that won.  A challenger that shares more
    with the last winner is smaller, one that shares less is larger; only equal
    lengths need bytes, from that length on.  The run must not move before the
    caller has used it.
    """
    size = 1
    while size < len(runs):
        size *= 2
    # (shared, run number); a run that has ended shares -1 and loses to all.
    heads = [runs[i].advance() if i < len(runs) else -1 for i in range(size)]

    def duel(a: int, shared_a: int, b: int, shared_b: int) -> tuple[int, int, int, int]:
        """(winner, its length, loser, the loser's length shared with the winner)."""
        if shared_a > shared_b:
            return a, shared_a, b, shared_b
        if shared_b > shared_a:
            return b, shared_b, a, shared_a
        if shared_a < 0:
            return a, -1, b, -1
        one, two = runs[a].key, runs[b].key
        same = _shared_length(one, two, shared_a)
        if same == _KEY or one[same] < two[same]:
            return a, shared_a, b, same
        return b, shared_b, a, same

    losers: list[tuple[int, int]] = [(0, -1)] * size
    winners: list[tuple[int, int]] = [(0, -1)] * size + [(i, min(heads[i], 0)) for i in range(size)]
    for node in range(size - 1, 0, -1):
        won, length, lost, other = duel(*winners[2 * node], *winners[2 * node + 1])
        winners[node], losers[node] = (won, length), (lost, other)
    best, shared = winners[1]
    while shared >= 0:
        yield runs[best].key, shared, runs[best]
        challenger, length = best, runs[best].advance()
        node = (best + size) // 2
        while node:
            challenger, length, lost, other = duel(challenger, length, *losers[node])
            losers[node] = (lost, other)
            node //= 2
        best, shared = challenger, length


def _few_extremes(keys: list[bytes], counts: list[int], shared: list[int]) -> list[tuple[int, int]]:
    """``extremes`` of a few contexts, pair by pair from the lengths the merge knows."""
    found = []
    for key, count in zip(keys, counts, strict=True):
        low, high = max(0, WIDTH - key[-2]), min(REACH, key[-1])
        found.append([low, high] if count > 1 and low <= high else [WIDTH, -1])
    for i, one in enumerate(keys):
        right = WIDTH
        for j in range(i + 1, len(keys)):
            two = keys[j]
            right = min(right, shared[j])
            low = WIDTH - min(right, one[-2], two[-2])
            if low > REACH:
                continue
            both = _shared_length(one, two, WIDTH) - WIDTH if one[WIDTH] == two[WIDTH] else 0
            high = min(both, REACH, one[-1], two[-1])
            if low <= high:
                for span in (found[i], found[j]):
                    span[0], span[1] = min(span[0], low), max(span[1], high)
    return [(low, high) if high >= 0 else (1, 0) for low, high in found]


def extremes(keys: list[bytes], counts: list[int], shared: list[int]) -> list[tuple[int, int]]:
    """Least and greatest offset of a repeated string around the anchor of each context.

    ``keys`` are the distinct contexts of one gram in order, ``counts`` how
    often each occurs, ``shared`` the length each shares with the one before.
    An offset o stands for the string of WIDTH bytes that starts o bytes before
    the anchor; (1, 0) if none is repeated.
    """
    if len(keys) <= FEW:
        return _few_extremes(keys, counts, shared)
    grid = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), _KEY)
    right, left = grid[:, -2].astype(np.int64), grid[:, -1].astype(np.int64)
    low, high = np.maximum(0, WIDTH - right), np.minimum(REACH, left)
    again = np.array(counts) > 1
    first, last = np.where(again, low, WIDTH), np.where(again, high, -1)
    last = np.where(first > last, -1, last)
    first = np.where(last < 0, WIDTH, first)
    if len(keys) <= PAIRWISE:
        ahead, behind = grid[:, :WIDTH], grid[:, WIDTH : WIDTH + REACH]
        for i in range(len(keys) - 1):
            r = _agreeing(ahead[i + 1 :] != ahead[i], WIDTH)
            l = _agreeing(behind[i + 1 :] != behind[i], REACH)
            r = np.minimum(r, np.minimum(right[i], right[i + 1 :]))
            l = np.minimum(l, np.minimum(left[i], left[i + 1 :]))
            start, end = np.maximum(0, WIDTH - r), l
            hit = start <= end
            if hit.any():
                first[i], last[i] = min(first[i], start[hit].min()), max(last[i], end[hit].max())
                others = np.flatnonzero(hit) + i + 1
                first[others] = np.minimum(first[others], start[hit])
                last[others] = np.maximum(last[others], end[hit])
    else:
        ahead = _classes(grid[:, :WIDTH])
        behind = _classes(grid[:, WIDTH : WIDTH + REACH])
        for o in range(REACH + 1):
            fit = np.flatnonzero((left >= o) & (right >= WIDTH - o))
            if len(fit) < 2:
                continue
            pair = ahead[WIDTH - o][fit] * np.int64(len(keys)) + (behind[o][fit] if o else 0)
            _, where, number = np.unique(pair, return_inverse=True, return_counts=True)
            hit = fit[number[where] > 1]
            first[hit], last[hit] = np.minimum(first[hit], o), np.maximum(last[hit], o)
    return [(int(a), int(b)) if b >= 0 else (1, 0) for a, b in zip(first, last, strict=True)]


def _agreeing(differs: np.ndarray, width: int) -> np.ndarray:
    return np.where(differs.any(axis=1), differs.argmax(axis=1), width)


def _classes(grid: np.ndarray) -> dict[int, np.ndarray]:
    """For every prefix length, numbers that tell the rows' prefixes apart."""
    order = np.lexsort(grid.T[::-1])
    ordered = grid[order]
    shared = np.concatenate([[0], _agreeing(ordered[1:] != ordered[:-1], grid.shape[1])])
    found = {}
    for length in range(1, grid.shape[1] + 1):
        numbers = np.empty(len(grid), np.int64)
        numbers[order] = np.cumsum(shared < length)
        found[length] = numbers
    return found


def _strings(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two digests per row, start) of the strings around the anchors at ``places``."""
    starts = np.unique((places[:, None] - np.arange(REACH + 1)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(data) - WIDTH)]
    both = np.stack([_rolling(data, WIDTH, family)[starts] for family in (0, 1)], axis=1)
    return both, starts


_ROW = "part int, document bigint, shared binary, rest binary, counts binary, documents binary, places binary"
_NAMES = ["part", "document", "shared", "rest", "counts", "documents", "places"]
_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
# ``part`` of spans that are settled; runs of range r have 2r, its digests 2r + 1.
_SETTLED = -1


class _Sender:
    """Collects suffixes and digests of a task's documents and makes rows of them."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.suffixes: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        self.held = 0
        self.digests: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.strings = 0

    def add(self, document: int, data: np.ndarray, repeated: np.ndarray, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams = _rolling(data, GRAM)
        places = anchors(grams)
        signed = grams[places].view(np.int64)
        places = places[np.isin(signed, repeated)]
        often = np.isin(grams[places].view(np.int64), frequent)
        for at in range(0, len(places), 5000):
            some = places[at : at + 5000][~often[at : at + 5000]]
            parts = ((grams[some] >> np.uint64(20)) % np.uint64(self.ranges)).tolist()
            for place, part, key in zip(some.tolist(), parts, _contexts(data, some), strict=True):
                self.suffixes.setdefault(part, {}).setdefault(key.tobytes(), []).append((document, place))
            self.held += len(some)
            if self.held >= RUN:
                yield from self.runs()
        if often.any():
            both, starts = _strings(data, places[often])
            self.digests.append((both, starts, document))
            self.strings += len(starts)
            if self.strings >= DIGESTS:
                yield from self.settle()

    def runs(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for part, found in self.suffixes.items():
            keys = sorted(found)
            shared, rest = front_coded(keys)
            counts = np.array([len(found[k]) for k in keys], np.int32)
            members = np.array([m for k in keys for m in found[k]], np.int64)
            blobs = (shared, rest, counts, members[:, 0], members[:, 1].astype(np.int32))
            rows.append((2 * part, 0, *(self.pack(b if isinstance(b, bytes) else b.tobytes()) for b in blobs)))
        self.suffixes, self.held = {}, 0
        yield from _batches(rows)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Strings met twice here are settled; one row per string goes on."""
        if not self.digests:
            return
        both = np.concatenate([d[0] for d in self.digests])
        starts = np.concatenate([d[1] for d in self.digests])
        documents = np.concatenate([np.full(len(d[1]), d[2], np.int64) for d in self.digests])
        self.digests, self.strings = [], 0
        order = np.lexsort((both[:, 1], both[:, 0]))
        both, starts, documents = both[order], starts[order], documents[order]
        new = np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        number = np.diff(np.append(first, len(both)))
        repeated = np.repeat(number > 1, number)
        yield from _settled(documents[repeated], starts[repeated])
        # A string met twice here needs no place any more, only its digest goes on.
        both, documents = both[first], documents[first]
        known = np.where(number > 1, -1, starts[first]).astype(np.int32)
        part = ((both[:, 0] >> np.uint64(20)) % np.uint64(self.ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(self.ranges + 1))
        rows = []
        for r in range(self.ranges):
            here = order[ends[r] : ends[r + 1]]
            if len(here):
                digests, owners, places = (self.pack(x[here].tobytes()) for x in (both, documents, known))
                rows.append((2 * r + 1, 0, digests, None, None, owners, places))
        yield from _batches(rows)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        some = list(zip(*rows[at : at + 64], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, _TYPES, strict=True)], names=_NAMES)


def _settled(documents: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Covered intervals, one row per document, joined where strings overlap."""
    order = np.lexsort((starts, documents))
    documents, starts = documents[order], starts[order]
    for document in np.unique(documents):
        own = starts[np.searchsorted(documents, document) : np.searchsorted(documents, document, "right")]
        spans = _joined(own, own + WIDTH).astype(np.int32)
        yield from _batches([(_SETTLED, int(document), spans.tobytes(), None, None, None, None)])


def _joined(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Overlapping or touching intervals made one; rows of (start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.empty(0, bool)
    return np.stack([starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(starts) else ends], axis=1)


def _met(blobs: list[tuple[bytes, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, starts, ends) of strings whose digest came from two tasks, or twice from one."""
    unpack = zstandard.ZstdDecompressor().decompress
    digests = np.concatenate([np.frombuffer(unpack(b[0]), np.uint64).reshape(-1, 2) for b in blobs])
    documents = np.concatenate([np.frombuffer(unpack(b[3]), np.int64) for b in blobs])
    starts = np.concatenate([np.frombuffer(unpack(b[4]), np.int32) for b in blobs]).astype(np.int64)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    digests, documents, starts = digests[order], documents[order], starts[order]
    first = np.flatnonzero(np.concatenate([[True], (digests[1:] != digests[:-1]).any(axis=1)]))
    number = np.diff(np.append(first, len(digests)))
    repeated = (number > 1) | (np.minimum.reduceat(starts, first) < 0)
    chosen = np.repeat(repeated, number) & (starts >= 0)
    yield documents[chosen], starts[chosen], starts[chosen] + WIDTH


def _merged(blobs: list[tuple[bytes, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, starts, ends) of covered intervals, from the runs of one range."""
    unpack = zstandard.ZstdDecompressor().decompress
    kinds = (np.uint16, None, np.int32, np.int64, np.int32)
    runs = [
        Run(*(unpack(b) if k is None else np.frombuffer(unpack(b), k) for b, k in zip(blob, kinds, strict=True)))
        for blob in blobs
    ]
    keys: list[bytes] = []
    lengths: list[int] = []
    counts: list[int] = []
    members: list[tuple[int, np.ndarray, np.ndarray]] = []
    # Of all members so far: document, place, and the offsets of their context.
    documents, places, lows, highs = [], [], [], []

    def close() -> None:
        if len(keys) == 1 and counts[0] == 1:
            return
        spans = extremes(keys, counts, lengths)
        for number, document, place in members:
            low, high = spans[number]
            if low <= high:
                documents.append(document)
                places.append(place)
                lows.append(np.full(len(place), low))
                highs.append(np.full(len(place), high))

    for key, shared, run in merge(runs):
        if shared < GRAM and keys:
            close()
            keys, lengths, counts, members = [], [], [], []
        document, place = run.members()
        if shared == _KEY and keys:
            counts[-1] += len(document)
        else:
            keys.append(key)
            lengths.append(shared)
            counts.append(len(document))
        members.append((len(keys) - 1, document, place))
    if keys:
        close()
    if documents:
        place = np.concatenate(places).astype(np.int64)
        yield np.concatenate(documents), place - np.concatenate(highs), place - np.concatenate(lows) + WIDTH


def _coverage(docs: DataFrame, grams: DataFrame, ranges: int) -> DataFrame:
    """(document, spans) with covered intervals of the documents in ``docs`` (document, text)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(ranges)
        for batch in batches:
            names = ("document", "text", "repeated", "frequent")
            for document, text, repeated, frequent in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
                yield from sender.add(document, data, np.array(repeated, np.int64), np.array(frequent or [], np.int64))
        yield from sender.runs()
        yield from sender.settle()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            """Spans of the documents in one range of runs or digests."""
            found = list((_met if part % 2 else _merged)(blobs)) if blobs else []
            for document, start, end in found:
                order = np.argsort(document, kind="stable")
                document, start, end = document[order], start[order], end[order]
                first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]])) if len(document) else []
                limits = zip(first, np.append(first[1:], len(document)), strict=True) if len(document) else ()
                spans = [_joined(start[a:b], end[a:b]).astype(np.int32).tobytes() for a, b in limits]
                columns = [pa.array(document[first] if len(document) else [], pa.int64()), pa.array(spans, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["document", "spans"])

        for batch in batches:
            settled: list[tuple[int, bytes]] = []
            for row in zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True):
                if row[0] == _SETTLED:
                    settled.append(row[1:3])
                    continue
                if row[0] != part:
                    yield from finish()
                    part, blobs = row[0], []
                blobs.append(row[2:])
            columns = [pa.array([d for d, _ in settled], pa.int64()), pa.array([x for _, x in settled], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["document", "spans"])
        yield from finish()

    # Text is packed before it is exchanged.
    found = _packed(docs).join(grams, "document").select("document", "text", "repeated", "frequent")
    sent = found.mapInArrow(send, _ROW)
    # Runs and digests go by their range, settled spans by their document.
    target = F.when(F.col("part") >= 0, F.col("part").cast("long")).otherwise(F.col("document"))
    dealt = sent.withColumn("_to", target).repartition("_to").sortWithinPartitions("part").drop("_to")
    spans = dealt.mapInArrow(receive, "document bigint, spans binary")
    return spans.groupBy("document").agg(F.collect_list("spans").alias("spans"))


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", texts)

    kinds = [T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType(kinds))


def _repeated_grams(docs: DataFrame) -> DataFrame:
    """document, and the grams at its anchors that occur twice or more: repeated, frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, text in zip(batch.column("document").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _bytes(text)
                grams = _rolling(data, GRAM)
                hashes, number = np.unique(grams[anchors(grams)], return_counts=True)
                if len(hashes):
                    columns = [pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), document, np.int64)), pa.array(number.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "document", "n"])

    found = docs.select("document", "text").mapInArrow(run, "gram bigint, document bigint, n int")
    found = written(found, "anchors")  # hashing the texts again would cost more than reading this
    counted = found.groupBy("gram").agg(F.sum("n").alias("total")).filter("total > 1")
    marked = found.join(counted, "gram").select("document", "gram", (F.col("total") > FREQUENT).alias("often"))
    return marked.groupBy("document").agg(
        F.collect_set("gram").alias("repeated"), F.collect_set(F.when(F.col("often"), F.col("gram"))).alias("frequent")
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with n_bytes, n_removed, n_spans and kept (binary).

    A byte of a text's UTF-8 is removed if a string of WIDTH bytes around it
    starts at another place of any text too, judged on the texts as they are.
    ``kept`` joins the other bytes; it need not be valid UTF-8.  Null counts as
    empty.  Rows that repeat are documents of their own and lose what they
    share.  An empty table stays empty; columns named like an output are replaced.
    """
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
    names = [f.name for f in other_fields(docs, [text, *(f.name for f in fields)])]
    # Equal rows get one number and one result; each counts as a place of its own.
    numbered = docs.select(
        F.struct(*names, F.lit(0)).alias("row"), F.col(text).alias("text"), F.xxhash64(key, text).alias("document")
    )
    grams = written(_repeated_grams(numbered), "grams")
    ranges = max(1, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = written(_coverage(numbered.select("document", "text"), grams, ranges), "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, number, kept = [], [], [], []
            for packed, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, parts = unpack(packed), 0, []
                grid = np.concatenate([np.frombuffer(s, np.int32).reshape(-1, 2) for s in found or (b"",)])
                joined = _joined(grid[:, 0], grid[:, 1])
                for start, end in joined.tolist():
                    parts.append(data[at:start])
                    at = end
                sizes.append(len(data))
                removed.append(int((joined[:, 1] - joined[:, 0]).sum()))
                number.append(len(joined))
                kept.append(b"".join([*parts, data[at:]]))
            counts = [pa.array(c, pa.int64()) for c in (sizes, removed, number)]
            columns = [batch.column("row"), *counts, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([numbered.schema["row"], *fields])
    found = _packed(numbered).join(spans, "document", "left").select("row", "text", "spans").mapInArrow(strip, schema)
    return found.select(*[F.col("row")[n].alias(n) for n in names], *(f.name for f in fields))
