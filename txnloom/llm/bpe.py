"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one encoding, so it has one last token.  The
table of these last tokens grows by one entry per byte: of the tokens that end
there, the one whose neighbour (the last token of the prefix before it) would
not have merged across the boundary is the entry.  Reading the table backwards
gives the ids.  Appending extends the table; an edit keeps the part before it
and stops as soon as the new entries agree with the old ones.

Text is first split by the tokenizer's pattern and each match is encoded on
its own.  The pattern never looks back, so splits near an edit are redone only
until a boundary coincides with an old one.
"""

from __future__ import annotations

import base64
import math
from functools import cache, cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from txnloom.llm.shared import add_from_text

# Bounds on what a worker remembers: two generations of pieces, the older of
# which goes when the newer is full, and pairs of tokens, which start again.
REMEMBERED_PIECES = 250_000
REMEMBERED_PAIRS = 500_000
# Characters beyond a piece that can decide where the piece ends.
LOOKAHEAD = 4


class Codec:
    """Ranks of one vocabulary, prepared for prefix tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            split = self._split(token, rank) if len(token) > 1 else None
            if split or len(token) == 1:  # else no merge leads to this token
                self.halves[rank] = split
        self.reached = {token: rank for token, rank in ranks.items() if rank in self.halves}

    @cached_property
    def _ends(self) -> ahocorasick.Automaton:
        """Finds the tokens that end at each byte."""
        ends = ahocorasick.Automaton()
        for token, rank in self.reached.items():
            ends.add_word(token.decode("latin-1"), (rank, len(token)))
        ends.make_automaton()
        return ends

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``."""
        for i in range(1, len(token)):
            left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if left in self.halves and right in self.halves and self._apart(left, right, rank):
                return left, right
        return None

    def _apart(self, a: int, b: int, before: float = math.inf) -> bool:
        """Whether no merge ranked below ``before`` crosses the boundary a|b.

        Undoes the merges that touch the boundary, the latest first.  Two
        pieces that lie at it together merge if their union has a rank lower
        than the merge that takes the left one away, and not higher than the
        merge that takes the right one away (equal ranks merge leftmost first).
        """
        left_gone = right_gone = before
        while True:
            merge = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if merge is not None and merge < left_gone and merge <= right_gone and merge < before:
                return False
            in_a, in_b = self.halves[a], self.halves[b]
            if in_a is None and in_b is None:
                return True
            if in_b is None or (in_a is not None and a > b):
                left_gone, a = a, in_a[1]
            else:
                right_gone, b = b, in_b[0]

    def apart(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def extend(self, text: str, last: list[int], old: list[int] | None = None, after: int = 0) -> None:
        """Fill ``last`` (one entry per prefix, from prefix 0) up to all of ``text``.

        ``text`` holds bytes as Latin-1.  With ``old``, entries aligned with the
        ends of both strings, filling stops once as many entries beyond prefix
        ``after`` agree as the longest token has bytes: the rest must agree.
        """
        done = len(last) - 1
        last.extend([-1] * (len(text) - done))
        shift = len(old) - len(last) if old is not None else 0
        start = max(0, done - self.longest)
        equal, at = 0, done
        for end, (token, length) in self._ends.iter(text, start):
            if end < done or end + 1 - length < start:
                continue
            if old is not None and end > at:
                equal = equal + 1 if at > after and last[at] == old[at + shift] else 0
                at = end
                if equal >= self.longest:
                    last[at:] = old[at + shift :]
                    return
            begin = end + 1 - length
            if last[end + 1] < 0 and (begin == 0 or self.apart(last[begin], token)):
                last[end + 1] = token

    def walk(self, last: list[int]) -> tuple[int, ...]:
        """Ids of the whole string, read backwards from its last token."""
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return tuple(reversed(ids))

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return self.walk(self.table(data.decode("latin-1")))

    def table(self, text: str) -> list[int]:
        """The last token of every prefix of a string of Latin-1 bytes."""
        pairs, last = self._pairs, [-1] * (len(text) + 1)
        if len(pairs) >= REMEMBERED_PAIRS:
            pairs.clear()
        for end, (token, length) in self._ends.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                if before < 0:
                    last[end] = token
                    continue
                pair = before, token
                apart = pairs.get(pair)
                if apart is None:
                    apart = pairs[pair] = self._apart(before, token)
                if apart:
                    last[end] = token
        return last

    def encode(self, text: str) -> chain:
        """Ids of a text, as an iterator."""
        pieces = self.pattern.findall(text)
        needed = set(pieces)
        if len(self._pieces) + len(needed) > REMEMBERED_PIECES:
            self._older, self._pieces = self._pieces, {}
        known, older = self._pieces, self._older
        for new in needed.difference(known):
            known[new] = older.get(new) or self.piece(new)
        return chain.from_iterable(map(known.__getitem__, pieces))


class PieceTable:
    """The last tokens of all prefixes of one byte string, kept under changes."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.text, self.last = codec, "", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; no earlier entry changes."""
        self.text += data.decode("latin-1")
        self.codec.extend(self.text, self.last)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put ``data`` in place of bytes start..stop."""
        old = self.last
        self.text = self.text[:start] + data.decode("latin-1") + self.text[stop:]
        self.last = old[: start + 1]
        self.codec.extend(self.text, self.last, old, start + len(data))

    def ids(self) -> tuple[int, ...]:
        whole = self.codec.ranks.get(self.text.encode("latin-1")) if self.text else None
        return self.codec.walk(self.last) if whole is None else (whole,)


class EncodedText:
    """A text with the ids of its pieces, kept under appends and edits."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.ends: list[int] = []
        self.pieces: list[tuple[int, ...]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of characters start..stop; encode only nearby pieces."""
        old_ends, old_pieces = self.ends, self.pieces
        self.text = self.text[:start] + new + self.text[stop:]
        keep = sum(end + LOOKAHEAD <= start for end in old_ends)
        self.ends, self.pieces = old_ends[:keep], old_pieces[:keep]
        shift, at = len(new) - (stop - start), self.ends[-1] if keep else 0
        later = {end + shift: i for i, end in enumerate(old_ends) if end >= stop}
        for match in self.codec.pattern.finditer(self.text, at):
            self.pieces.append(self.codec.piece(match.group()))
            self.ends.append(match.end())
            if match.end() in later and match.end() >= start + len(new):
                rest = later[match.end()] + 1
                self.ends += [end + shift for end in old_ends[rest:]]
                self.pieces += old_pieces[rest:]
                return

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.pieces))


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(ranks_of(path), pattern)


class Decoder:
    """Bytes of ids, read from all tokens joined in one buffer."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = {rank: data for data, rank in ranks.items()}
        count = max(tokens, default=-1) + 1
        self.sizes = np.array([len(tokens.get(rank, b"")) for rank in range(count)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = np.array([rank in tokens for rank in range(count)], bool)
        self.joined = np.frombuffer(b"".join(tokens.get(rank, b"") for rank in range(count)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.sizes) or not self.known[ids].all():
            raise KeyError("an id outside the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        # Where the bytes of each token lie in the buffer, less where they go.
        shifts = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.joined[np.arange(ends[-1]) + shifts].tobytes()


@cache
def decoder(path: str) -> Decoder:
    return Decoder(ranks_of(path))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


_IDS = T.ArrayType(T.IntegerType())


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Add the token ids of every whole text as ``ids`` (array of int).

    ``path`` names a rank file that every executor can open; ids are those of a
    tiktoken encoding with these ranks and pattern and no special tokens.  A
    null or empty text has no ids.  Rows are independent: repeated rows repeat,
    an empty table stays empty, and a column already named ``ids`` is replaced.
    With ``decoded`` the ids are decoded again in the same pass, into a column
    of that name (see ``decode``).
    """

    def make():
        own, back = codec(path, pattern), decoder(path) if decoded else None

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [np.fromiter(own.encode(t or ""), np.int32) for t in texts.to_pylist()]
            return [_lists(rows), *([pa.array([back.decode(r) for r in rows], pa.binary())] if back else [])]

        return work

    fields = [T.StructField(ids, _IDS), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return add_from_text(df, text, fields, make)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for as ``decoded`` (binary).

    Null or no ids give no bytes.  An id outside the vocabulary, or null inside
    the list, fails with KeyError.  A column named ``decoded`` is replaced.
    """

    def make():
        back = decoder(path)

        def one(row: pa.ListScalar) -> bytes:
            if row.values is None:
                return b""
            if row.values.null_count:
                raise KeyError("null is no id")
            return back.decode(row.values.to_numpy())

        return lambda lists: [pa.array([one(row) for row in lists], pa.binary())]

    return add_from_text(df, ids, [T.StructField(decoded, T.BinaryType())], make)
