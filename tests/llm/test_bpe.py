"""Byte-level BPE against the reference tokenizer library."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.llm import bpe

PATTERN = public_tokenizers.PATTERN
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def texts(count, seed):
    draw = random.Random(seed)
    for _ in range(count):
        letters = draw.choice(["ab", "the and", "  \n\tx", "aé日本́😀", "0123 .,-'s", " aaaa", "etaoinshr"])
        yield "".join(draw.choice(letters) for _ in range(draw.randint(0, 70)))


def test_equals_the_library(own, theirs):
    for text in texts(1500, 1):
        assert list(own.encode(text)) == theirs.encode_ordinary(text)


def test_long_runs(own, theirs):
    for text in ("a" * 5000, " " * 3000 + "x", "ab" * 4000, "é" * 2000):
        assert list(own.encode(text)) == theirs.encode_ordinary(text)


def test_characters_of_every_kind(own, theirs):
    for code in [*range(0x500), *range(0x2000, 0x2100), *range(0x3000, 0xD000, 37), 0x85, 0xFEFF, 0x1F600]:
        text = f"a{chr(code)}{chr(code)} b{chr(code)}1"
        assert list(own.encode(text)) == theirs.encode_ordinary(text), hex(code)


def test_tables_survive_appends_and_edits(own, theirs):
    draw = random.Random(3)
    for _ in range(400):
        data = "".join(draw.choice("abtheino") for _ in range(draw.randint(1, 90))).encode()
        table = bpe.PieceTable(own, data)
        start = draw.randint(0, len(data))
        stop = draw.randint(start, len(data))
        table.replace(start, stop, b"th")
        table.append(b"ing")
        changed = data[:start] + b"th" + data[stop:] + b"ing"
        assert list(table.ids()) == theirs._encode_single_piece(changed)


def test_texts_survive_appends_and_edits(own, theirs):
    draw = random.Random(4)
    for text in texts(500, 5):
        encoded = bpe.EncodedText(own, text)
        start = draw.randint(0, len(text))
        stop = draw.randint(start, len(text))
        encoded.replace(start, stop, " x'")
        encoded.append("s  y")
        changed = text[:start] + " x'" + text[stop:] + "s  y"
        assert encoded.text == changed
        assert encoded.ids() == theirs.encode_ordinary(changed)


def test_round_trip_with_odd_rows(spark, theirs):
    rows = [(1, "Hello wörld", "a"), (2, None, "b"), (3, "", "c"), (1, "Hello wörld", "a"), (None, "x" * 100_000, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.decode(bpe.encode(frame, PATH, PATTERN), PATH).collect()
    assert [bytes(r["decoded"]).decode() for r in done] == [r[1] or "" for r in rows]
    assert [list(r["ids"]) for r in done] == [theirs.encode_ordinary(r[1] or "") for r in rows]
    assert [r["doc_id"] for r in done] == [r[0] for r in rows]


def test_one_pass_equals_two(spark, theirs):
    rows = [(k, text) for k, text in enumerate(texts(300, 8))] + [(None, None), (1, ""), (1, "é" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("decoded", "text"):
        done = bpe.encode(frame, PATH, PATTERN, decoded=name).collect()
        assert [list(r["ids"]) for r in done] == [theirs.encode_ordinary(t or "") for _, t in rows]
        assert [bytes(r[name]) for r in done] == [(t or "").encode() for _, t in rows]


def test_unknown_ids_fail(spark):
    for ids in ([-1], [10**8], [None]):
        with pytest.raises(Exception, match="KeyError"):
            bpe.decode(spark.createDataFrame([(ids,)], "ids array<int>"), PATH).collect()
    none = bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()
    assert [bytes(r["decoded"]) for r in none] == [b"", b""]


def test_empty_table(spark):
    frame = spark.createDataFrame([], T.StructType([T.StructField("text", T.StringType())]))
    assert bpe.decode(bpe.encode(frame, PATH, PATTERN), PATH).filter(F.size("ids") > 0).count() == 0
