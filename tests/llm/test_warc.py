"""Fixity audit: every damage is located, nothing else is."""

import gzip
import random

import pytest
from oracle_check import compare, duck

from txnloom.llm import queries, warc


def replica(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, data binary")


@pytest.mark.parametrize("seed", range(3))
def test_locates_damage(spark, seed):
    draw = random.Random(seed)
    good = {(f, o * 5000): draw.randbytes(20) for f in range(20) for o in range(draw.randint(1, 60))}
    bad, expected = dict(good), {}
    for place in draw.sample(sorted(good), 9):
        kind = draw.choice(["changed", "missing"])
        expected[place] = kind
        if kind == "missing":
            del bad[place]
        else:
            bad[place] = b"x" + bad[place][1:]
    bad[40, 7_000_000] = b"more"
    expected[40, 7_000_000] = "extra"
    left, right = (replica(spark, [(*p, bytearray(d)) for p, d in side.items()]) for side in (good, bad))
    found = {(r["file"], r["offset"]): r["status"] for r in warc.mismatches(left, right).collect()}
    assert found == expected
    assert warc.mismatches(left, left).count() == 0


def test_empty_and_null(spark):
    none, some = replica(spark, []), replica(spark, [(0, 0, None), (0, 0, None)])
    assert warc.mismatches(none, none).count() == 0
    assert [tuple(r) for r in warc.mismatches(none, some).collect()] == [(0, 0, "extra")]
    assert [tuple(r) for r in warc.mismatches(some, none).collect()] == [(0, 0, "missing")]
    with pytest.raises(Exception, match="no place"):
        warc.mismatches(none, replica(spark, [(None, 0, b"x")])).count()


def test_records_parse_back(spark):
    pages = [(i, f"http://h/{i}", "é" * i) for i in range(30)] + [(None, None, None), (3, "http://h/3", "é" * 3)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int")
    records = warc.records(frame, 2000).collect()
    assert len(records) == len(pages)
    files = {}
    for r in sorted(records, key=lambda r: (r["file"], r["offset"])):
        files[r["file"]] = files.get(r["file"], b"") + bytes(r["data"])
    raw = [(str(k), bytearray(v)) for k, v in files.items()] + [("gz", bytearray(gzip.compress(v))) for v in files.values()]
    raw += [("none", None), ("odd", bytearray(b"no record"))]
    parsed = warc.parse(spark.createDataFrame(raw, "path string, content binary")).collect()
    found = sorted((r["path"], r["offset"], r["length"], bytes(r["data"])) for r in parsed if r["path"] not in ("gz", "odd"))
    assert found == sorted((str(r["file"]), r["offset"], r["length"], bytes(r["data"])) for r in records)
    assert sum(r["path"] == "gz" for r in parsed) == len(records)


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, duck(sf_dir), queries.QUERIES["op10_warc"], queries.ORACLES["op10_warc"], sf_dir) is None
