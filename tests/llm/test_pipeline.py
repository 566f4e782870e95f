"""The pipeline: stages in order, each on what the one before kept."""

import random

import corpus_pipeline
import __spark_entry__ as registry
from txnloom.llm import lines, pii, queries


def corpus(spark, folder):
    draw = random.Random(1)
    usual = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 5 == 0)
        text = "\n".join(" ".join(draw.choice(usual) for _ in range(12)) for _ in range(draw.randint(2, 9)))
        rows.append((i, text + (" you utter moronidiot" * 2 if toxic else ""), "en", "s", 0))
        labels.append((i, 1, toxic))
    clean = [r for r in rows if r[0] % 5]
    rows.append((1000, clean[3][1], "en", "s", 0))
    rows.append((1001, clean[4][1].replace(clean[4][1].split()[20], "changed", 1), "en", "s", 0))
    rows.append((1002, "write to someone@example.org at once", "en", "s", 0))
    rows += [(1003, None, "en", "s", 0), (1004, "", None, None, None), (None, "no id at all", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    by_id = {r[0]: r for r in rows}
    first = {r["doc_id"] for r in kept["toxicity"]}
    assert {i for i in range(600) if i % 5} <= first and {1000, 1001, 1002, 1003, 1004, None} <= first
    assert len(first & {i for i in range(600) if i % 5 == 0}) <= 3
    second = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert set(second) == first
    # A copy loses every line that a chunk covers, however the chunks overlap, and its original none.
    covered = {n for first_line, end, _ in lines.chunks(by_id[1000][1]) for n in range(first_line, end)}
    left = [x for n, x in enumerate(by_id[1000][1].split("\n")) if n not in covered]
    assert second[1000] == "\n".join(left) and len(second[1000]) < len(by_id[1000][1])
    original = next(i for i in range(600) if i % 5 and by_id[i][1] == by_id[1000][1])
    assert second[original] == by_id[original][1]
    third = {r["doc_id"] for r in kept["jaccard_join"]}
    assert third <= first and {1002, 1003, 1004, None} <= third
    fourth = {r["doc_id"]: r for r in kept["pii"]}
    assert set(fourth) == third
    assert fourth[1002]["text"] == "write to [EMAIL] at once"
    assert all(r["text"] == pii.masked(second[i]) for i, r in fourth.items())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in fourth.values())
    packed = kept["packing"]
    assert {r["doc_id"] for r in packed} == third
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 for p in places.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()), key=str) == sorted(
        (tuple(r)[:5] for r in packed), key=str
    )


def test_near_copies_keep_the_least_id(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(9, base), (3, base + " more"), (7, "else " * 20), (8, ""), (2, None), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in left.collect()} == {3, 7, 8, 2, None}


def test_everything_is_registered(spark, sf_dir):
    names = set(registry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "pii", "packing"]
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_texts_are_not_exchanged_to_leave_copies_out(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "a", 0), (2, words, "en", "a", 0), (3, "other words", "en", "a", 0), (None, words, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 3, None]
