"""Toxicity: held-out accuracy, folds, thresholds and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnloom.llm import toxicity


def corpus(spark, count=1200, seed=1):
    draw = random.Random(seed)
    usual = [f"w{i}" for i in range(400)]
    bad = ["idiot", "moron", "trash", "scumbag"]
    rows, labels = [], []
    for i in range(count):
        words = [draw.choice(usual) for _ in range(draw.randint(20, 200))]
        toxic = int(draw.random() < 0.2)
        for _ in range(toxic * draw.randint(1, 5)):
            words.insert(draw.randint(0, len(words)), draw.choice(bad) + draw.choice(["", "s", "ic"]))
        rows.append((i, " ".join(words), draw.choice(["en", "de", None]), 7))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_documents(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).withColumn("limit", toxicity.threshold(model)).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 200 and all(0 <= r["score"] <= 1 for r in scored)
    for cut in (lambda r: toxicity.DECISION, lambda r: r["limit"]):
        right = sum((r["score"] >= cut(r)) == truth[r["doc_id"]] for r in held)
        assert right >= 0.97 * len(held)
    assert set(model.by_language) <= {"en", "de"}


def test_only_the_text_scores(spark):
    docs, labels, _ = corpus(spark, 400)
    model = toxicity.fit(docs, labels)
    one = toxicity.score(docs, model).select("text", "score")
    other = toxicity.score(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 5), model)
    assert sorted(one.collect()) == sorted(other.select("text", "score").collect())


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.network.table, b.network.table) and a.threshold == b.threshold


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(0, 1), (1, 1)], 1.0), ([(0, 0), (None, 1), (1, None)], 0.0)])
def test_without_both_classes(spark, labels, score):
    docs, _, _ = corpus(spark, 10)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {score}


def test_calibration_sees_all_labelled_rows(spark, monkeypatch):
    """A bound that evens the classes out in the sample leaves probabilities as frequent as labels."""
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        toxic = int(draw.random() < 0.1)
        odd = draw.random() < (0.6 if toxic else 0.2)
        words = [f"w{draw.randrange(200)}" for _ in range(40)] + ["idiot"] * odd
        rows.append((i, " ".join(words), "en"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 150)
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 50)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    mean = toxicity.score(docs, model).filter(toxicity.fold_of("doc_id") == 2).agg(F.avg("score")).first()[0]
    assert 0.06 <= mean <= 0.14, mean


def test_odd_texts(spark):
    docs, labels, _ = corpus(spark, 400)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "!!"), (3, "w1 " * 100_000), (3, "w1")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert scores[0] == scores[1] == scores[2] and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_pooling_keeps_texts_apart():
    random_ = np.random.default_rng(1)
    net = toxicity._start([np.zeros((3, 2), np.int64)], np.array([1]), random_)
    texts = [random_.integers(0, 50, (n, 2)) for n in (5, 0, 1, 9)]
    flat, starts, counts = toxicity._batch(texts)
    joint, _ = net.pooled(net.projections(net.table[flat[:, 0]] + net.table[flat[:, 1]]), starts, counts)
    for i, text in enumerate(texts):
        if len(text):
            alone, _ = net.pooled(net.projections(net.table[text[:, 0]] + net.table[text[:, 1]]), np.array([0]), np.array([len(text)]))
            assert np.allclose(joint[i], alone[0])
        else:
            assert not joint[i].any()


def test_scores_equal_a_plain_convolution(spark):
    """Every window of every width of every text, one number after the other."""
    random = np.random.default_rng(5)
    net = toxicity.Network(
        random.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32),
        {w: random.normal(0, 0.3, (w, toxicity.DIMENSIONS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS},
        random.normal(0, 0.2, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32),
        -0.4,
        1.3,
        0.2,
    )
    model = toxicity.Classifier(net, 0.0, toxicity.DECISION, {})
    texts = [None, "", "  ", "one", "One two", "a b c d e f g", "same same same", "x y " * 60, "Ärger über Größe!"]

    def plain(text):
        rows = []
        for word in toxicity.words_of(text):
            one, two = toxicity.buckets_of(word)
            rows.append(net.table[one].astype(float) + net.table[two].astype(float))
        total = net.bias
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(rows)):
                    inside = rows[at : at + width]
                    best = max(best, sum(float(x @ net.filters[width][j][:, f].astype(float)) for j, x in enumerate(inside)))
                total += best * float(net.out[k * toxicity.FILTERS + f])
        return total

    assert np.allclose(toxicity.Scorer(model).margins(texts), [plain(t) for t in texts], rtol=1e-4, atol=1e-4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["score"] for r in toxicity.score(frame, model).orderBy("doc_id").collect()]
    assert np.allclose(found, [toxicity.Scorer(model)([t])[0] for t in texts]) and all(0 <= s <= 1 for s in found)
    assert len({round(s, 6) for s in found}) > 5
