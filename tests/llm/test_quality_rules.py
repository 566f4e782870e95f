"""Quality counts against plain Python, and the guarantee against exact sums."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from txnloom.llm import quality


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w in windows if windows.count(w) > 1}
    hit = {i + j for i, w in enumerate(windows) if w in often for j in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_counts(spark):
    draw = random.Random(1)
    texts = [None, "", "   \n\t", "a" * 100_000, "x " * 300, "é|ü #1\x0bz\x1cq", "l\nl\n\nl \nl"]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randint(5, 40))) for _ in range(150)]
    texts += ["\n".join(draw.choice(["p q", "r", "", "|"]) for _ in range(9)) for _ in range(50)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, text string, n_words string")
    for r in quality.features(frame).collect():
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert found == counts(texts[r["k"]]), texts[r["k"]]


def test_tail_is_the_binomial_sum(spark):
    cases = [(0, 50), (3, 500), (10, 4000), (40, 1000), (0, 0), (7, 100_000)]
    frame = spark.createDataFrame(cases, "k long, n long")
    for r in frame.withColumn("p", quality.tail(F.col("k"), F.col("n"), 0.02)).collect():
        if r["k"] >= 0.02 * r["n"]:
            assert r["p"] == 1.0
            continue
        logs = [
            math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1)
            + j * math.log(0.02) + (r["n"] - j) * math.log(0.98)
            for j in range(r["k"] + 1)
        ]
        exact = sum(map(math.exp, logs))
        assert r["p"] == pytest.approx(exact, rel=1e-6, abs=1e-300)


def corpus(spark, good, bad):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{words} {i}", "en") for i in range(good)]
    rows += [(good + i, "|".join(f"w{j} |" for j in range(40)) + f" {i}", "en") for i in range(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < good)) for i in range(good + bad)], "doc_id long, quality int")
    return docs, labels


def test_bad_ones_go_and_good_ones_stay(spark):
    docs, labels = corpus(spark, 3000, 30)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i in range(3000))
    assert not any(kept[i] for i in range(3000, 3030))


def test_few_labels_guarantee_nothing(spark):
    docs, labels = corpus(spark, 60, 10)
    assert quality.judge(docs, labels).filter("NOT kept AND NOT base_failed").count() == 0


def test_strata_keep_their_limit(spark):
    # Half the good documents of one stratum would fail the symbol rule.
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(i, words + (" ||||||||||||||||||||" if i % 2 else "") + f" {i}", "aa") for i in range(2000)]
    rows += [(i, f"{words} {i}", "bb") for i in range(2000, 5000)]
    rows += [(5000, words + " " + "|" * 80, "aa"), (5001, words + " " + "|" * 80, "bb"), (5002, words + " " + "|" * 80, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i in range(5000))
    assert not kept[5001] and kept[5002]


def binomial_tail(k, n, rate):
    if k >= rate * n:
        return 1.0
    return sum(
        math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log1p(-rate))
        for j in range(k + 1)
    )


def test_cutoffs_and_verdicts_equal_plain_code(spark):
    """Every cutoff tried in every stratum, with measures that tie with cutoffs."""
    draw = random.Random(8)
    rows = []
    for i in range(6000):
        words = [f"w{draw.randrange(900):03d}" for _ in range(50)]
        # 200 characters in words and symbols: ratios of exactly 0.05, 0.1, 0.2 are common.
        marks = draw.choice([0, 0, 0, 0, 10, 20]) if i % 3 else draw.choice([0] * 60 + [10, 40, 60])
        if i % 50 == 0:  # none of them is a good one
            marks = 90
        text = "".join(words)[: 200 - marks] + "|" * marks
        text = " ".join(text[j : j + 4] for j in range(0, 200, 4))
        if i % 17 == 0:
            text += "\nline\nline\nother\nline"
        rows.append((i, text, ["aa", "bb", None][i % 3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {i for i in range(6000) if i % 5}
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(6000)], "doc_id long, quality int")

    measured, failed = {}, {}
    for i, text, _ in rows:
        n_words, chars, symbols, dup, repeat = counts(text)
        n_lines = len([x for x in text.split("\n") if x.strip()])
        measured[i] = {"symbol_ratio": symbols / chars, "dup_line_ratio": dup / n_lines, "repeat_ratio": repeat / n_words, "mean_word": chars / n_words}
        failed[i] = n_words < 20 or 100 * repeat > 30 * n_words
    tests = sum(map(len, quality.CUTOFFS.values()))
    level, rate = quality.ERROR / (tests * 3), quality.LIMIT / len(quality.CUTOFFS)
    cutoffs = {}
    for stratum in ("aa", "bb", None):
        held = [i for i, _, lang in rows if lang == stratum and i in good and not failed[i]]
        for rule, tried in quality.CUTOFFS.items():
            passing = [c for c in tried if binomial_tail(sum(measured[i][rule] > c for i in held), len(held), rate) <= level]
            cutoffs[stratum, rule] = min(passing, default=None)
    ties = sum(measured[i]["symbol_ratio"] == cutoffs[lang, "symbol_ratio"] for i, _, lang in rows)
    assert ties > 20 and len({c for (_, rule), c in cutoffs.items() if rule == "symbol_ratio"}) > 1
    expected = {
        i: not failed[i] and not any(cutoffs[lang, r] is not None and v > cutoffs[lang, r] for r, v in measured[i].items())
        for i, _, lang in rows
    }
    found = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert found == expected and not all(expected.values())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "en"), (1, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(None, None), (1, None), (1, 1)], "doc_id long, quality int")
    judged = quality.judge(docs, labels).collect()
    assert len(judged) == 3 and all(r["base_failed"] and not r["kept"] for r in judged)
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs, _ = corpus(spark, 3, 1)
    plan = quality.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
