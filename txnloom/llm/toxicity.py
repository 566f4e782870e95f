"""Convolutional text classifier for toxicity, trained in numpy.

A word is the sum of two hashed embeddings: of the whole word and of its first
letters, which carries over to inflected forms.  Filters of several widths run
over the words, the maximum of each filter over the text feeds a logistic
output.  Training sees a bounded sample of labelled documents; all labelled
documents of a further part are scored, and counts of their outputs calibrate
the output to a probability and pick a threshold per language.
Scoring folds the filters into one table of projections per distinct word, so
a text costs a few vector additions per word.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.llm.shared import add_from_text

# Size of the network.
BUCKETS = 1 << 17
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 5
# Bounds on the training sample: labelled documents of either class, and words
# of one of them (longer labelled documents are not trained on, only scored).
SAMPLE_PER_CLASS = 4000
SAMPLE_WORDS = 20_000
EPOCHS = 6
BATCH = 64
RATE = 0.08
# Words a task remembers with their projections; beyond it starts again.
REMEMBERED = 150_000
DECISION = 0.3
# Counted outputs: steps in one unit of log-odds, and the largest size of an output.
STEPS = 1024
LARGEST = 30
# Positives a language needs for a threshold of its own.
LEAST_POSITIVES = 20

_WORD = re.compile(r"\w+")
_COLUMNS = FILTERS * sum(WIDTHS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def buckets_of(word: str) -> tuple[int, int]:
    data = word.encode("utf-8", "surrogatepass")
    stem = word[:STEM].encode("utf-8", "surrogatepass")
    return zlib.crc32(data) % BUCKETS, zlib.crc32(stem, 0x5EED) % BUCKETS


@dataclass
class Network:
    """Weights; ``filters[w]`` has shape (w, dimensions, filters)."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def projections(self, embedded: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place in its window."""
        parts = [embedded @ self.filters[w][j] for w in WIDTHS for j in range(w)]
        return np.concatenate(parts, axis=1)

    def pooled(self, projected: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over each text, 0 at least, and where they lie.

        ``projected`` has the words of all texts in sequence; a window that
        leaves its text counts the words inside.
        """
        total, column = len(projected), 0
        text_of = np.repeat(np.arange(len(counts)), counts)
        values = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        places = np.full(values.shape, -1, np.int64)
        for k, width in enumerate(WIDTHS):
            response = np.zeros((total, FILTERS), np.float32)
            for j in range(width):
                part = projected[:, column : column + FILTERS]
                column += FILTERS
                if j == 0:
                    response += part
                elif j < total:
                    same = (text_of[j:] == text_of[:-j])[:, None]
                    response[:-j] += part[j:] * same
            for i in np.flatnonzero(counts):
                block = response[starts[i] : starts[i] + counts[i]]
                best = block.argmax(axis=0)
                top = block[best, np.arange(FILTERS)]
                here = slice(k * FILTERS, (k + 1) * FILTERS)
                values[i, here] = np.maximum(top, 0)
                places[i, here] = np.where(top > 0, best + starts[i], -1)
        return values, places

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.astype(np.float64) @ self.out.astype(np.float64) + self.bias

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _batch(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    flat = np.concatenate(texts) if len(texts) else np.empty((0, 2), np.int64)
    return flat.reshape(-1, 2), starts, counts


def _start(texts: list[np.ndarray], labels: np.ndarray, random: np.random.Generator) -> Network:
    """Small random weights; the first dimension starts with each bucket's evidence.

    The evidence is the log-odds of the label given the bucket, smoothed and
    scaled down for buckets seen in few texts.
    """
    seen = np.full((2, BUCKETS), 0.5)
    for ids, label in zip(texts, labels, strict=True):
        seen[int(label), np.unique(ids)] += 1
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None] + 1.0
    odds = np.log(seen[1] / totals[1]) - np.log(seen[0] / totals[0])
    sure = odds / np.sqrt(1 / seen[0] + 1 / seen[1])
    table = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    table[:, 0] = np.clip(sure / 4, -1, 2)
    filters = {w: random.normal(0, 0.15, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
    for weights in filters.values():
        weights[:, 0, :] += 0.5 / len(weights)
    out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    return Network(table, filters, out, float(np.log(share / (1 - share))) - 1.0)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adagrad; ``texts`` are arrays of bucket pairs, one row per word."""
    random = np.random.default_rng(seed)
    net = _start(texts, labels, random)
    squares = {id(p): np.full(p.shape, 1e-2, np.float32) for p in (net.table, net.out, *net.filters.values())}
    bias_square = 1e-2

    def step(weights: np.ndarray, gradient: np.ndarray) -> None:
        square = squares[id(weights)]
        square += gradient**2
        weights -= RATE * gradient / np.sqrt(square)

    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            flat, starts, counts = _batch([texts[i] for i in chosen])
            if not len(flat):
                continue
            embedded = net.table[flat[:, 0]] + net.table[flat[:, 1]]
            pooled, places = net.pooled(net.projections(embedded), starts, counts)
            error = 1 / (1 + np.exp(-np.clip(net.margins(pooled), -30, 30))) - labels[chosen]
            ends = starts + counts
            rows, gradients = [], []
            changes = {}
            for k, width in enumerate(WIDTHS):
                weights = net.filters[width]
                change = np.zeros_like(weights)
                for f in range(FILTERS):
                    unit = k * FILTERS + f
                    hit = np.flatnonzero(places[:, unit] >= 0)
                    flow = (error[hit] * net.out[unit]).astype(np.float32)
                    for j in range(width):
                        place = places[hit, unit] + j
                        inside = place < ends[hit]
                        place, some = place[inside], flow[inside][:, None]
                        change[j, :, f] = (embedded[place] * some).sum(axis=0)
                        rows.append(flat[place])
                        gradients.append(some * weights[j, :, f])
                changes[width] = change / len(chosen)
            step(net.out, (pooled * error[:, None]).mean(axis=0).astype(np.float32))
            bias_square += error.mean() ** 2
            net.bias -= RATE * error.mean() / bias_square**0.5
            for width, change in changes.items():
                step(net.filters[width], change)
            touched = np.concatenate(rows)
            values = np.concatenate(gradients) / len(chosen)
            unique, where = np.unique(touched, return_inverse=True)
            summed = np.zeros((len(unique), DIMENSIONS), np.float32)
            np.add.at(summed, where.reshape(touched.shape)[:, 0], values)
            np.add.at(summed, where.reshape(touched.shape)[:, 1], values)
            squares[id(net.table)][unique] += summed**2
            net.table[unique] -= RATE * summed / np.sqrt(squares[id(net.table)][unique])
    return net


def calibrate(net: Network, margins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
    """Fit slope and shift of the output on texts not trained on (Newton steps).

    Each output stands for ``counts`` texts.
    """
    positives, negatives = counts[labels == 1].sum(), counts[labels == 0].sum()
    if not positives or not negatives:
        return
    # Targets a little inside 0..1 keep separable data finite.
    target = np.where(labels == 1, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    weights = np.array([1.0, 0.0])
    features = np.stack([np.clip(margins, -30, 30), np.ones(len(margins))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = features @ w
        return float((counts * (np.logaddexp(0, z) - target * z)).sum() + 1e-3 * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (counts * (p - target)) + 2e-3 * weights
        bend = (features * (counts * p * (1 - p))[:, None]).T @ features + 2e-3 * np.eye(2)
        move, scale = np.linalg.solve(bend, slope), 1.0
        while scale > 1e-4 and loss(weights - scale * move) > loss(weights):
            scale /= 2
        weights = weights - scale * move
        if np.abs(scale * move).max() < 1e-8:
            break
    if weights[0] > 0:
        net.slope, net.shift = float(weights[0]), float(weights[1])


def threshold_of(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """The cutoff with the best F1, in the middle of the gap below it; DECISION without both classes.

    Each score stands for ``counts`` texts.
    """
    if not labels.any() or labels.all():
        return DECISION
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum((counts * labels)[order])
    taken = np.cumsum(counts[order])
    f1 = 2 * hits / (taken + hits[-1])
    ends = np.append(scores[order][1:] < scores[order][:-1], True)
    best = int(np.where(ends, f1, -1).argmax())
    below = scores[order][best + 1] if best + 1 < len(order) else 0.0
    return float((scores[order][best] + below) / 2)


@dataclass
class Classifier:
    network: Network | None
    base: float
    threshold: float
    by_language: dict[str, float]


def fold_of(key: str) -> F.Column:
    """Four folds by the CRC-32 of the key as text; fold 2 is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier:
    """Train on folds 0 and 1, calibrate on fold 3; fold 2 is never read.

    At most SAMPLE_PER_CLASS labelled keys of each class are trained on, in the
    order of a hash; all labelled rows of fold 3 calibrate, whole.  A key
    labelled both ways is toxic, null labels and keys do not count.  Without any
    usable label the score is 0 for every text, with one class only it is that
    class for every text.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col("toxic").isin(0, 1))
        .filter(fold_of(key) != 2)
        .groupBy(key)
        .agg(F.max("toxic").alias("_label"))
    )
    one = [
        known.filter((F.col("_label") == label) & (fold_of(key) != 3)).orderBy(F.xxhash64(key), key).limit(SAMPLE_PER_CLASS)
        for label in (0, 1)
    ]
    sample = F.broadcast(one[0].unionByName(one[1]))
    texts, marks = [], []
    for row in docs.join(sample, key).select(text, "_label").toLocalIterator():
        ids = np.array([buckets_of(w) for w in words_of(row[0])], np.int64).reshape(-1, 2)
        if len(ids) <= SAMPLE_WORDS:
            texts.append(ids.astype(np.int32))
            marks.append(row[1])
    mark = np.array(marks, np.int64)
    if len(set(marks)) < 2:
        base = docs.join(known, key).agg(F.avg("_label")).first()[0]
        return Classifier(None, float(base or 0.0), DECISION, {})
    net = train(texts, mark)
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    check = docs.join(known.filter(fold_of(key) == 3), key).select(F.col(text).alias("_text"), "_label", language.alias("_lang"))
    margin = F.greatest(F.least(F.col("_margin"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    counted = (
        _outputs(check, net, "_text", "_margin")
        .groupBy("_lang", "_label", F.round(margin * STEPS).cast("int").alias("_step"))
        .agg(F.count("*").alias("_n"))
        .orderBy("_lang", "_label", "_step")
        .toPandas()
    )
    mark, counts = counted["_label"].to_numpy(np.int64), counted["_n"].to_numpy(np.int64)
    margins, languages = counted["_step"].to_numpy(np.float64) / STEPS, counted["_lang"].to_numpy(object)
    calibrate(net, margins, mark, counts)
    scores = net.probability(margins)
    by_language = {}
    for name in sorted({n for n in languages if n is not None}):
        own = languages == name
        if (counts * mark)[own].sum() >= LEAST_POSITIVES:
            by_language[name] = threshold_of(scores[own], mark[own], counts[own])
    return Classifier(net, float(np.mean(marks)), threshold_of(scores, mark, counts), by_language)


class Scorer:
    """Scores texts, remembering the projections of words it has met."""

    def __init__(self, model: Classifier):
        self.model = model
        self._restart()

    def _restart(self) -> None:
        self.rows: dict[str, int] = {}
        self.projected = np.empty((1 << 12, _COLUMNS), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        net = self.model.network
        if net is None:
            return np.full(len(texts), self.model.base)
        return net.probability(self.margins(texts))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        net = self.model.network
        words = [words_of(t) for t in texts]
        if len(self.rows) > REMEMBERED:
            self._restart()
        new = list({w for text in words for w in text}.difference(self.rows))
        if new:
            pairs = np.array([buckets_of(w) for w in new], np.int64)
            first, end = len(self.rows), len(self.rows) + len(new)
            self.rows.update(zip(new, range(first, end), strict=True))
            while end > len(self.projected):
                self.projected = np.concatenate([self.projected, np.empty_like(self.projected)])
            self.projected[first:end] = net.projections(net.table[pairs[:, 0]] + net.table[pairs[:, 1]])
        counts = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        ids = np.fromiter((self.rows[w] for text in words for w in text), np.int64, int(counts.sum()))
        pooled, _ = net.pooled(self.projected[ids], starts, counts)
        return net.margins(pooled)


def _outputs(docs: DataFrame, net: Network, text: str, out: str) -> DataFrame:
    """Add the output of the network before calibration as ``out``."""
    shipped = docs.sparkSession.sparkContext.broadcast(Classifier(net, 0.0, DECISION, {}))

    def make():
        scorer = Scorer(shipped.value)
        return lambda texts: [pa.array(scorer.margins(texts.to_pylist()), pa.float64())]

    return add_from_text(docs, text, [T.StructField(out, T.DoubleType())], make, rows=64)


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is toxic as ``out`` (0 to 1).

    Only the text decides.  Null and empty texts get the probability of a text
    without words; a column already named ``out`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shipped.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            values = texts.to_pylist()
            return [pa.array(scorer(values), pa.float64())]

        return work

    return add_from_text(docs, text, [T.StructField(out, T.DoubleType())], make, rows=64)


def threshold(model: Classifier, lang: str = "lang") -> F.Column:
    """The calibrated threshold of a row's language, the general one for others."""
    found = F.lit(model.threshold)
    for name, value in model.by_language.items():
        found = F.when(F.col(lang) == name, F.lit(value)).otherwise(found)
    return found
