"""Toxicity by subword-bag embeddings under a linear softmax.

A word is a bag of hashed character n-grams (with word borders), each with an embedding; a window of
WINDOW words is the average over its n-grams, scored by a two-class softmax on top. Embeddings and
softmax are trained jointly in numpy. Because n-grams are shared, a misspelling that was never seen
still meets the vectors of its parts. A document scores as its most toxic window: a toxic one often
has a few toxic words among thousands, so its windows start out as unsure positives, and after the
first epochs only its best-scoring windows stay positive.

The classifier is fitted on a bounded sample of labelled rows: about SAMPLE_DOCS documents a class, of
LONGEST characters at most, up to SAMPLE_CHARS characters together. The bound is applied in Spark, one
task trains, and only the logits of the buckets, of fixed size, reach the driver.

Cases: a null text, one without words, scores 0; very long texts are scored whole, but not learned from;
a model without both classes scores their share; labels that are null are not learned, and of a key with
both labels only the toxic one; of texts that share a key one is learned; equal texts and scores are
equal, so there are no ties to break; rows that repeat are scored one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit
from .shared import trimmed

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4, 5)
WINDOW = 16
SAMPLE_DOCS = 2500  # bound of the training documents of each class
SAMPLE_CHARS = 3_000_000  # bound of the training text of each class
LONGEST = 150_000  # characters of a text to learn from: one alone must not use up the bound
DIMENSIONS = 12
NEUTRAL = 40  # n-grams without a vector that every window is averaged with: a short one proves less
FAIR = 6  # what a clean document taken for toxic weighs against the contrary
EPOCHS = 6
BATCH = 2048
STEPS = 500  # least steps of training: a small sample is gone through more often
RATE = 0.05


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the words of all texts, folded to lower case, with one blank at each border.

    A word that is repeated at once counts once: a run of one word is no stronger sign than the word.

    Returns a bucket for each n-gram, the n-gram at which each word begins (one more at the end), and
    the word at which each text begins (one more at the end).
    """
    folded = [" ".join(w for w, _ in groupby(t.lower().split())) for t in texts]
    codes = np.frombuffer((" " + " ".join(t for t in folded if t) + " " * (GRAMS[-1] + 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - GRAMS[-1]
    blank = codes == 32
    places, buckets = [], []
    for size in GRAMS:
        whole = np.ones(n, bool)
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x100000001B3) + codes[k : n + k]
            if 0 < k < size - 1:
                whole &= ~blank[k : n + k]
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)
        places.append(np.flatnonzero(whole))
        buckets.append(total[whole].astype(np.int32))
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    words = np.flatnonzero(blank[: n + 1][:-1] & ~blank[1 : n + 1])
    begin = np.searchsorted(place[order], np.append(words, n))
    counts = [t.count(" ") + 1 if t else 0 for t in folded]
    return np.concatenate(buckets)[order], begin, np.array([0, *np.cumsum(counts)], np.int64)


@dataclass
class Model:
    """What scoring needs of the trained network: a logit for each bucket, and the bias."""

    bucket_logits: np.ndarray
    bias: float

    @classmethod
    def constant(cls, score: float) -> Model:
        score = min(max(score, 1e-6), 1 - 1e-6)
        return cls(np.zeros(BUCKETS), float(np.log(score / (1 - score))))


def _windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of windows of WINDOW words that overlap by half, and their texts."""
    sizes, half = np.diff(starts), WINDOW // 2
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - half) // half)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    low = starts[text] + step * half
    return low, np.minimum(low + WINDOW, starts[text + 1]), text


def _split(bucket: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the windows' first n-grams, their sizes and texts; windows without n-grams go."""
    low, high, text = _windows(starts)
    first, size = begin[low], begin[high] - begin[low]
    return first[size > 0], size[size > 0], text[size > 0]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Joint training by Adam on windows; a fifth of the documents sets the decision border."""
    positive = sum(labels)
    if not texts or positive in (0, len(texts)):
        return Model.constant(positive / len(texts) if texts else 0.0)
    flats, parts, n_grams = [], [], 0
    for a, b in bytekit.slices(np.concatenate(([0], np.cumsum([len(t) for t in texts]))), 1 << 18):
        flat, begin, words = grams(texts[a:b])
        at, size, doc = _split(flat, begin, words)
        flats.append(flat.astype(np.uint16))
        parts.append((at + n_grams, size, doc + a))
        n_grams += len(flat)
    flat = np.concatenate(flats)
    starts, sizes, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    truth = np.array(labels)
    random = np.random.default_rng(seed)
    aside = random.random(len(texts)) < 0.2
    label = truth[doc]
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = random.normal(0, 0.1, DIMENSIONS).astype(np.float32)
    bias = 0.0
    first, second = np.zeros_like(vectors), np.zeros_like(vectors)
    w_first, w_second, step = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), 0

    def best_windows() -> tuple[np.ndarray, np.ndarray]:
        logits, now = (vectors @ weights).astype(np.float64), np.empty(len(starts))
        for at in range(0, len(starts), 1 << 14):  # windows lie in the order of their n-grams
            low, size = starts[at : at + (1 << 14)], sizes[at : at + (1 << 14)]
            total = np.concatenate(([0.0], np.cumsum(logits[flat[low[0] : (low + size).max()]])))
            now[at : at + (1 << 14)] = (total[low - low[0] + size] - total[low - low[0]]) / (size + NEUTRAL)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, now)
        return now, best

    epochs = max(EPOCHS, STEPS * BATCH // len(starts))
    for epoch in range(epochs):
        if epoch < max(2, epochs // 4):
            weight = np.where(label == 1, 0.5, 1.0)
        else:  # of a toxic document the best window, and others nearly as good, are the positives
            now, best = best_windows()
            weight = np.where(label == 1, (now >= best[doc] - 0.5).astype(float), 1.0)
        weight[aside[doc]] = 0
        used = np.flatnonzero(weight)
        balance = weight[label == 0].sum() / max(weight[label == 1].sum(), 1e-9)
        scale = np.where(label == 1, weight * min(balance, 8.0), weight)
        random.shuffle(used)
        for at in range(0, len(used), BATCH):
            pick = used[at : at + BATCH]
            size = sizes[pick]
            place = np.concatenate(([0], np.cumsum(size)[:-1]))
            own = flat[np.repeat(starts[pick] - place, size) + np.arange(size.sum())]
            mean = np.add.reduceat(vectors[own], place) / (size + NEUTRAL)[:, None]
            score = 1 / (1 + np.exp(-np.clip(mean @ weights + bias, -30, 30)))
            error = ((score - label[pick]) * scale[pick] / len(pick)).astype(np.float32)
            step += 1
            w_grad = np.append(error @ mean, error.sum())
            w_first += 0.1 * (w_grad - w_first)
            w_second += 0.001 * (w_grad**2 - w_second)
            unbias = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            move = RATE * unbias * w_first / (np.sqrt(w_second) + 1e-8)
            pull = np.bincount(own, np.repeat(error / (size + NEUTRAL), size), BUCKETS)
            rows = np.flatnonzero(np.bincount(own, minlength=BUCKETS))
            grad = pull[rows].astype(np.float32)[:, None] * weights
            first[rows] += 0.1 * (grad - first[rows])
            second[rows] += 0.001 * (grad**2 - second[rows])
            vectors[rows] -= RATE * unbias * first[rows] / (np.sqrt(second[rows]) + 1e-8)
            weights -= move[:-1].astype(np.float32)
            bias -= float(move[-1])
    _, best = best_windows()
    slope, cut = _border(best, truth, aside & np.isfinite(best))
    return Model((vectors @ weights).astype(np.float64) * slope, -cut * slope)


def _border(best: np.ndarray, truth: np.ndarray, aside: np.ndarray) -> tuple[float, float]:
    """Slope and cut of a document's best logit, from documents that were set aside.

    The cut has the fewest errors, a clean document counting FAIR times; among equal ones it lies in
    the widest gap, nearer to the toxic side the more toxic documents there are, as a corpus has many
    more clean documents than were set aside.
    """
    use = aside if len(set(truth[aside])) == 2 else np.isfinite(best)
    x, y = best[use], truth[use]
    order = np.argsort(x)
    x, y = x[order], y[order]
    errors = np.concatenate(([0], np.cumsum(y))) + FAIR * np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    inner = np.arange(1, len(x))
    good = inner[errors[1:-1] == errors[1:-1].min()]
    at = good[np.argmax(x[good] - x[good - 1])]
    spread = np.median(x[y == 1]) - np.median(x[y == 0])
    part = 0.3 + 0.3 * y.sum() / (y.sum() + 40)  # few toxic documents say little of where they begin
    return float(8 / max(spread, 1e-3)), float(x[at - 1] + part * (x[at] - x[at - 1]))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of whole texts; one without words scores 0."""
    bucket, begin, words = grams(texts)
    total = np.concatenate(([0.0], np.cumsum(model.bucket_logits[bucket])))
    starts, sizes, text = _split(bucket, begin, words)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, (total[starts + sizes] - total[starts]) / (sizes + NEUTRAL))
    return np.where(np.diff(words) > 0, 1 / (1 + np.exp(-np.clip(best + model.bias, -700, 700))), 0.0)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(h, label, text): at most SAMPLE_CHARS characters of labelled documents of each class.

    Labels are thinned by a hash of the key at rates that their counts give, so at most 4 * SAMPLE_DOCS
    keys are sent to the documents. Lengths are summed in the order of the texts' hashes, over the
    sample only.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1e6
    rate = F.when(F.col("label") == 1, min(1.0, SAMPLE_DOCS / max(1, counts.get(1, 0)))).otherwise(min(1.0, SAMPLE_DOCS / max(1, counts.get(0, 0))))
    keys = marked.filter(draw < rate).orderBy(F.xxhash64("key")).limit(4 * SAMPLE_DOCS)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") <= LONGEST)
    found = texts.join(F.broadcast(keys), "key").select("key", "label", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    one = found.groupBy("key", "label").agg(F.min(F.struct("h", "n")).alias("one")).select("key", "label", "one.*")
    order = Window.partitionBy("label").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    chosen = one.withColumn("total", F.sum("n").over(order)).filter(F.col("total") <= SAMPLE_CHARS).select("key", "label", "h")
    learned = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["key", "h"])
    return learned.groupBy("key", "h", "label").agg(F.min("text").alias("text")).select("h", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the bounded sample, trained in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[:2])
        model = train([r[2] for r in held], [r[1] for r in held])
        yield pa.RecordBatch.from_arrays([pa.array([model.bucket_logits.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], names=["logits", "bias"])

    trained = sample(docs, labels, key, text, label).coalesce(1).mapInArrow(trimmed(run), "logits binary, bias double").first()
    if trained is None:
        return Model.constant(0.0)
    return Model(np.frombuffer(bytes(trained["logits"]), np.float32).astype(np.float64), trained["bias"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every whole text."""
    logits, bias = model.bucket_logits.astype(np.float32).tobytes(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(np.frombuffer(logits, np.float32).astype(np.float64), bias)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            for a, b in bytekit.slices(np.concatenate(([0], ends))):
                found = scores(own, texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text the model does not reject."""
    logits, bias = model.bucket_logits.astype(np.float32).tobytes(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(np.frombuffer(logits, np.float32).astype(np.float64), bias)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in bytekit.slices(np.concatenate(([0], np.cumsum([len(t) for t in texts])))):
                yield batch.slice(a, b - a).filter(pa.array(scores(own, texts[a:b]) < 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)
