"""A quality classifier of learned subword embeddings.

Every word has a feature for itself and one for each of its byte n-grams, spaces at its ends included, hashed into a table of
vectors; a word that repeats the one before it has one more, which all such words share. A word is the mean of its features' vectors, a document the mean of its words, and a softmax over two classes gives
the score. Vectors and output are trained together by stochastic gradient descent in numpy, on a bounded sample of rows, each with its
whole text: tasks reduce a text to the shares of its features, of which there are at most as many as buckets.

Scoring needs a vector only as its products with the output weights, so a trained model is one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.llm.langid import remainder
from stepledger.llm.rolling import byte_values, tables, word_hashes, words

#: Bound of the training sample: labelled rows per class.
SAMPLE_ROWS = 1500
BUCKETS, DIMENSION, GRAMS = 1 << 16, 8, (2, 3, 4)
EPOCHS, RATE, BATCH = 8, 0.5, 16
THRESHOLD = 0.3
#: Bytes of text whose features are made at a time.
_PART = 1 << 18


def features(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """``(feature, word)`` pairs of a text as arrays, and its number of words."""
    rolling, _ = tables()
    padded = np.frombuffer(b" " + text + b" ", np.uint8)
    starts, ends = words(padded)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    hashes = word_hashes(padded, starts, ends, rolling)
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    found, owners = [hashes % np.uint64(buckets), np.zeros(len(again), np.uint64)], [np.arange(len(starts)), again]
    sizes = ends - starts + 2  # with a space at either end
    values = byte_values(np.where(np.isin(padded, (9, 10, 11, 12, 13)), 32, padded).astype(np.uint8))
    for n in GRAMS:
        per_word = np.maximum(sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(starts)), per_word)
        first = np.cumsum(per_word) - per_word
        at = np.repeat(starts - 1, per_word) + np.arange(len(owner)) - np.repeat(first, per_word)
        found.append(rolling.windows(values, n, at) % np.uint64(buckets))
        owners.append(owner)
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), len(starts)


def parts(text: bytes) -> Iterator[bytes]:
    """A text in pieces of bounded size, cut at white space unless a word is longer than a piece."""
    at = 0
    while at < len(text):
        end = min(at + _PART, len(text))
        if end < len(text):
            cut = max(text.rfind(b" ", at + 1, end), text.rfind(b"\n", at + 1, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


@dataclass(frozen=True)
class Model:
    """``contribution`` of a feature to the difference of the two classes' logits, and the constant part."""

    contribution: np.ndarray
    bias: float

    def logit(self, text: bytes) -> float:
        total, n_words = 0.0, 0
        for part in parts(text):
            found, owner, n = features(part, len(self.contribution))
            weights = np.bincount(owner, self.contribution[found], n) / np.maximum(np.bincount(owner, minlength=n), 1)
            total, n_words = total + weights.sum(), n_words + n
        return self.bias + (total / n_words if n_words else 0.0)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -50, 50))))


#: Features of a text, ascending, and the share of each in the text's mean.
Bag = tuple[np.ndarray, np.ndarray]


def bag(text: bytes, buckets: int = BUCKETS) -> Bag:
    """The shares of a whole text's features, made part by part."""
    total, n_words = np.zeros(buckets), 0
    for part in parts(text):
        found, owner, n = features(part, buckets)
        if n:
            total += np.bincount(found, 1 / np.bincount(owner, minlength=n)[owner], buckets)
            n_words += n
    own = np.flatnonzero(total)
    return own.astype(np.int32), (total[own] / max(n_words, 1)).astype(np.float32)


def train(texts: list[bytes], labels: list[int], buckets: int = BUCKETS, **settings: float) -> Model:
    """``train_bags`` on whole texts."""
    return train_bags([bag(x, buckets) for x in texts], labels, buckets, **settings)


def _shortened(rows: np.ndarray) -> np.ndarray:
    """Rows of a length above one, cut to it."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1)


def train_bags(
    bags: list[Bag], labels: list[int], buckets: int = BUCKETS, dimension: int = DIMENSION, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7
) -> Model:
    """Stochastic gradient descent over small batches, with a rate that falls to zero; classes weigh the same."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / dimension, 1 / dimension, (buckets, dimension))
    output, bias = np.zeros((dimension, 2)), np.zeros(2)
    targets = np.array(labels, np.int64)
    count = np.bincount(targets, minlength=2)
    weight = len(targets) / (2 * np.maximum(count, 1))
    steps, step = epochs * -(-len(bags) // BATCH), 0
    for _ in range(epochs if count.all() else 0):
        shuffled = random.permutation(len(bags))
        for a in range(0, len(bags), BATCH):
            batch = shuffled[a : a + BATCH]
            means = np.stack([bags[k][1] @ table[bags[k][0]] for k in batch])
            logits = means @ output + bias
            chances = np.exp(logits - logits.max(axis=1, keepdims=True))
            chances /= chances.sum(axis=1, keepdims=True)
            error = (chances - np.eye(2)[targets[batch]]) * weight[targets[batch]][:, None]
            pace = rate * (1 - step / steps)
            # Steps are of bounded length: where texts share most of their features, the two products would drive each other up.
            back = _shortened(error @ output.T)
            output -= pace * _shortened((means.T @ error).reshape(1, -1)).reshape(output.shape)
            bias -= pace * error.sum(axis=0) / len(batch)
            # A document's mean divides by its words, so the vectors' gradients are small; they are scaled up alike.
            for k, own in zip(batch, back, strict=True):
                table[bags[k][0]] -= bags[k][1][:, None] * (pace * 20 * own)
            step += 1
    known = np.append(bias[1] - bias[0], 0)[0]
    if not count.all():
        known = 4.0 if count[1] else -4.0 if count[0] else 0.0
    return Model((table @ (output[:, 1] - output[:, 0])).astype(np.float32), float(known))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> tuple[list[Bag], list[int]]:
    """A bounded sample of labelled rows: one document from each of ``rows`` shares per class, whole.

    Labels are dealt to shares by a hash of the id, and each share's smallest hash is taken; that table has at most two rows
    per share, so it is small beside the documents. A null label or text is not learned from; of repeated ids the least text is
    taken. The driver gets the bags only, at most ``2 * rows`` of at most ``buckets`` features, whatever the texts' lengths.
    """
    quality = B.field("quality").cast("int")
    dealt = labels.where(quality.isin(0, 1)).select(
        B.field("doc_id").cast("bigint").alias("id"), quality.alias("label"), F.xxhash64(B.field("doc_id")).alias("mixed")
    )
    dealt = dealt.where("id IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rows)))
    chosen = dealt.groupBy("label", "share").agg(F.min(F.struct("mixed", "id")).getField("id").alias("id"))

    @F.pandas_udf("struct<features: binary, shares: binary>")
    def bagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [bag(x.encode(), buckets) for x in texts]
            yield pd.DataFrame({"features": [own.tobytes() for own, _ in found], "shares": [shares.tobytes() for _, shares in found]})

    B.bounded_batches(docs.sparkSession)
    texts = docs.where(B.field("text").isNotNull()).select(B.field("doc_id").cast("bigint").alias("id"), B.field("text").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("label", "id").agg(F.min("text").alias("text"))
    learned = found.select("label", "id", bagged("text").alias("bag")).orderBy("label", "id").select("bag.features", "bag.shares", "label")
    bags, targets = [], []
    for own, shares, label in learned.toLocalIterator():
        bags.append((np.frombuffer(own, np.int32), np.frombuffer(shares, np.float32)))
        targets.append(label)
    return bags, targets


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, row`` per row; a null text is empty, and an empty text has the score of the bias alone."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score((x or "").encode()) for x in texts], dtype="float64")

    found = docs.select(B.packed_rows(docs)).select("row", scored(F.col("row.text")).alias("score"))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "score", predicted.alias("predicted"), "row")


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``score_quality`` with a model from the labels outside fold 0, and a column ``held_out`` for fold 0.

    Null ids belong to no fold. Without labels of both classes, all texts get one score: high, low, or a half without any.
    """
    learned = labels.where(remainder(B.field("doc_id"), folds) != 0)
    model = train_bags(*sample(docs, learned))
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return score_quality(docs, model).withColumn("held_out", held_out)
