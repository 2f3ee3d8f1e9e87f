"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams and itself, hashed into buckets; a
bucket has an embedding, a word the mean of its buckets', a text the mean of its
words', and a softmax over two classes is linear in that mean. Embeddings and
softmax are trained together in numpy, so a misspelling nobody has labelled
shares the vectors of the n-grams it has in common with the words seen.

Since everything behind the embeddings is linear, scoring folds the softmax into
one number per bucket: a text's log-odds are the mean of its words' numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from contactlake.llm.common import fresh

BUCKETS = 1 << 18
#: every bucket of the sample has an embedding; one whose presence differs between
#: the classes by so many standard errors counts a quarter, one with less far less
DOUBT = 6.0
DIMENSIONS = 4
NGRAMS = (3, 4, 5)
#: the classifier is fitted on so many labelled documents of each class at
#: most, chosen by their ids' hash, of at most so many characters each
TRAIN_PER_CLASS = 1_000
TRAIN_CHARS = 10_000
EPOCHS = 150
RATE = 0.03
DECAY = 0.1
FLOOR = 0.1
FOLDS = 5
#: what stands around a word does not belong to it
EDGES = ".,;:!?\"'()[]{}<>|*#&%$-_`~"
REMEMBERED = 400_000


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def buckets(word: str) -> list[int]:
    """The buckets of a word's n-grams, its ends marked, and of the word itself; none for bare marks."""
    core = word.strip(EDGES)
    if not core:
        return []
    marked = f"<{core}>"
    grams = {marked} | {marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}
    return sorted({crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams})


@dataclass(frozen=True)
class Model:
    """Log-odds per bucket, and of a text without words."""

    odds: np.ndarray
    bias: float


def _segments(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(lengths, np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), lengths


def _pooled(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean of all texts' bags as sparse (text, bucket, share): a word's buckets share its part of the text."""
    known: dict[str, np.ndarray] = {}
    found, shares = [], []
    for text in texts:
        bag = Counter(tokens(text))
        if len(known) > REMEMBERED // 8:
            known.clear()
        known.update((w, np.array(buckets(w), np.int32)) for w in bag if w not in known)
        own = [known[w] for w in bag]
        part = np.array([n / max(1, len(b)) for n, b in zip(bag.values(), own)]) / max(1, sum(bag.values()))
        flat = np.concatenate([*own, np.zeros(0, np.int32)])
        bucket, where = np.unique(flat, return_inverse=True)
        found.append(bucket)
        shares.append(np.bincount(where, np.repeat(part, [len(b) for b in own]), len(bucket)).astype(np.float32))
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    return row, np.concatenate([*found, np.zeros(0, np.int32)]), np.concatenate([*shares, np.zeros(0, np.float32)])


def train(texts: Sequence[str], labels: Sequence[int], weights: Sequence[float], seed: int = 1) -> Model:
    """Fit the embeddings of all buckets of the texts, and the softmax, on weighted examples of both classes."""
    label, n = np.asarray(labels, int), len(texts)
    row, bucket, share = _pooled(texts)
    chosen, place = np.unique(bucket, return_inverse=True)
    k = len(chosen)
    sizes = [max(1, int(np.sum(label == c))) for c in (0, 1)]
    present = [np.bincount(place[label[row] == c], minlength=k) / sizes[c] for c in (0, 1)]
    both = np.bincount(place, minlength=k) / n
    error = np.sqrt((both * (1 - both) + 1 / n) * (1 / sizes[0] + 1 / sizes[1]))
    evidence = ((present[1] - present[0]) / error) ** 2
    trust = np.maximum(evidence / (evidence + DOUBT**2), 1e-6) ** 2
    spread = (np.sqrt(np.bincount(place, share * share, k) / n) + 1e-6) / trust
    value = share / spread[place]

    rng = np.random.default_rng(seed)
    params = {
        "e": rng.normal(0, 0.01, (k, DIMENSIONS)).astype(np.float32),
        "w": rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), "b": np.zeros(2, np.float32),
    }
    weight = np.asarray(weights) / np.sum(weights)
    first, second = ({name: np.zeros_like(v) for name, v in params.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        # with two classes all follows from one number a bucket and one slope a text
        folded = params["e"] @ (params["w"][:, 1] - params["w"][:, 0])
        logits = np.bincount(row, value * folded[place], n) + params["b"][1] - params["b"][0]
        slope = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - label) * weight
        back = np.bincount(place, value * slope[row], k).astype(np.float32)
        sides = np.stack([-back, back], 1)
        grads = {"e": sides @ params["w"].T, "w": params["e"].T @ sides, "b": np.array([-slope.sum(), slope.sum()], np.float32)}
        for name, g in grads.items():  # Adam; the floor keeps n-grams that tell little from moving like the others
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            floor = FLOOR * float(np.sqrt(second[name].max(initial=0.0))) + 1e-12
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name]) + floor) * np.sqrt(1 - 0.99**step)
            params[name] = params[name] - RATE * move - RATE * DECAY * params[name] * (name != "b")
    odds = np.zeros(BUCKETS, np.float32)
    odds[chosen] = params["e"] @ (params["w"][:, 1] - params["w"][:, 0]) / spread
    return Model(odds, float(params["b"][1] - params["b"][0]))


class Scorer:
    """Texts to probabilities; remembers words that come again."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        known, odds = self.known, self.model.odds
        if len(known) > REMEMBERED:
            known.clear()
        cut = [tokens(t) for t in texts]
        new = [w for w in set().union(*cut) if w not in known]
        bags = [buckets(w) for w in new]
        into, lengths = _segments([len(b) for b in bags])
        flat = np.fromiter((x for b in bags for x in b), np.int64, len(into))
        sums = np.bincount(into, odds[flat], len(new)) / np.maximum(lengths, 1) if new else []
        known.update(zip(new, map(float, sums)))
        value = known.__getitem__
        logits = np.array([sum(map(value, w)) / len(w) if w else 0.0 for w in cut]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def fold(key: Column) -> Column:
    """The fold of a row by its key's text; fold 0 is held out, a null key is in no fold."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows outside fold 0.

    Of each class up to ``TRAIN_PER_CLASS`` ids are taken in the order of their
    hash, and of those the texts of up to ``TRAIN_CHARS`` characters; weights
    restore the classes' shares among all labelled rows. Null keys and labels
    are left out; of repeated labels the highest counts, of repeated documents
    the least text. With fewer than two classes every text scores their share.
    """
    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isNotNull() & (fold(F.col("key")) != 0))
        .groupBy("key").agg(F.max("label").alias("label"))
    )
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if sizes.get(0, 0) == 0 or sizes.get(1, 0) == 0:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1.0) if sizes else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))) if 0 < share < 1 else -30.0)
    chosen = None
    for c in (0, 1):
        part = known.filter(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(TRAIN_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        .filter(F.length("text") <= TRAIN_CHARS)
        .join(F.broadcast(chosen), "key")  # 2 * TRAIN_PER_CLASS keys at most
        .groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .toPandas().sort_values("key")
    )
    drawn = rows["label"].value_counts()
    if len(drawn) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(sizes[1] / sizes[0])))
    weights = rows["label"].map(lambda c: sizes[c] / drawn[c])
    return train(rows["text"].tolist(), rows["label"].tolist(), weights.tolist())


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """The probability that a whole text is toxic; null and empty texts get the bias alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    name = crc32(model.odds.tobytes() + repr(model.bias).encode())

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shipped.value)
        return pd.Series(_scorers[name].score(texts))

    return probability(text)


def score_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """Per row ``(key, held_out, score, predicted)``; the model is fitted outside fold 0.

    Repeated rows and null keys stay and are scored (a null key is not held
    out); an empty table gives an empty result.
    """
    model = fit(docs, labels, key, text, label)
    scored = docs.select(F.col(key).alias(key), score(docs, model, F.col(text)).alias("score"))
    return scored.select(
        key, F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """The documents that score below 0.5; all columns are kept."""
    model, scored = fit(docs, labels, key, text, label), fresh(docs, "score")
    return docs.withColumn(scored, score(docs, model, F.col(text))).filter(F.col(scored) < 0.5).drop(scored)
