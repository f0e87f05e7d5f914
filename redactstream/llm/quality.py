"""Quality from supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, pairs of
neighbouring words (a word beside itself is one pair for all words), and character n-grams (over bytes, a word's edge counts as a character).
A softmax layer on the average gives the classes. Both are trained with stochastic gradient descent in
numpy on a bounded sample of labelled texts.

Since the softmax is linear in the average, a trained feature adds one number to a document's
log odds; scoring sums these numbers over the whole text with array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.llm.samples import labelled_sample
from redactstream.llm.subwords import text_slices
from redactstream.llm.words import LOWER, SPACE, Powers, U, mix

PER_CLASS = 1_500
BITS = 17
DIMENSIONS = 16
GRAMS = (2, 3, 4)
EPOCHS = 5
RATE = 0.5
CUT = 0.7
SLICE = 500_000


class Features:
    """Bucket numbers of the features of texts, with the text each belongs to."""

    def __init__(self, bits: int = BITS, grams: tuple[int, ...] = GRAMS):
        self.powers, self.shift, self.grams = Powers(), U(64 - bits), grams

    def _bucket(self, h):
        return (mix(h) >> self.shift).astype(np.int32)

    def of(self, texts: list) -> Iterator[tuple]:
        """(buckets, texts' numbers), the latter ascending, for each kind of feature."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        data = LOWER[np.frombuffer(b" ".join(raw) + b"    ", np.uint8)].copy()
        at = np.cumsum([0] + [len(b) + 1 for b in raw])
        gap = SPACE[data]
        data[gap] = 32
        before = np.concatenate([[True], gap[:-1]])
        begin, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        n = len(data)
        run = np.zeros(n + 1, U)
        word = self.powers.spans(data, begin, end)
        doc = np.searchsorted(at, begin, side="right") - 1
        yield self._bucket(word), doc
        pair = doc[1:] == doc[:-1]
        # A word that repeats its neighbour makes the same pair whatever the word.
        two = np.where(word[1:] == word[:-1], U(1), word[:-1] * U(0x9E3779B97F4A7C15) + word[1:])
        yield self._bucket(two)[pair], doc[1:][pair]
        np.cumsum((data.astype(U) + U(1)) * self.powers.up[:n], out=run[1:])
        gaps = np.concatenate([[0], np.cumsum(gap)])
        place = np.repeat(np.arange(len(raw)), np.diff(at))
        for k in self.grams:
            # A gram may begin or end at a word's edge, but not span one.
            first = np.arange(min(at[-1], n - k))
            ok = gaps[first + k - 1] == gaps[first + 1]
            ok &= ~(gap[first] & gap[first + 1]) if k == 2 else True
            first = first[ok]
            h = (run[first + k] - run[first]) * self.powers.down[first]
            yield self._bucket(h + U(k)), place[first]


@dataclass
class Model:
    per_feature: np.ndarray
    bias: float
    bits: int
    grams: tuple[int, ...]

    def scorer(self):
        features = Features(self.bits, self.grams)

        def run(texts: list):
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for bucket, doc in features.of(texts):
                total += np.bincount(doc, self.per_feature[bucket], len(texts))
                count += np.bincount(doc, minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))

        return run


def fit(
    texts: list[str],
    labels: list[int],
    totals: dict[int, int],
    bits: int = BITS,
    dimensions: int = DIMENSIONS,
    grams: tuple[int, ...] = GRAMS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 5,
) -> Model:
    """Stochastic gradient descent over documents in shuffled order, same every time.

    Classes weigh as they stand among all labels. With one class only, or none, the score is
    that class's share.
    """
    n = {c: totals.get(c, 0) for c in (0, 1)}
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << bits), prior, bits, grams)
    features = Features(bits, grams)
    docs = []
    for a, b in text_slices(texts, SLICE):
        found = list(features.of(texts[a:b]))
        bucket = np.concatenate([x for x, _ in found]).astype(np.int64)
        doc = np.concatenate([x for _, x in found])
        pair, count = np.unique(doc << bits | bucket, return_counts=True)
        bounds = np.searchsorted(pair >> bits, np.arange(b - a + 1)).tolist()
        pair &= (1 << bits) - 1
        for i, j in zip(bounds[:-1], bounds[1:]):
            share = count[i:j].astype(np.float32)
            docs.append((pair[i:j].astype(np.int32), share / max(share.sum(), 1)))
    y = np.array(labels)
    weight = np.array([n[c] / max(1, (y == c).sum()) for c in (0, 1)])[y]
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    layer = np.zeros((2, dimensions), np.float32)
    bias = np.array([0, prior], np.float32)
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)).tolist():
            where, share = docs[i]
            v = vectors[where]
            mean = share @ v
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = rate * (1 - step / steps) * min(weight[i], 4.0)
            # Shares are small, so a document's vectors move by its norm, not by each share alone.
            back = (p @ layer) * (lr / max(float(share @ share), 1e-4))
            layer -= lr * np.outer(p, mean)
            bias -= 0.1 * lr * p
            vectors[where] = v - share[:, None] * np.clip(back, -1, 1)[None, :]
            step += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]), bits, grams)


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that nothing is learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*labelled_sample(docs, labels, "quality", per_class, ~held_out(F.col("doc_id"))))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, held_out, score (chance of label 1), predicted (score >= cut).

    The score sees the whole text and nothing else; null and empty texts get the bias alone.
    Rows are scored one by one; repeated rows repeat. A null doc_id is not held out.
    """
    model = fitted(docs, labels, per_class)

    def run(batches) -> Iterator:
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = [score(texts[a:b]) for a, b in text_slices(texts, SLICE)]
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = source.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted"
    )
