"""Toxicity as graded severity: cumulative-link ordinal regression on sparse word features.

The labels say toxic or not. Grades are made from them: clean documents are 0; words that mark
toxic documents (by smoothed log odds over the sample) are counted, and the toxic documents
are graded 1, 2 and 3 by the thirds of that count. The model is
P(grade >= j) = sigmoid(w.x - theta_j) with one weight per word for all thresholds and
theta_1 < theta_2 < theta_3; x is log(1 + occurrences) of the word. A penalty on the weights'
sizes leaves most of them zero. Severity is the expected grade, the sum of the three.

The model is fitted on a bounded sample and is a list of words with weights, so scoring looks
up words and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactstream.llm.samples import labelled_sample
from redactstream.llm.subwords import text_slices
from redactstream.llm.words import LOWER, Powers, mix

PER_CLASS = 2_000
GRADES = 3
LEAST_DOCS = 3
PENALTY = 2e-4
STEPS = 150
REJECT = 0.35
SLICE = 1_000_000

# Letters, digits and all bytes beyond ASCII make words.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    WORD_BYTE[_a:_b] = True


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Counter:
    """Word hashes of texts, and the text each belongs to."""

    def __init__(self):
        self.powers = Powers()

    def words(self, texts: list):
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        at = np.cumsum([0] + [len(b) + 1 for b in raw])
        inside = WORD_BYTE[data]
        before = np.concatenate([[False], inside[:-1]])
        begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        h = mix(self.powers.spans(LOWER[data], begin, end))
        return h, np.searchsorted(at, begin, side="right") - 1


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def scorer(self):
        """A function from texts to P(grade >= j), one row per text."""
        counter = Counter()
        bits = np.uint64(48)
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.words >> bits).astype(np.int64)] = True

        def run(texts: list):
            z = np.zeros(len(texts))
            h, doc = counter.words(texts)
            hit = np.flatnonzero(maybe[(h >> bits).astype(np.int64)])
            if len(self.words) and len(hit):
                k = np.minimum(np.searchsorted(self.words, h[hit]), len(self.words) - 1)
                same = self.words[k] == h[hit]
                pair, n = np.unique(doc[hit[same]] * len(self.words) + k[same], return_counts=True)
                d, w = np.divmod(pair, len(self.words))
                z = np.bincount(d, self.weights[w] * np.log1p(n), len(texts))
            return sigmoid(z[:, None] - self.theta[None, :])

        return run


def grades(doc, word, y, n_words: int):
    """Grades of the sample from its labels, by the occurrences of words that mark toxic texts."""
    pair, n = np.unique(doc * n_words + word, return_counts=True)
    d, w = np.divmod(pair, n_words)
    toxic = y == 1
    df1 = np.bincount(w[toxic[d]], minlength=n_words)
    df0 = np.bincount(w[~toxic[d]], minlength=n_words)
    odds = np.log((df1 + 0.5) / (toxic.sum() + 1)) - np.log((df0 + 0.5) / ((~toxic).sum() + 1))
    marks = (odds > 2.5) & (df1 >= LEAST_DOCS)
    count = np.bincount(d, n * marks[w], len(y))
    out = np.zeros(len(y), np.int64)
    cuts = np.quantile(count[toxic], [1 / 3, 2 / 3])
    out[toxic] = 1 + (count[toxic] > cuts[0]) + (count[toxic] > cuts[1])
    return out


def fit(texts: list[str], labels: list[int], totals: dict[int, int], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Weighted so that the classes count as they stand among all labels; full-batch steps, same every time."""
    y = np.array(labels, np.int64)
    if not (y == 0).any() or not (y == 1).any():
        # Nothing to learn from: everything is clean, or everything is toxic.
        bias = -20.0 if (y == 1).any() else 20.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, bias))
    h, doc, counter = [], [], Counter()
    for a, b in text_slices(texts, SLICE):
        hashes, of = counter.words(texts[a:b])
        h.append(hashes)
        doc.append(of + a)
    words, word = np.unique(np.concatenate(h), return_inverse=True)
    doc = np.concatenate(doc)
    grade = grades(doc, word, y, len(words))
    pair, n = np.unique(doc * len(words) + word, return_counts=True)
    d, w = np.divmod(pair, len(words))
    often = np.bincount(w, minlength=len(words)) >= LEAST_DOCS
    keep = often[w]
    number = np.cumsum(often) - 1
    d, w, x = d[keep], number[w[keep]], np.log1p(n[keep])
    words = words[often]
    share = np.array([totals.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)])[y]
    share = share / share.sum()
    # Per step: residuals for each threshold, one gradient for the shared weights.
    beta, slack = np.zeros(len(words)), np.full(len(words), 1e-8)
    above = grade[:, None] >= np.arange(1, GRADES + 1)
    p = np.clip((share[:, None] * above).sum(axis=0), 1e-4, 1 - 1e-4)
    theta, theta_slack = -np.log(p / (1 - p)), np.full(GRADES, 1e-8)
    for _ in range(steps):
        z = np.bincount(d, beta[w] * x, len(y))
        # The likelihood of a grade is the difference of two neighbouring sigmoids.
        s = sigmoid(z[:, None] - theta[None, :])
        upper = np.concatenate([np.ones((len(y), 1)), s], axis=1)[np.arange(len(y)), grade]
        lower = np.concatenate([s, np.zeros((len(y), 1))], axis=1)[np.arange(len(y)), grade]
        chance = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        g = -share * (up - down)
        grad = np.bincount(w, g[d] * x, len(words))
        slack += grad**2
        step = 0.3 / np.sqrt(slack)
        beta -= step * grad
        beta = np.sign(beta) * np.maximum(np.abs(beta) - step * penalty, 0)
        cut_grad = np.zeros(GRADES)
        for j in range(1, GRADES + 1):
            cut_grad[j - 1] = (share * up)[grade == j].sum() - (share * down)[grade == j - 1].sum()
        theta_slack += cut_grad**2
        theta = theta - 0.3 * cut_grad / np.sqrt(theta_slack)
        theta = np.maximum.accumulate(theta + np.arange(GRADES) * 1e-6)
    live = beta != 0
    return Model(words[live], beta[live], theta)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", per_class))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, reject: float = REJECT) -> DataFrame:
    """Per document: doc_id, severity (0 to 3), grade, p_toxic (grade 1 or more), toxic.

    Whole texts are scored. A null or empty text has no words and gets the base rate. A document is
    toxic where p_toxic reaches `reject`. Rows are scored one by one; repeated rows repeat.
    With no labels, or labels of one class, every document is of that class.
    """
    model = fitted(docs, labels, per_class)

    def run(batches) -> Iterator:
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = [score(texts[a:b]) for a, b in text_slices(texts, SLICE)]
            p = np.concatenate(p) if p else np.zeros((0, GRADES))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(p.sum(axis=1)),
                    pa.array((p >= 0.5).sum(axis=1).astype(np.int32)),
                    pa.array(p[:, 0].copy()),
                    pa.array(p[:, 0] >= reject),
                ],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, reject: float = REJECT) -> DataFrame:
    """The documents that are not toxic; all columns, judged row by row."""
    model = fitted(docs, labels, per_class)
    source = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string"))
    kind = source.schema["row"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = [score(texts[a:b])[:, 0] for a, b in text_slices(texts, SLICE)]
            yield batch.filter(pa.array(np.concatenate(p) < reject if p else [], pa.bool_()))

    kept = source.mapInArrow(run, f"row {kind}, text string")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
