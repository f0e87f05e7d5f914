"""Repeated windows against plain counting: hot minimisers, parts of buckets, periodic and odd texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from redactstream.llm import substrings
from redactstream.llm.queries import prepare
from redactstream.llm.words import Powers

SCHEMA = "doc_id long, text string, words string, row_key string, first int, bucket int"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "w", "k", 1, 2) for r in rows], SCHEMA)


def plain(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    starts = {}
    for w in texts:
        for i in range(len(w) - width + 1):
            starts[tuple(w[i : i + width])] = starts.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for (d, _), w in zip(rows, texts):
        gone = {j for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        out.append((d, len(w), len(gone), kept))
    return out


def got(df):
    return sorted(tuple(r)[:4] for r in df.collect())


def texts(seed, n, vocabulary, longest):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for d in range(n):
        parts = [rng.choice([" ", "\n", "\t \r"]).join(rng.choices(words, k=rng.randrange(longest)))]
        if d % 3 == 0:
            parts.insert(rng.randrange(2), passage)
        rows.append((d, "  ".join(parts)))
    return rows + [(n + k, rows[k][1]) for k in range(0, n, 5)]


@pytest.mark.parametrize("hot", [200_000, 60, 8])
@pytest.mark.parametrize("seed, vocabulary, width, run", [(1, 500, 35, 5), (2, 2, 9, 3), (3, 40, 6, 1)])
def test_repeats_match_plain_counting(spark, hot, seed, vocabulary, width, run):
    rows = texts(seed, 60, vocabulary, 90)
    df = substrings.without_repeats(frame(spark, rows), width, run, hot)
    assert got(df) == sorted(plain(rows, width))


def test_periodic_texts_stay_short_pieces(spark):
    rows = [(1, "a " * 5000), (2, "b c " * 30), (3, "d e f " * 12 + "a " * 20), (4, "g " * 34), (5, "g " * 35)]
    assert got(substrings.without_repeats(frame(spark, rows))) == sorted(plain(rows, 35))
    _, hashes, _, _, at = substrings.word_bounds(["a " * 50_000], Powers())
    _, _, first, last, repeats = substrings.super_kmers(hashes, at)
    assert len(first) == -(-(50_000 - 34) // substrings.LONGEST) and repeats.all()
    assert (last - first).sum() + len(first) == 50_000 - 34


def test_odd_rows(spark):
    long = " ".join(f"x{k % 70_001}" for k in range(140_000))
    words = " ".join(f"y{k}" for k in range(50))
    rows = [(7, None), (8, ""), (9, " \n\t"), (10, words), (10, words), (10, "é ü " + words), (None, words.upper()), (11, long)]
    df = substrings.without_repeats(frame(spark, rows))
    assert sorted(got_key(r) for r in df.collect()) == sorted((str(r[0]), *r[1:]) for r in plain(rows, 35))
    assert substrings.without_repeats(frame(spark, rows).limit(0)).collect() == []
    assert {tuple(map(tuple, r.spans)) for r in df.where("doc_id = 10").collect()} == {((0, 50),), ((1, 51),)}


def got_key(r):
    return (str(r.doc_id), r.n_words, r.n_removed, r.kept)


def test_minimisers_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 300, 400))
    other = " ".join(f"v{k}" for k in range(5000))
    alone = substrings.word_bounds([text], Powers())
    among = substrings.word_bounds([other, text, other], Powers())
    a, b = substrings.super_kmers(alone[1], alone[4]), substrings.super_kmers(among[1], among[4])
    mine = b[0] == 1
    assert (a[1] == b[1][mine]).all() and (a[2] == b[2][mine] - among[4][1]).all()
