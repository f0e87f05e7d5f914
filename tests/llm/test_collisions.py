"""Texts written to make words share a hash, and ids shared by unlike texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from redactstream.llm import near_dups, subwords
from redactstream.llm.queries import prepare
from redactstream.llm.words import Words, fold, word_keys


def docs_of(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, "doc_id long, text string")


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2^n letters and its complement, alike to every sum of powers modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def encoder():
    return Tokenizer.from_file(subwords.default_tokenizer())


def library_ids(encoder, texts):
    return [e.ids for e in encoder.encode_batch(texts, add_special_tokens=False)]


def split_ids(ids, at):
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("n", [10, 11, 12])
def test_crafted_words_get_their_own_ids(encoder, n):
    texts = list(thue_morse(n))
    encode = subwords.Subwords(subwords.default_tokenizer()).encode
    assert split_ids(*encode(texts)) == library_ids(encoder, texts)
    assert [split_ids(*encode([t]))[0] for t in texts[::-1]] == library_ids(encoder, texts[::-1])


def test_words_that_share_a_hash_are_encoded_apart(encoder, monkeypatch):
    coder = subwords.Subwords(subwords.default_tokenizer())
    coder.fold = lambda first, second, size: np.full(len(first), 77, np.uint64)
    texts = ["alpha beta don't", "beta", "gamma alpha", "", "x" * 40 + " " + "x" * 41, "don't alpha"]
    assert split_ids(*coder.encode(texts)) == library_ids(encoder, texts)
    assert split_ids(*coder.encode(texts[::-1])) == library_ids(encoder, texts[::-1])


def test_word_keys_tell_spans_apart():
    spans = [b"a", b"a\0", b"a\0\0", b"12345678", b"123456789", b"x" * 16, b"x" * 17, b"", b"\0"]
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(s) for s in spans])
    begin = end - [len(s) for s in spans]
    first, second = word_keys(data, begin, end)
    assert len({*zip(first.tolist(), second.tolist(), (end - begin).tolist())}) == len(spans)
    assert len(set(fold(first, second, end - begin, (5, 9)).tolist())) == len(spans)
    again = word_keys(data, begin[4:6], end[4:6])
    assert [again[0].tolist(), again[1].tolist()] == [first[4:6].tolist(), second[4:6].tolist()]


@pytest.mark.parametrize("n", [10, 12])
def test_crafted_words_give_their_own_shingles(n):
    a, b = near_dups.distinct_sets(Words((3, 4)), [f"{w} one two three four" for w in thue_morse(n)], 5)
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_crafted_texts_are_no_copies(spark):
    rows = [(i, f"{w} one two three four") for i, w in enumerate(thue_morse(11))]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {0: 0, 1: 1}


# ------------------------------------------------------------------ repeated ids
def test_unlike_texts_of_one_id_both_stay(spark):
    v, w = sentence(1), sentence(2)
    docs = docs_of(spark, [(1, v), (1, w), (2, w), (3, v)])
    got = sorted(map(tuple, near_dups.near_duplicates(docs).collect()))
    assert got == [(1, 56, 1, True), (1, 56, 1, True), (2, 56, 1, False), (3, 56, 1, False)]
    kept = near_dups.without_near_duplicates(docs)
    assert sorted(map(tuple, kept.collect())) == sorted([(1, v), (1, w)])


def test_near_copies_of_one_id_leave_one(spark):
    v, other = sentence(1), sentence(9)
    near = v + " more"
    docs = docs_of(spark, [(5, near), (5, v), (5, v), (5, other), (7, near), (4, other + " more"), (None, v), (5, None)])
    kept = sorted(map(tuple, near_dups.without_near_duplicates(docs).collect()), key=str)
    assert [(d, t) for d, t in kept if t not in (v, near)] == [(4, other + " more"), (5, None)]
    assert [d for d, t in kept if t in (v, near)] == [5, None]


def test_hot_and_other_classes_give_the_same_groups(spark, monkeypatch):
    rows = [(i, sentence(i % 7)) for i in range(60)] + [(100 + i, sentence(20 + i)) for i in range(9)]
    want = {i: i % 7 if i < 60 else i for i, _ in rows}
    for hot in (1, 10, 1000):
        monkeypatch.setattr(near_dups, "HOT", hot)
        got = near_dups.near_duplicates(docs_of(spark, rows)).collect()
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
