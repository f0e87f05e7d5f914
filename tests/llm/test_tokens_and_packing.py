from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactstream.llm import token_files as tf
from redactstream.llm.packing import Tightest, best_fit_packing, pack, plan, tokenised_pieces
from redactstream.llm.queries import QUERIES, prepare
from redactstream.llm.subwords import Subwords, default_tokenizer

SF = "/root/testdata/sf0.001"
ODD = [
    "don't can'T I'LL x'sy 'tis ÀÉ Straße ΣΑΣ İstanbul é é 12½ ² ª × ÷ x\x1cy\x85z a_b _ 'S '",
    "",
    None,
    "  \n\t ",
    "a<|endoftext|>b <|startoftext|> <| |> <|ENDOFTEXT|>",
    "日本語 ​ ﻿ “hi” — ſ K é \x00",
    "a×b÷ ÿÞß ́ x́",
    "word " * 5000,
    "z" * 20000,
]


@pytest.fixture(scope="module")
def encoder():
    return Subwords(default_tokenizer())


def direct(encoder, text):
    return encoder.tok.encode(text or "", add_special_tokens=False).ids


def test_subwords_give_the_librarys_ids(encoder):
    ids, at = encoder.encode(ODD)
    for k, text in enumerate(ODD):
        assert ids[at[k] : at[k + 1]].tolist() == direct(encoder, text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_subwords_on_any_text(encoder, texts):
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [direct(encoder, t) for t in texts]


def test_forgetting_words_changes_nothing():
    small = Subwords(default_tokenizer(), known_words=5)
    for _ in range(2):
        ids, at = small.encode(["one two three four five six", "seven eight nine"])
        assert ids.tolist() == direct(small, "one two three four five six") + direct(small, "seven eight nine")


def naive_best_fit(lengths, capacity):
    """Piece by piece, every open sequence looked at."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_the_piece_by_piece_packing(case):
    capacity, lengths = case
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = plan(counts, capacity)
    used, seen = {}, {n: 0 for n in counts}
    for k, (n, rank, first, per, offset) in enumerate(rows):
        assert rank == seen[n]
        later = [r[1] for r in rows[k + 1 :] if r[0] == n]
        count = (later[0] if later else counts[n]) - rank
        seen[n] += count
        for i in range(count):
            used.setdefault(first + i // per, []).append((offset + i % per * n, n))
    assert seen == counts
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end = at + n
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == naive_best_fit(lengths, capacity)


def test_tightest():
    tree = Tightest(10)
    for room in (3, 7, 10):
        tree.set(room, True)
    assert [tree.at_least(x) for x in (1, 3, 4, 8)] == [3, 3, 7, 10]
    tree.set(10, False)
    assert tree.at_least(8) is None


def check_packing(rows, encoder, texts, capacity=2048, end_id=0):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for d, text in texts.items():
        ids = np.array([*direct(encoder, text), end_id], "<u4")
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity)))
        for p in pieces:
            part = ids[p.start : p.start + capacity]
            assert (p.start, p.length) == (p.piece * capacity, len(part))
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
    for places in by_sequence.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end = at + n
        assert end <= capacity
    lengths = [r.length for r in rows]
    assert len(by_sequence) == len(naive_best_fit(lengths, capacity))


def test_query_packs_every_document(spark, documents, encoder):
    texts = {r.doc_id: r.text for r in documents.collect()}
    check_packing(QUERIES["op1_best_fit_packing"](spark, SF).collect(), encoder, texts)


def test_odd_documents_are_packed(spark, encoder, docs_schema):
    prepare(spark)
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, docs_schema)
    check_packing(best_fit_packing(docs, capacity=64).collect(), encoder, dict(enumerate(ODD)), 64)
    assert best_fit_packing(docs.limit(0)).collect() == []


def test_repeated_and_null_rows_are_packed_apart(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "x"), (None, None)], "doc_id long, text string")
    rows = best_fit_packing(docs, capacity=8).collect()
    assert len(rows) == 5
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5


def test_pieces_carry_their_ids(spark, encoder):
    prepare(spark)
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    rows = tokenised_pieces(docs, capacity=2, with_ids=True).orderBy("piece").collect()
    assert [i for r in rows for i in r.ids] == [*direct(encoder, "alpha beta gamma delta"), 0]


def test_too_long_pieces_are_refused(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 9, 0)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(ValueError):
        pack(pieces, capacity=8)


# ------------------------------------------------------------------ token files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=700), st.sampled_from([64, 128, 1024]))
def test_file_round_trip(values, block):
    ids = np.array(values, "<u4")
    sizes = np.array([len(values)] if values else [], np.int64)
    data = tf.encode_file(ids, np.arange(len(sizes)), np.ones(len(sizes), bool), sizes, block)
    back, _, _, n = tf.decode_file(data)
    assert back.tolist() == values and n.tolist() == sizes.tolist()
    for k in range(-(-len(values) // block)):
        assert tf.read_block(data, k).tolist() == values[k * block : (k + 1) * block]


def test_outliers_become_exceptions():
    ids = np.full(1024, 5, "<u4")
    ids[7] = 4_000_000_000
    (block,) = tf.encode_blocks(ids)
    head = np.frombuffer(block, tf.BLOCK_HEAD, 1)[0]
    assert (head["least"], head["width"], head["exceptions"]) == (5, 1, 1)
    assert len(block) == tf.BLOCK_HEAD.itemsize + 128 + 6


def test_broken_files_are_refused():
    data = tf.encode_file(np.arange(10), [1], [True], [10])
    for bad in (b"", data[:20], b"X" + data[1:]):
        with pytest.raises(ValueError):
            tf.decode_file(bad)


def expected_files(encoder, texts, end_id=2):
    out, start = [], 0
    for d in sorted(texts):
        ids = np.array([*direct(encoder, texts[d]), end_id], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_reads_back_every_document(spark, documents, encoder):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = QUERIES["op10_token_files"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == expected_files(encoder, texts)


def test_many_small_files_and_odd_documents(spark, encoder, tmp_path):
    prepare(spark)
    docs = spark.createDataFrame([(i * 7 % 9, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    manifest = tf.write_token_files(docs, str(tmp_path / "t"), shard_ids=50)
    assert manifest.count() > 2
    rows = tf.read_token_files(manifest, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, rows)) == expected_files(encoder, {i * 7 % 9: t for i, t in enumerate(ODD)})


def test_null_ids_come_first_and_empty_tables_give_nothing(spark):
    prepare(spark)
    docs = spark.createDataFrame([(3, "a"), (None, "b c"), (3, "a"), (None, None)], "doc_id long, text string")
    rows = sorted(tf.token_files(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 3, 3]
    assert tf.token_files(docs.limit(0)).collect() == []
