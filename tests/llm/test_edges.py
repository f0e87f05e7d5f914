"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, per operator."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactstream.llm import chat, decontamination, exact_search, near_dups, quality, toxicity, warc
from redactstream.llm.components import connected_components
from redactstream.llm.queries import prepare

DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, rank long, cluster string"


def docs_of(spark, pairs):
    prepare(spark)
    return spark.createDataFrame([(d, t, None, "s", None, 1, 2, "c") for d, t in pairs], DOC)


def sentence(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


# ------------------------------------------------------------------ exact search
def test_search_ties_nulls_and_own_row(spark):
    prepare(spark)
    one = [1.0, 0.5]
    rows = [(0, one), (1, one), (2, one), (3, one), (4, one), (5, one), (6, one), (7, None), (8, [1.0, None])]
    rows += [(9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (50, [0.1]), (100, one), (None, one), (200, [9.0])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, pivot int, v string")
    got = sorted(map(tuple, exact_search.top_k(vectors).collect()))
    score = 256 * 256 + 128 * 128
    assert [g for g in got if g[0] == 0] == [(0, r + 1, r + 1, score) for r in range(5)]
    assert [g for g in got if g[0] == 100] == [(100, r + 1, r, score) for r in range(5)]
    assert [g for g in got if g[0] == 50] == [(50, 1, 200, 25 * 2304)]
    assert exact_search.top_k(vectors.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 6))
def test_dual_search_is_exact(seed, n, k):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(n, 3)) * rng.choice([1, 50])) + rng.choice([0, 1], size=(n, 1)) * 40
    ids = rng.permutation(n)
    best = exact_search.dual_search(x[: n // 3 + 1], ids[: n // 3 + 1], np.full(n, -np.inf), x, ids, k)
    for q in range(n // 3 + 1):
        want = sorted((-float(x[q] @ x[j]), int(ids[j])) for j in range(n) if j != q)[:k]
        got = [(-s, int(i)) for s, i in zip(best.score[q], best.id[q]) if np.isfinite(s)]
        assert got == want


# ------------------------------------------------------------------ near duplicates
def test_near_duplicates_odd_rows(spark):
    a = sentence(1)
    words = a.split()
    rows = [
        (10, a), (3, a.upper()), (7, " ".join(["changed", *words[1:]])), (20, None), (21, " \t\n"), (22, "one two"),
        (23, "One  two"), (24, "other"), (None, a), (3, a.upper()), (30, sentence(2, 30_000)),
    ]
    got = sorted(map(tuple, near_dups.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert {d: by[d][2] for d in (3, 7, 10)} == {3: 3, 7: 3, 10: 3}
    assert by[20] == (20, 0, 20, True) and by[21] == (21, 0, 21, True)
    assert by[22] == (22, 1, 22, True) and by[23] == (23, 1, 22, False) and by[24][3]
    assert by[None][2:] == (None, True)
    kept = near_dups.without_near_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [20, 21, 22, 24, 3, 30, None]
    assert near_dups.near_duplicates(docs_of(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("options", [{"percent": 85}, {"percent": 80, "rows": 6, "bands": 42}], ids=["query", "pipeline"])
def test_large_clusters_in_blocks_keep_every_link(spark, monkeypatch, options):
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 4)
    words, rng, rows = sentence(5).split(), random.Random(3), []
    for d in range(40):
        w = list(words)
        for at in rng.sample(range(60), d % 4):
            w[at] = f"new{d}x{at}"
        rows.append((d, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(i):
                inter = len(sets[i] & sets[j])
                if 100 * inter >= options["percent"] * (len(sets[i]) + len(sets[j]) - inter):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs_of(spark, rows), **options).collect()}
    assert got == dict(enumerate(root))


def test_components(spark):
    prepare(spark)
    rows = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 50), (60, 60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(2, 31)}, 50: 40}


# ------------------------------------------------------------------ decontamination
def plain_distance(pattern, text):
    """Least edits of the pattern against any part of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30), st.integers(0, 4))
def test_bit_vectors_give_the_edit_distance(pattern, text, budget):
    want = plain_distance(pattern, text)
    best = decontamination.Pattern(pattern, budget).best(text)
    if not text:
        assert best is None
    elif want <= budget:
        # Where nothing of the pattern need be there, its whole length in edits may come first.
        assert best and best[0] == want
        begin = decontamination.Pattern(pattern, budget).begin(text, best[1])
        assert 0 <= begin <= best[1] and plain_distance(pattern, text[begin : best[1]]) == want
    else:
        assert best is None


def test_leaks_of_planted_items(spark):
    items = [(i, sentence(100 + i, n)) for i, n in enumerate((12, 30, 60))] + [(8, "tiny"), (9, None), (None, sentence(1))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    edited = list(items[1][1])
    for at in range(0, 90, 30):
        edited[at] = "z"
    half = items[2][1][: len(items[2][1]) // 2]
    rows = [
        (1, sentence(7) + " " + items[0][1].upper().replace(" ", " -- ") + "!"), (2, "".join(edited)), (3, half),
        (4, sentence(8, 3000)), (5, None), (6, ""), (7, "tiny"), (None, items[0][1]), (1, items[0][1]),
    ]
    docs = docs_of(spark, rows)
    found = decontamination.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.edits) for r in found) == [(-1, 0, 0), (1, 0, 0), (1, 0, 0), (2, 1, 3), (3, 2, 0), (7, 8, 0)]
    in_blocks = decontamination.find_leaks(docs, bench, block_chars=10).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, found))
    clean = decontamination.without_leaks(docs, bench, block_chars=10)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6] and clean.columns == docs.columns
    assert decontamination.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontamination.find_leaks(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("length, places", [(200, (96,)), (246, (120,)), (300, (100, 180))])
def test_long_items_are_found_within_their_whole_budget(spark, length, places):
    item = sentence(length)[:length]
    edited = list(item)
    for at in places:
        edited[at : at + 8] = "z" * 8
    text = "before " + "".join(edited) + " after"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, [(1, text), (2, sentence(7))])
    found = [(r.doc_id, r.item_id, r.edits) for r in decontamination.find_leaks(docs, bench).collect()]
    assert found == [(1, 1, plain_distance(item, text))] and 0 < found[0][2] <= int(length * 0.06)
    assert [r.doc_id for r in decontamination.without_leaks(docs, bench).collect()] == [2]


@pytest.mark.parametrize("length", [97, 150, 192, 384])
def test_copied_passages_are_found_at_every_offset(length):
    item = decontamination.normalised(sentence(length, 80))[:length]
    matcher = decontamination.Matcher([(1, item)], decontamination.RATE)
    for size in {96, min(150, length), length}:
        for at in range(length - size + 1):
            text = f"before it {item[at : at + size]} and after"
            assert 1 in matcher.leaks(text), (size, at)


def test_short_items_are_found_word_for_word(spark, tmp_path):
    from corpus_pipeline import decontamination as stage
    from redactstream.llm.queries import QUERIES

    items = [(1, "Who wrote Hamlet?"), (2, "谁写了哈姆雷特？"), (3, "ten"), (4, "?!"), (5, "ハムレットの作者は")]
    rows = [
        (1, "Quiz: who wrote -- HAMLET, then?"), (2, "他问谁写了哈姆雷特呢"), (3, "often tend"), (4, "who wrote hamlets"),
        (5, "Ten."), (6, "昨日ハムレットの作者は誰かと聞いた"), (7, "who wrote a hamlet ?!"), (8, None),
    ]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == [(1, 1, 0), (2, 2, 0), (5, 3, 0), (6, 5, 0)]
    assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == [3, 4, 7, 8]
    assert [(r.start, r.end) for r in found if r.doc_id == 1] == [(5, 21)]


# ------------------------------------------------------------------ learned scores
def test_toxicity_learns_grades_and_keeps_clean_documents(spark):
    rows, labels = [], []
    for d in range(300):
        bad = d % 5 == 0
        insult = " vile awful" * (1 + d % 3) if bad else ""
        rows.append((d, sentence(d, 40) + insult))
        labels.append((d, int(bad), 1))
    rows += [(1000, None), (1001, ""), (1002, sentence(9, 5000)), (1003, "VILE, awful! " + sentence(4)), (None, "x")]
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(got) == len(rows)
    assert all(got[d].toxic == (d % 5 == 0) for d in range(300)) and got[1003].toxic
    assert not any(got[d].toxic for d in (1000, 1001, 1002, None))
    assert got[5].severity > got[15].severity > got[2].severity  # 3, 1 and no repeats
    kept = toxicity.without_toxic(docs, lab)
    assert kept.count() == len(rows) - 61 and kept.columns == docs.columns
    assert toxicity.toxicity(docs, lab.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity(docs.limit(0), lab).collect() == []


def test_quality_on_held_out_documents(spark):
    rows = [(d, sentence(d, 50) if d % 3 else "%%% ".join(sentence(d, 50).split())) for d in range(400)]
    labels = [(d, int(d % 3 > 0)) for d in range(400)]
    docs = docs_of(spark, [*rows, (1000, None), (1001, ""), (1002, "x " * 50_000), (None, "x")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, lab).collect()}
    held = [d for d in range(400) if got[d].held_out]
    assert 60 < len(held) < 140
    assert np.mean([got[d].predicted == (d % 3 > 0) for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 404
    assert got[1000].score == got[1001].score
    changed = spark.createDataFrame([(d, 1 - q if got[d].held_out else q) for d, q in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.quality(docs, changed).collect()}
    assert all(again[d] == got[d].score for d in range(400))
    assert quality.quality(docs.limit(0), lab.limit(0)).collect() == []


# ------------------------------------------------------------------ archives
def test_archive_copies_and_odd_pages(spark):
    prepare(spark)
    long, short = "é" * 60, "x" * 99
    rows = [(5, long), (2, long), (9, long), (7, short), (8, short), (1, None), (3, ""), (None, long), (2, long)]
    pages = spark.createDataFrame([(p, "http://a b\r\nX: y", h, 1) for p, h in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert got == [
        (-1, 120, "revisit", 2), (1, 0, "response", None), (2, 120, "response", None), (2, 120, "response", None),
        (3, 0, "response", None), (5, 120, "revisit", 2), (7, 99, "response", None), (8, 99, "response", None), (9, 120, "revisit", 2),
    ]
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def members(n):
    made = [warc.record_bytes(i, f"u{i}", b"payload %d" % i * 20, "0" * 64, None, False) for i in range(n)]
    return made, [warc.gzip_member(m) for m in made]


def ids_and_gaps(data):
    found = list(warc.salvage(data))
    return [warc.page_number(f[1]["warc-record-id"]) for f in found if f[0] == "record"], [f[1:3] for f in found if f[0] == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_records_behind_damage(packed):
    plain, gz = members(5)
    parts = gz if packed else plain
    at = [sum(map(len, parts[:i])) for i in range(6)]
    whole = b"".join(parts)
    assert ids_and_gaps(whole) == ([0, 1, 2, 3, 4], [])
    broken = bytearray(whole)
    broken[at[2] - len(parts[1]) // 2] ^= 0xFF
    assert ids_and_gaps(bytes(broken)) == ([0, 2, 3, 4], [(at[1], at[2])])
    assert ids_and_gaps(b"junk" + whole + b"tail") == ([0, 1, 2, 3, 4], [(0, 4), (at[5] + 4, at[5] + 8)])
    assert ids_and_gaps(whole[: at[4] + 30]) == ([0, 1, 2, 3], [(at[4], at[4] + 30)])
    assert ids_and_gaps(whole[: at[1]] + whole[at[2] - 9 :]) == ([0, 2, 3, 4], [(at[1], at[1] + 9)])
    assert ids_and_gaps(b"") == ([], [])
    assert gzip.decompress(b"".join(gz)) == b"".join(plain)


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    prepare(spark)
    _, gz = members(3)
    (tmp_path / "a.warc.gz").write_bytes(gz[0] + gz[1][:-5] + gz[2])
    manifest = spark.createDataFrame([("a.warc.gz",)], "path string")
    rows = warc.read_archives(manifest, str(tmp_path))
    assert sorted(r.page_id for r in warc.records(rows).collect()) == [0, 2]
    (gap,) = warc.gaps(rows).collect()
    assert (gap.gap_start, gap.gap_end) == (len(gz[0]), len(gz[0]) + len(gz[1]) - 5)


# ------------------------------------------------------------------ chat
CHAT = [
    "plain", "", None, "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<~|im_end|>", "<~~|nl|> <|nl|>",
    "ends with <", "<<|im_end|>", "<|im_end|", "|im_end|>", "\n\n", "<|im_end|>\n", "x" * 50_000, "é👩‍👩‍👧\x00",
]


def test_chat_round_trip_of_conflicting_texts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CHAT)]
    rows += [(2, 0, t, t) for t in CHAT] + [(None, None, None, None), (3, 1, "b", "x"), (3, 1, "a", "y"), (3, 1, "a", "y")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_conversations(turns)
    parsed = {r.conv_id: r for r in made.select("*", chat.parse_turns(made["formatted"]).alias("turns")).collect()}
    assert [(t.role, t.text) for t in parsed[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(CHAT)]
    assert sorted((t.role, t.text) for t in parsed[2].turns) == sorted((t or "", t or "") for t in CHAT)
    assert [(t.role, t.text) for t in parsed[3].turns] == [("a", "y"), ("a", "y"), ("b", "x")]
    assert [(t.role, t.text) for t in parsed[None].turns] == [("", "")]
    assert "plain" in parsed[1].formatted and "<~|im_end|>" in parsed[1].formatted
    for row in parsed.values():
        at, loss = 0, []
        for run in row.runs:
            loss.append(row.formatted[at + run.before : at + run.before + run.under])
            at += run.before + run.under + run.after
        assert at == len(row.formatted)
        if row.conv_id == 1:
            assert loss[1] == "" and loss[3] == "<~|im_end|>"
    assert chat.chat_round_trip(turns.limit(0)).collect() == []
