"""Decontamination against a plain search, and salvage inside damaged archive members."""

from __future__ import annotations

import numpy as np
import pytest

from redactstream.llm import decontamination, warc
from redactstream.llm.queries import QUERIES, prepare


def codes(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def plain_least(pattern, text):
    """Least edits of the pattern against any part of the text, a row of the table at a time."""
    t = codes(text)
    places = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(codes(pattern), 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (t != c))])
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def test_query_finds_what_a_plain_search_finds(spark, tmp_path):
    prepare(spark)
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    items = spark.read.parquet(f"{root}/benchmark.parquet").orderBy("item_id").limit(6)
    texts = {r.item_id: decontamination.normalised(r.text) for r in items.collect()}
    small = docs.where("length(text) < 1500").orderBy("doc_id").limit(40)
    lead = "it was said that "
    rows = [(10_000 + i, lead + t[: len(t) // 2] + " zq " + t[len(t) // 2 + 2 :]) for i, t in texts.items()]
    rows += [(20_000 + i, lead + t[5:110]) for i, t in texts.items()]
    planted = small.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    planted.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()}
    want, whole = set(), {}
    for d, text in ((r.doc_id, decontamination.normalised(r.text)) for r in planted.collect()):
        for i, item in texts.items():
            least = plain_least(item, text) if text else len(item)
            if least <= int(len(item) * decontamination.RATE):
                whole[d, i] = least
                want.add((d, i))
            elif any(text and plain_least(w, text) <= int(len(w) * decontamination.RATE) for w in decontamination.windows(item)):
                want.add((d, i))
    assert set(got) == want and {(d, d % 10_000) for d, _ in rows} <= want
    assert {k: got[k].edits for k in whole} == whole


@pytest.mark.parametrize("item, text, place", [
    ("abcdefghijklmnopqrstuvwx", "one abcdefghijklxmnopqrstuvwx two", (1, 4, 29)),
    ("abcdefghijklmnopqrstuvwx", "one abcdefghijkmnopqrstuvwx two", (1, 4, 27)),
    ("who wrote hamlet", "so who wrote hamlet then", (0, 3, 19)),
    ("who wrote macbeth", "so who wrote mcbeth then", (1, 3, 19)),
])
def test_places_begin_where_the_match_does(item, text, place):
    assert decontamination.Matcher([(1, item)], decontamination.RATE).leaks(text) == {1: place}


# ------------------------------------------------------------------ archives
def made(n, size=20):
    return [warc.record_bytes(i, f"u{i}", b"payload %d" % i * size, "0" * 64, None, False) for i in range(n)]


def salvaged(data):
    found = list(warc.salvage(data))
    ids = [warc.page_number(f[1]["warc-record-id"]) for f in found if f[0] == "record"]
    return ids, [f[1:] for f in found if f[0] == "gap"]


def test_a_bad_record_costs_the_others_of_its_member_nothing():
    plain = made(5)
    plain[2] = plain[2].replace(b"payload 2", b"Payload 2", 1)
    member, other = warc.gzip_member(b"".join(plain)), warc.gzip_member(made(7)[6])
    ids, gaps = salvaged(member + other)
    assert ids == [0, 1, 3, 4, 6]
    start = len(plain[0] + plain[1])
    assert gaps == [(0, len(member), f"unpacked bytes {start} to {start + len(plain[2])}: block digest differs")]


def test_a_last_member_cut_off_keeps_its_whole_records():
    import random

    noise = random.Random(1)
    plain = [warc.record_bytes(i, "u", noise.randbytes(40_000).hex().encode(), "0" * 64, None, False) for i in range(4)]
    whole = warc.gzip_member(b"".join(plain))
    for cut in (len(whole) - 1, len(whole) - 4, len(whole) * 3 // 5, len(whole) // 3):
        ids, gaps = salvaged(whole[:cut])
        assert ids == list(range(4 if cut > len(whole) - 5 else 2 if cut > len(whole) // 2 else 1))
        assert [g[1:] for g in gaps] in ([], [(cut, "gzip member is cut off")])
    tail = warc.gzip_member(made(10)[9])
    broken = bytearray(whole)
    broken[len(whole) * 3 // 5] ^= 0x55
    ids, gaps = salvaged(bytes(broken) + tail)
    assert ids[:2] == [0, 1] and ids[-1] == 9 and len(ids) == len(set(ids)) and len(gaps) >= 1


def test_the_round_trip_refuses_loss(spark, tmp_path):
    prepare(spark)
    plain = made(3)
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(b"".join(plain)))
    read = lambda n: warc.read_archives(spark.createDataFrame([("a.warc.gz", n)], "path string, n_records long"), str(tmp_path), strict=True)
    assert sorted(r.page_id for r in read(3).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="3 records of 4"):
        read(4).collect()
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(plain[0]) + b"junk" + warc.gzip_member(plain[1] + plain[2]))
    with pytest.raises(Exception, match="are lost"):
        read(3).collect()
