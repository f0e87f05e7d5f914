"""File sources and corpus helpers on small fixtures."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from redactstream.functions import address as adr
from redactstream.operators import corpus as co
from redactstream.sources import files


def put(workdir, name, data):
    path = Path(workdir) / name
    path.write_bytes(data)
    return str(path)


def texts(df):
    return [r.text for r in df.orderBy("row_id").collect()]


def test_csv_with_bom_padded_header_and_blank_rows(spark, workdir):
    path = put(workdir, "a.csv", "﻿ id , note \n1, hello \n2,\n3,\"two\nlines\"\n4,café\n".encode())
    assert files.csv_columns(spark, path) == ["id", "note"]
    assert texts(files.read_rows(spark, path, "note")) == ["hello", "two\nlines", "café"]
    assert texts(files.read_rows(spark, path)) == ["1", "2", "3", "4"]


def test_unknown_column_names_the_real_ones(spark, workdir):
    path = put(workdir, "a.csv", b"id,note\n1,x\n")
    with pytest.raises(ValueError, match="id, note"):
        files.read_rows(spark, path, "memo")


def test_older_encoding_still_opens(spark, workdir):
    path = put(workdir, "a.csv", "id,note €\n1,caf\xe9 “x”\n".encode("cp1252"))
    assert texts(files.read_rows(spark, path, "note €")) == ["café “x”"]
    path = put(workdir, "a.txt", "5 €\n".encode("cp1252"))
    assert texts(files.read_rows(spark, path)) == ["5 €"]


def test_text_file_rows(spark, workdir):
    path = put(workdir, "a.txt", '﻿one\n\n  two, "x" \n   \nthree\n'.encode())
    assert texts(files.read_rows(spark, path)) == ["one", 'two, "x"', "three"]


def test_widest_column(spark, workdir):
    path = put(workdir, "a.csv", b"id,note,other\n1,long text here,x\n2,more text,y\n")
    assert files.widest_column(files.read_csv(spark, path)) == "note"
    tie = put(workdir, "b.csv", b"a,b\nxx,yy\n")
    assert files.widest_column(files.read_csv(spark, tie)) == "a"
    header = put(workdir, "c.csv", b"a,b\n")
    assert files.widest_column(files.read_csv(spark, header)) == "a"


def test_labelled_documents(spark, workdir):
    rows = [
        ("us", "Call O'Neil now", "[{'start': 5, 'end': 11, 'text': \"O'Neil\", 'label': 'person'}]"),
        ("us", "none", "[]"),
    ]
    spark.createDataFrame(rows, "locale string, text string, spans string").write.parquet(f"{workdir}/d")
    docs = files.labelled_documents(spark, f"{workdir}/d", ["locale", "text"])
    got = files.labelled_spans(docs, ["locale"]).collect()
    assert [(r.locale, r.label, r.surface) for r in got] == [("us", "person", "O'Neil")]


ELEMENTS = [
    {"type": "node", "id": 1, "tags": {"addr:street": "Hill Road", "addr:housenumber": "14", "addr:city": "islamabad", "name": "Bilal Home", "phone": "0301"}},
    {"type": "way", "id": 2, "tags": {"addr:street": "Hill Road", "addr:housenumber": "14", "addr:city": "Islamabad", "building": "house"}},
    {"type": "way", "id": 3, "tags": {"addr:street": "Hill Road", "addr:housenumber": "14", "addr:city": "Islamabad", "building": "yes"}},
    {"type": "node", "id": 4, "tags": {"addr:full": "Sector F Dha Phase 1, Lahore, Pakistan", "addr:city": "Lahore", "shop": "bakery"}},
    {"type": "node", "id": 5, "tags": {"addr:street": "Multan Road", "addr:city": "Multan"}},
    {"type": "node", "id": 6, "tags": {"addr:street": "03001234567", "addr:city": "Multan"}},
    {"type": "node", "id": 7, "tags": {"addr:housenumber": "9", "addr:city": "Multan"}},
    {"type": "node", "id": 8, "tags": {"addr:street": "A-103 Street, F-6/3", "addr:city": " "}},
    {"type": "node", "id": 9, "tags": {"addr:street": "f-8/3 Lane", "addr:city": "کراچی"}},
]


def test_address_corpus(spark, workdir):
    put(workdir, "a.json", json.dumps({"elements": ELEMENTS[:4]}).encode())
    put(workdir, "b.json", json.dumps({"elements": ELEMENTS[4:]}).encode())
    corpus = co.write_corpus(co.build_corpus(files.osm_elements(spark, workdir)), f"{workdir}/corpus")
    got = {r.address: r for r in corpus.collect()}
    assert set(got) == {
        "14, Hill Road, Islamabad",
        "Sector F Dha Phase 1, Lahore, Pakistan",
        "Multan Road, Multan",
        "A-103 Street, F-6/3",
        "f-8/3 Lane, Karachi",
    }
    assert got["14, Hill Road, Islamabad"].kind == "residential"
    assert got["14, Hill Road, Islamabad"].has_housenumber
    assert got["Sector F Dha Phase 1, Lahore, Pakistan"].kind == "commercial"
    assert got["Sector F Dha Phase 1, Lahore, Pakistan"].form == "block_phase"
    assert got["A-103 Street, F-6/3"].form == "sector_code"
    assert got["A-103 Street, F-6/3"].city == "(unknown)"
    assert got["f-8/3 Lane, Karachi"].form == "plot_number"
    assert got["Multan Road, Multan"].form == "plain_street"
    assert all(r.latin for r in got.values())
    assert not any("Bilal" in r.address for r in got.values())


def test_latin_only(spark):
    df = spark.createDataFrame([("17, Street 32",), ("17, اسٹریٹ 32",), ("Straße",)], "a string")
    assert [r[0] for r in df.select(adr.latin_only(F.col("a"))).collect()] == [True, False, True]


def test_label_counts_file(spark, workdir):
    labels = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    co.write_label_counts(labels, f"{workdir}/counts")
    rows = spark.read.option("header", True).csv(f"{workdir}/counts").collect()
    assert [(r["label"], r["count"]) for r in rows] == [("b", "2"), ("a", "1")]
