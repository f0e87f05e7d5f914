"""The Merkle manifest against a plain tree, over superblocks of several sizes, and odd rows."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from redactstream.llm import merkle
from redactstream.llm.queries import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, node string, _part int"
A_Z = str.maketrans(merkle.A_Z, merkle.a_z)


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The node that remains, and each node's siblings in order as (left, right) per level."""
    ways, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, members = [], []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j in range(len(run)):
                for i in at[k + j]:
                    ways[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h("".join(run)))
            members.append([i for part in at[k : k + 8] for i in part])
        nodes, at = up, members
    return nodes[0], ways


def plain_manifest(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        now = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            now = leaf_of(doc_id, source, lang, n_chars, text and text.translate(A_Z))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, now, doc_id))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: plain_tree([r[2] for r in sorted(groups[n])]) for n in names}
    root, tops = plain_tree([trees[n][0] for n in names])
    out = []
    for n, top in zip(names, tops):
        for (*_, leaf, now, doc_id), way in zip(sorted(groups[n]), trees[n][1]):
            path = way + top
            folded = now
            for a, b in path:
                folded = h(a + folded + b)
            out.append((doc_id, leaf, trees[n][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return out


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", 7, "y", 3) for r in rows], SCHEMA)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i * 7 - 20, f"Text {i} " + "Ab" * rng.randrange(5), rng.choice(langs), rng.choice(["s", None]), i) for i in range(n)]


@pytest.mark.parametrize("height, n, langs", [(1, 300, ["en", "de", None, "é", "z"]), (1, 90, [f"l{k}" for k in range(40)]), (2, 150, ["en"]), (4, 9, ["en", "fr"])])
def test_manifest_matches_a_plain_tree(spark, monkeypatch, height, n, langs):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 8**height)
    rows = rows_of(n, langs)
    got = sorted(map(tuple, merkle.tamper_check(frame(spark, rows)).collect()))
    assert got == sorted(plain_manifest(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_rows(spark):
    big = 2**60 + 1
    rows = [(None, "A", "en", None, None), (None, None, "en", None, None), (big, "long " * 200_000, None, "s", 1)]
    rows += [(5, "Same", "en", "s", 4)] * 3 + [(5, "Other", "en", "s", 5), (6, None, "en", "s", 0), (7, "", "", "", 0)]
    got = sorted(map(tuple, merkle.tamper_check(frame(spark, rows)).collect()), key=str)
    assert got == sorted(plain_manifest(rows), key=str)
    assert merkle.tamper_check(frame(spark, rows).limit(0)).collect() == []
    one = merkle.tamper_check(frame(spark, rows[-1:])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("")


def test_paths_fold_to_the_root_and_changes_show(spark):
    found = merkle.merkle_manifest(frame(spark, rows_of(40, ["en", "de"]))).collect()
    for r in found:
        path = merkle.read_path(r.path)
        assert merkle.fold(r.leaf, path) == r.root and merkle.fold(h("other"), path) != r.root and r.verified


def test_equal_rows_of_a_third_are_spread(spark):
    rows = [(1, "Copy", "en", "s", 4)] * 3000 + rows_of(20, ["en"])
    prepare(spark)
    found = merkle.ranked(frame(spark, rows).selectExpr("lang AS tree", "doc_id AS key"), "tree", ["key"]).collect()
    assert sorted(r.place for r in found) == list(range(3020)) and {r["size"] for r in found} == {3020}
