"""The prefix trie against a plain one, over shards and merges of several sizes, and odd rows."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from redactstream.llm import prefix_trie as pt
from redactstream.llm.queries import prepare

SCHEMA = "conv_id long, turn long, role string, text string, shard int, key string, depth string"
ORDER = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, "k", "d") for r in rows], SCHEMA)


def said_digest(said):
    return sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            own.setdefault(c, []).append((turn is not None, turn or 0, said_digest(said), said))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(c / abs(c or 1)) * (abs(c) % 20), [])
        out[c] = tuple(base[:h]) + tuple(turns[h:])
    return out


def plain_trie(built):
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    rows = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == path)
        parent = min(nodes[path[:-1]]) if path else None
        rows.append((min(members), len(path), parent, len(members), len(kids), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return rows


def got(df):
    return sorted(tuple(r[c] for c in ORDER) for r in df.collect())


def random_rows(seed, convs=60, words=3, longest=6):
    rng = random.Random(seed)
    return [
        (c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "a b", "a\tb c"][: words + 2]))
        for c in rng.sample(range(-30, 200), convs)
        for t in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("seed, shard_turns, merge", [(1, 9, 2), (2, 25, 3), (3, 10**6, 64), (4, 3, 2)])
def test_trie_matches_a_plain_one(spark, monkeypatch, seed, shard_turns, merge):
    monkeypatch.setattr(pt, "MERGE", merge)
    rows = random_rows(seed)
    assert got(pt.prefix_trie(pt.grafted(frame(spark, rows)), shard_turns)) == sorted(plain_trie(rebuilt(rows)), key=lambda r: (r[0], r[1]))


def test_equal_conversations_of_a_third_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(pt, "MERGE", 2)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 800, 4) for t in range(3)] + random_rows(5, 30)
    sequences = pt.turn_sequences(frame(spark, rows))
    own = {r.conv_id: r.turns for r in sequences.collect()}
    assert len(own) > 200
    found = got(pt.prefix_trie(sequences, 40))
    plain = {}
    for c, turn, role, text in rows:
        plain.setdefault(c, []).append((turn is not None, turn or 0, said_digest((role or "", text or "")), (role or "", text or "")))
    built = {c: tuple(t[-1] for t in sorted(ts)) for c, ts in plain.items()}
    assert found == sorted(plain_trie(built), key=lambda r: (r[0], r[1]))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (20, None, None, None), (20, 0, "user", "long " * 300_000), (21, 1, "user", "x"), (21, 1, "user", "x")]
    rows += [(2**60, 0, "a:b", "c"), (2**60, 0, "a", ":bc")]
    assert got(pt.prefix_trie(pt.grafted(frame(spark, rows)))) == sorted(plain_trie(rebuilt(rows)), key=lambda r: (r[0], r[1]))
    assert pt.prefix_trie(pt.grafted(frame(spark, rows).limit(0))).collect() == []
    deep = [(c, t, "user", f"t{t}") for c in (1, 2) for t in range(3_000)]
    deep = pt.prefix_trie(pt.turn_sequences(frame(spark, deep)))
    assert deep.count() == 3_001 and deep.agg({"saved_tokens": "max"}).first()[0] == 3_000


def test_medians_balance_the_tree():
    tree = pt.TernaryTree()
    tree.insert_by_medians([[i] for i in range(1023)])

    def steps(t):
        k, n = tree.equal[0], 1
        while tree.turn[k] != t:
            k, n = (tree.low[k] if t < tree.turn[k] else tree.high[k]), n + 1
        return n

    assert max(map(steps, range(1023))) == 10
