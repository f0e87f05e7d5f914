"""The loss mask is what the digest reads; the cover tree prunes what lies in clusters."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactstream.llm import chat, exact_search
from redactstream.llm.queries import PROBE, prepare

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", PROBE), (1, 2, "user", "é"), (1, 3, "assistant", "a<|nl|>b"),
    (2, 0, "assistant", ""), (3, None, None, None), (None, 1, "assistant", "x"),
]


@pytest.fixture()
def formatted(spark):
    prepare(spark)
    return chat.format_conversations(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))


def test_digest_is_the_text_under_the_mask(formatted):
    got = {r.conv_id: r for r in chat.chat_digest(formatted).collect()}
    said = PROBE + "a<|nl|>b"
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2].loss_chars == got[3].loss_chars == 0 and got[None].loss_chars == 1


def shifted(by_before, by_under, by_after):
    return F.transform(
        "runs",
        lambda r: F.struct(
            (r["before"] + by_before).alias("before"), (r["under"] + by_under).alias("under"), (r["after"] + by_after).alias("after")
        ),
    )


def test_a_shifted_mask_changes_the_digest_and_a_wrong_one_ends_the_job(formatted):
    good = {r.conv_id: r.loss_sha256 for r in chat.chat_digest(formatted).collect()}
    bad = formatted.where("conv_id = 1").withColumn("runs", shifted(-1, 0, 1))
    assert chat.chat_digest(bad).first().loss_sha256 != good[1]
    for wrong in (shifted(0, 1, 0), F.slice("runs", 1, 1)):
        with pytest.raises(Exception, match="conversation not recovered: 1"):
            chat.chat_digest(formatted.where("conv_id = 1").withColumn("runs", wrong)).collect()
    lost = formatted.where("conv_id = 1").withColumn("formatted", F.replace("formatted", F.lit("hi"), F.lit("ho")))
    with pytest.raises(Exception, match="conversation not recovered: 1"):
        chat.chat_digest(lost).collect()


def scored_share(x, monkeypatch):
    seen = []
    add = exact_search.Best.add

    def counted(self, q, scores, ids):
        seen.append(scores.size)
        add(self, q, scores, ids)

    monkeypatch.setattr(exact_search.Best, "add", counted)
    ids = np.arange(len(x))
    best = exact_search.dual_search(x[::50], ids[::50], np.full(len(x[::50]), -np.inf), x, ids)
    product = x[::50] @ x.T
    product[np.arange(len(x[::50])), ids[::50]] = -np.inf
    assert np.array_equal(best.score, -np.sort(-product, axis=1)[:, :5])
    return sum(seen) / product.size


def test_clustered_vectors_score_a_part_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(80, 32)) * 100
    x = np.floor(np.repeat(centers, 50, axis=0) + rng.normal(size=(4000, 32)) * 2)[rng.permutation(4000)]
    assert scored_share(x, monkeypatch) < 0.5
    assert scored_share(np.floor(rng.normal(size=(1000, 32)) * 50), monkeypatch) <= 1.0


def test_tree_covers_its_points_and_centers_stand_apart():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(700, 4)) * 30)
    groups = exact_search.near_groups(x, np.arange(700), 25.0)
    assert sorted(np.concatenate([g for _, g in groups]).tolist()) == list(range(700))
    centers = np.stack([c for c, _ in groups])
    gaps = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + np.eye(len(centers)) * 99
    assert gaps.min() > 25 and all(np.sqrt(((x[g] - c) ** 2).sum(axis=1)).max() <= 25 for c, g in groups)
    todo = [exact_search.cover_tree(x)]
    while todo:
        node = todo.pop()
        assert np.sqrt(((x[node.points] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
            todo += node.children


def test_empty_vectors_do_not_stop_the_search(spark):
    prepare(spark)
    rows = [(0, []), (1, []), (2, [1.0]), (50, [2.0]), (100, None)]
    got = exact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 0), (50, 1, 2, 512 * 256)]
