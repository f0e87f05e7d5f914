"""A Merkle manifest of a dataset: leaf digests, one tree per group, a tree over the groups, proofs.

A leaf is the digest of a row's fields. The leaves of a group ascend by key; while several nodes
remain, every `FAN` consecutive ones become the digest of their digests, and what remains is the
group's subroot. The subroots, ordered by group, make the root in the same way.

Nodes are cut into superblocks of FAN ** HEIGHT places, whole subtrees of the tree whatever its
size. Going up, a superblock becomes one node of a table that is smaller by that factor, and so
on until each tree is one node: a few rounds for any number of rows. Coming down, the nodes of a
superblock and the outer node above it, which carries the siblings on its own way to the root,
are cogrouped by superblock: one call reduces the subtree, joins the siblings inside it with
those outside, and folds each leaf up to a root. No task ever holds more than a superblock.

Texts are hashed where they are scanned; only digests and keys are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactstream.llm.store import drop, keep

FAN, HEIGHT = 8, 4
BLOCK = FAN**HEIGHT


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field_text(column: Column) -> Column:
    """A field inside a leaf: `-` for null, else its UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def levels_of(size: int) -> int:
    """Levels between that many nodes and the one that remains."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def layers(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes given and the levels above them."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Per level below the top, the digests left and right of the node on the way up from place i."""
    out = []
    for level in tree[:-1]:
        first = i // FAN * FAN
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + FAN])))
        i //= FAN
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def write_path(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a}|{b}" for a, b in path)


def read_path(text: str) -> list[tuple[str, str]]:
    return [tuple(step.split("|")) for step in text.split(";")] if text else []


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `place` (from 0) inside the group by the order, nulls first, and the group's `size`.

    Rows are dealt by range, so a group of any size is spread; rows that are equal are parted
    by where they stand. Counts per range and group give the first place of each.
    """
    key = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*key).sortWithinPartitions(*key).drop("_row")
    at = rows.columns.index(group)

    def number(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            seq = []
            for g in batch.column(at).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                seq.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(seq), pa.int32()), pa.array(seq, pa.int64())],
                [*batch.schema.names, "_part", "_seq"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # Written, so that a range keeps its number whatever is computed again.
    rows = keep(dealt.mapInArrow(number, f"{fields}, _part int, _seq long"), "ranks")
    ranges = rows.groupBy(group, "_part").agg((F.max("_seq") + 1).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col(group).alias("_group"),
        F.col("_part").alias("_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("size"),
    )
    joined = rows.join(ranges, (F.col("_part") == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")))
    place = (F.col("_base") + F.col("_seq")).alias("place")
    out = keep(joined.select(*[c for c in rows.columns if c not in ("_part", "_seq")], place, "size"), "places")
    drop(rows)
    return out


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK))


def inner_tree(frame) -> list[list[str]]:
    """The subtree of a superblock's nodes, which are sorted by place."""
    return layers(frame["node"].tolist(), min(HEIGHT, levels_of(int(frame["size"].iloc[0]))))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (tree, place, size, node) and the tables above them, to one node per tree."""

    def reduce(frame):
        frame = frame.sort_values("place")
        top = inner_tree(frame)[-1]
        assert len(top) == 1
        out = frame.iloc[:1][["tree"]].copy()
        out["place"], out["node"] = int(frame["place"].iloc[0]) // BLOCK, top[0]
        out["size"] = -(-int(frame["size"].iloc[0]) // BLOCK)
        return out

    tables = [nodes]
    while True:
        thin = in_blocks(tables[-1]).select("tree", "block", "place", "size", "node")
        up = thin.groupBy("tree", "block").applyInPandas(reduce, "tree string, place long, node string, size long")
        tables.append(keep(up, "nodes"))
        if (tables[-1].agg(F.max("size")).first()[0] or 0) <= 1:
            return tables


OUTER = "tree string, place long, node string, path string, subroot string, root string"


def descend(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Cogroup superblocks with the nodes above them: the nodes' whole paths.

    `outer` has a row (tree, place, path, subroot, root) for each superblock of `nodes`.
    """

    def join(frame, above):
        frame, above = frame.sort_values("place"), above.iloc[0]
        tree, outside = inner_tree(frame), above["path"]
        out = frame[["tree", "place", "node"]].copy()
        inside = [write_path(siblings(tree, i)) for i in range(len(frame))]
        out["path"] = [";".join(p for p in (x, outside) if p) for x in inside]
        out["subroot"], out["root"] = above["subroot"], above["root"]
        return out

    left = in_blocks(nodes).select("tree", "block", "place", "size", "node")
    return cogrouped(left, outer, join, OUTER)


def cogrouped(left: DataFrame, outer: DataFrame, function, schema: str) -> DataFrame:
    above = outer.select("tree", F.col("place").alias("block"), "path", "subroot", "root")
    return left.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(function, schema)


def merkle_manifest(
    docs: DataFrame,
    fields: list[str] = ["doc_id", "source", "lang", "n_chars", "text"],
    key: str = "doc_id",
    group: str = "lang",
    now: Column | None = None,
    with_path: bool = True,
) -> DataFrame:
    """Per row: key, tree (its group), place, leaf, path, proof_sha256, subroot, root, folded_root, verified.

    `path` holds the siblings, level by level up to the root, as `left|right` joined by `;`;
    `fold` gives the root from a leaf and its path. `proof_sha256` is the digest of all siblings
    in that order, of nothing where there are none. `now` gives the leaf as it is found now, null
    where it is unchanged: `folded_root` starts from it and `verified` tells whether the root
    still comes out. Without paths the column is null.

    Groups are ordered bytewise, null first; inside a group rows go by key, null first, then by
    leaf, so ties and repeated rows have a fixed place. Nulls are fields like others. A lone
    leaf is its own subroot, a lone subroot the root. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(group).cast("string").alias("tree"),
        F.col(key).cast("long").alias("key"),
        leaf_digest(*map(F.col, fields)).alias("node"),
        (F.lit(None) if now is None else now).cast("string").alias("now"),
    )
    leaves = ranked(rows, "tree", ["key", "node", "now"])
    inside = climb(leaves)
    subroots = inside[-1].select(F.lit("").alias("group"), F.col("tree").alias("name"), F.col("node"))
    top = ranked(subroots, "group", ["name"]).withColumnRenamed("group", "tree")
    over = climb(top)
    outer = over[-1].select("tree", "place", "node", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for table in reversed(over[:-1]):
        outer = descend(table, outer)
    named = top.select("place", "name").join(outer.select("place", "node", "path", "root"), "place")
    outer = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "node", "path", F.col("node").alias("subroot"), "root")
    outer = keep(outer, "outer")
    for table in reversed(inside[1:-1]):
        outer = descend(table, outer)

    def finish(frame, above):
        frame, above = frame.sort_values("place"), above.iloc[0]
        tree, outside, root = inner_tree(frame), read_path(above["path"]), above["root"]
        paths, proofs, folded = [], [], []
        for i, (leaf, now) in enumerate(zip(frame["node"], frame["now"])):
            path = siblings(tree, i) + outside
            paths.append(write_path(path) if with_path else None)
            proofs.append(digest("".join(a + b for a, b in path)))
            folded.append(fold(now or leaf, path))
        out = frame[["tree", "place", "key"]].copy()
        out["leaf"], out["path"], out["proof_sha256"] = frame["node"], paths, proofs
        out["subroot"], out["root"], out["folded_root"] = above["subroot"], root, folded
        out["verified"] = [f == root for f in folded]
        return out

    # Keys pass through pandas as text: a null among them would make floats of all.
    left = in_blocks(leaves).withColumn("key", F.col("key").cast("string"))
    found = cogrouped(
        left,
        outer,
        finish,
        "tree string, place long, key string, leaf string, path string, proof_sha256 string, "
        "subroot string, root string, folded_root string, verified boolean",
    )
    return found.withColumn("key", F.col("key").cast("long"))


A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tamper_check(docs: DataFrame, every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Rows whose unsigned crc32(doc_id as text) `every` divides are looked at again with the A-Z
    of their text lower-cased; a row without a doc_id is not.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    other = [F.translate(F.col(c), A_Z, a_z) if c == "text" else F.col(c) for c in fields]
    found = merkle_manifest(docs, fields, now=F.when(hit, leaf_digest(*other)), with_path=False)
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
