"""The prefix trie of all conversations, by ternary search trees over range shards.

Conversations are sequences of turn digests. They are dealt by range over (sequence, conv_id), so
all that share a prefix stand next to each other, and many equal ones still spread over shards.

1. A shard numbers its distinct turns in digest order and inserts its distinct sequences into a
   ternary search tree, the median first and then the medians of both halves, which keeps the
   trees of siblings balanced. A walk with a stack of its own, parents first, read backwards adds
   up members, leaves and savings.
2. Only prefixes of a shard's first and last sequence can go on in other shards. These boundary
   nodes leave the shard with what they know; all others are done.
3. Boundary nodes of `MERGE` neighbouring shards are merged by their prefix digest; those on the
   outer edges of the neighbours stay open, and so on until one group is left. Each round keeps
   two paths a group.
4. A done node under a boundary node gets its parent's smallest member by a join on the shard and
   the parent; the members that end in a boundary node are hashed as a stream of id chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactstream.llm.store import keep

SHARD_TURNS = 100_000
MERGE = 64
WORD = r"[^\x20\x09-\x0D]+"
ROOT = b""

NODE = (
    "done boolean, shard int, key binary, parent_key binary, parent_conv_id long, depth long, conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, on_left boolean, on_right boolean, "
    "ends string"
)
FIELDS = [f.split()[0] for f in NODE.split(", ")]


def turn_sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: an array of (turn, digest, words).

    Turns go by number, null first; turns of one number by the digest of role and text, so ties
    and repeated rows have a fixed place. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation and take no part. The digests of one conversation must fit in a
    task, at some 50 bytes a turn.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def grafted(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Sequences whose first turns come from the family's first conversation.

    Conversation c starts with the first h turns of conversation c - c % family (all if there are
    fewer, none if it is absent), h = crc32(c as text) % most; its own turns follow after its first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    # Dealt by family once: the grouping and the join keep that.
    own = turn_sequences(turns.where("conv_id IS NOT NULL").repartition(base)).withColumn("base", base)
    heads = turn_sequences(turns.where(F.col("conv_id") % family == 0))
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class TernaryTree:
    """A trie whose children of a node form a binary search tree over turn numbers."""

    def __init__(self):
        self.turn, self.low, self.high, self.equal, self.up = [-1], [-1], [-1], [-1], [-1]

    def _new(self, turn: int, up: int) -> int:
        self.turn.append(turn)
        self.up.append(up)
        for links in (self.low, self.high, self.equal):
            links.append(-1)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node of the sequence, made where it is not there yet."""
        turn, low, high, equal, at = self.turn, self.low, self.high, self.equal, 0
        for t in sequence:
            k, links, last = equal[at], equal, at
            while k >= 0 and turn[k] != t:
                links, last = (low if t < turn[k] else high), k
                k = links[k]
            if k < 0:
                k = links[last] = self._new(t, at)
            at = k
        return at

    def insert_by_medians(self, sequences: list[list[int]]) -> list[int]:
        """Insert sorted sequences, medians first; their nodes."""
        nodes, todo = [0] * len(sequences), [(0, len(sequences))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                nodes[m] = self.insert(sequences[m])
                todo += [(m + 1, b), (a, m)]
        return nodes

    def walk(self) -> list[int]:
        """All nodes, each after its parent."""
        out, todo = [], [0]
        while todo:
            k = todo.pop()
            out.append(k)
            if self.equal[k] >= 0:
                todo.append(self.equal[k])
            if k:
                todo += [j for j in (self.high[k], self.low[k]) if j >= 0]
        return out

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.up[node]
        return out[::-1]


def ids_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def shard_nodes(shard: int, ids: list[int], turns: list[list], words: list[list]) -> Iterator[tuple]:
    """The trie nodes of sorted sequences, as rows of NODE."""
    known = {d: w for t, n in zip(turns, words) for d, w in zip(t, n)}
    digests = sorted(known)
    number = {d: i for i, d in enumerate(digests)}
    distinct, ends = [], []
    for conv_id, t in zip(ids, turns):
        t = [number[d] for d in t]
        if not distinct or distinct[-1] != t:
            distinct.append(t)
            ends.append([])
        ends[-1].append(conv_id)
    tree = TernaryTree()
    nodes = tree.insert_by_medians(distinct)
    ending = dict(zip(nodes, ends))
    left, right = tree.path(nodes[0]), tree.path(nodes[-1])
    on_left, on_right = set(left), set(right)
    open_ = on_left | on_right
    keys = {0: ROOT}
    for path in (left, right):
        for a, b in zip(path, path[1:]):
            keys[b] = hashlib.sha256(keys[a] + digests[tree.turn[b]]).digest()

    size = len(tree.turn)
    members, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    depth, order = [0] * size, tree.walk()
    for k in order[1:]:
        depth[k] = depth[tree.up[k]] + 1
    for k in reversed(order):
        own = ending.get(k)
        if own:
            members[k] += len(own)
            # Ids ascend among equal sequences.
            least[k] = own[0] if least[k] is None else min(own[0], least[k])
        if k not in open_:
            leaves[k] = leaves[k] or 1
            saved[k] += (members[k] - 1) * known[digests[tree.turn[k]]]
        if k:
            up = tree.up[k]
            members[up] += members[k]
            least[up] = least[k] if least[up] is None else min(least[up], least[k])
            if k not in open_:
                children[up] += 1
                leaves[up] += leaves[k]
                saved[up] += saved[k]
    for k in order:
        up, said = tree.up[k], ids_text(ending.get(k, []))
        is_open = k in open_
        yield (
            not is_open,
            shard,
            keys[k] if is_open else None,
            keys[up] if k and up in open_ else None,
            least[up] if k and up not in open_ else None,
            depth[k],
            least[k],
            members[k],
            children[k],
            leaves[k],
            saved[k],
            known[digests[tree.turn[k]]] if k else 0,
            k in on_left,
            k in on_right,
            said if is_open else hashlib.sha256(said.encode()).hexdigest(),
        )


def merge_nodes(group: int, rows: list[dict], last: bool) -> Iterator[tuple]:
    """Boundary nodes of neighbouring shards as one: done ones, and those still open at the edges."""
    first_shard, last_shard = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    merged: dict[bytes, dict] = {}
    for r in rows:
        m = merged.get(r["key"])
        if m is None:
            m = merged[r["key"]] = {**r, "on_left": False, "on_right": False}
        else:
            m["conv_id"] = min(m["conv_id"], r["conv_id"])
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                m[c] += r[c]
        m["on_left"] |= r["on_left"] and r["shard"] == first_shard
        m["on_right"] |= r["on_right"] and r["shard"] == last_shard
    for m in sorted(merged.values(), key=lambda m: -m["depth"]):
        m["shard"], m["done"] = group, last or not (m["on_left"] or m["on_right"])
        if m["done"]:
            m["n_leaves"] = m["n_leaves"] or 1
            m["saved_tokens"] += (m["n_convs"] - 1) * m["words"]
            if m["depth"]:
                up = merged[m["parent_key"]]
                up["n_children"] += 1
                up["n_leaves"] += m["n_leaves"]
                up["saved_tokens"] += m["saved_tokens"]
    for m in merged.values():
        yield tuple(m[f] for f in FIELDS)


def record_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in NODE.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], FIELDS)


def sharded(sequences: DataFrame, shard_turns: int) -> tuple[DataFrame, int]:
    """The nodes of all shards, stored, and how many shards there are."""
    total = sequences.agg(F.count("*"), F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()
    shards = max(1, -(-(total[0] + total[1]) // shard_turns))
    key = ["digests", "conv_id"]
    dealt = sequences.repartitionByRange(shards, *key).sortWithinPartitions(*key)

    def run(batches) -> Iterator:
        from pyspark import TaskContext

        ids, turns, words = [], [], []
        for batch in batches:
            for held, column in zip((ids, turns, words), batch.columns):
                held += column.to_pylist()
        rows = []
        for row in shard_nodes(TaskContext.get().partitionId(), ids, turns, words) if ids else ():
            rows.append(row)
            if len(rows) == 10_000:
                yield record_batch(rows)
                rows = []
        yield record_batch(rows)

    return keep(dealt.select("conv_id", "digests", "words").mapInArrow(run, NODE), "trie"), shards


def merge_round(open_: DataFrame, last: bool) -> DataFrame:
    def run(table):
        import pyarrow as pa

        rows = table.to_pylist()
        return pa.Table.from_batches([record_batch(list(merge_nodes(rows[0]["shard"] // MERGE, rows, last)))])

    return open_.groupBy(F.floor(F.col("shard") / MERGE).alias("group")).applyInArrow(run, NODE)


def hashed_ends(chunks: DataFrame) -> DataFrame:
    """key and the digest of its id chunks in shard order, joined by commas; one chunk in memory at a time."""
    dealt = chunks.repartition("key").sortWithinPartitions("key", "shard")

    def run(batches) -> Iterator:
        import pyarrow as pa

        def row(key, sha):
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends"])

        last, sha = None, None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != last:
                    if sha:
                        yield row(last, sha)
                    last, sha = key, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if sha:
            yield row(last, sha)

    return dealt.select("key", "shard", "ends").mapInArrow(run, "key binary, ends string")


NOTHING = hashlib.sha256(b"").hexdigest()


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie over conv_id and `turns`, an array of (turn, digest, words): one row per node.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (words that one copy of each shared turn in the subtree saves) and
    ends_sha256 (of the ascending conv_ids that end there). A conversation without turns ends in
    the root. conv_ids are taken to be unique, as `turn_sequences` leaves them. No conversations,
    no nodes. One conversation must fit in a task, as must the ends of one shard.
    """
    rows = sequences.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.transform("turns", lambda t: t["digest"]).alias("digests"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    found, groups = sharded(keep(rows, "sequences"), shard_turns)
    open_ = found.where("NOT done")
    places = open_.select("shard", "key")
    ends = hashed_ends(open_.where("ends <> ''").select("key", "shard", "ends"))
    now, merged = open_.withColumn("ends", F.lit("")), []
    while True:
        last = groups <= MERGE
        now = keep(merge_round(now, last), "merge")
        merged.append(now.where("done"))
        if last:
            break
        now, groups = now.where("NOT done"), -(-groups // MERGE)
    bounds = merged[0]
    for part in merged[1:]:
        bounds = bounds.unionAll(part)
    bounds = keep(bounds.drop("ends").join(ends, "key", "left"), "bounds")
    least = bounds.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    by_key = bounds.drop("parent_conv_id").join(least, "parent_key", "left").withColumnRenamed("_parent", "parent_conv_id")
    # What a shard has under boundary nodes is no more than the shard itself, so no key is hot.
    per_shard = places.join(least, F.col("key") == F.col("parent_key")).select("shard", "parent_key", "_parent")
    inner = found.where("done")
    under = inner.where("parent_key IS NOT NULL").join(per_shard, ["shard", "parent_key"])
    out = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    ]
    return (
        inner.where("parent_key IS NULL").select(*out)
        .unionAll(under.withColumn("parent_conv_id", F.col("_parent")).select(*out))
        .unionAll(by_key.select(*out))
    )
