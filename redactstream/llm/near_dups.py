"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

A document is the set of its distinct word shingles. Min-max hashing keeps the smallest and the
largest value of the set under each permutation, so half the permutations give a signature of
the same length, whose estimate is unbiased and varies less. Bands of `rows` values put sets
into buckets: with 7 rows and 36 bands two sets of similarity 0.85 miss each other once in a
million, and of similarity 0.5 meet once in four.

1. Equal sets are one class; the text of its smallest doc_id stands for it. Copies are never paired.
   Classes have numbers of their own, so unlike texts that share a doc_id stay apart.
2. Class representatives in one bucket are linked to the bucket's smallest; the connected
   parts of these links are candidate clusters. Nothing is paired yet.
3. The texts of a cluster are compared on their full shingle sets. A large cluster is cut into
   blocks, and each pair of blocks is one task, so no task grows with the cluster. Only a
   spanning forest of the links found leaves a task.
4. The connected parts of those links, and of the classes, are the answer.

Shingle hashes are made under a key that is drawn for each run, so no text can be written to pass
for another. Rows of a class find it by a join; the classes that hold more than a thousandth of all
rows, of which there are at most a thousand, are broadcast for it.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactstream.llm.components import connected_components
from redactstream.llm.store import keep
from redactstream.llm.subwords import text_slices
from redactstream.llm.words import Words, mix, shingle_hashes

WIDTH = 5
PERCENT = 85
ROWS, BANDS = 7, 36
SLICE = 1_000_000
BLOCK_DOCS, BLOCK_WORDS = 512, 1_000_000
CHUNK = 4096
#: A class with more than one part in so many of all rows is hot; there are at most so many.
HOT = 1000
SAME = ["n_shingles", "set_a", "set_b"]
MARKS = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"


class MinMax:
    """Signatures of shingle sets: minimum and maximum under each of `n` permutations."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def of(self, shingles):
        """Minimum and maximum of each permutation, side by side."""
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for k in range(0, len(h), CHUNK):
            x = self.a[:, None] * h[None, k : k + CHUNK] + self.b[:, None]
            lo, hi = x.min(axis=1), x.max(axis=1)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        return np.stack([low, high], axis=1).reshape(-1)


class BandKeys:
    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 11):
        if rows * bands % 2:
            raise ValueError("rows x bands must be even: each permutation gives two values")
        self.rows, self.bands = rows, bands
        rng = np.random.default_rng(seed)
        self.weights = rng.integers(0, 2**63, (bands, rows), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.int64).astype(np.uint64)

    def of(self, signature):
        values = signature.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        return mix((values * self.weights).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def distinct_sets(words: Words, texts: list, width: int) -> list:
    """The distinct shingle hashes of each text, sorted."""
    out = []
    for a, b in text_slices(texts, SLICE):
        h, at = words.split(texts[a:b])
        s, at = shingle_hashes(h, at, width)
        out += [np.unique(s[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def named_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text_key that tells apart the texts of one doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def signatures(
    docs: DataFrame, width: int = WIDTH, rows: int = ROWS, bands: int = BANDS, key: tuple[int, int] = (0, 0)
) -> DataFrame:
    """doc_id, text_key, n_shingles, set_a and set_b (which tell sets apart), and band keys, none for empty sets."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        words, minmax, keys = Words(key), MinMax(rows * bands // 2), BandKeys(rows, bands)
        for batch in batches:
            sets = distinct_sets(words, batch.column(1).to_pylist(), width)
            n = np.array([len(s) for s in sets], np.int64)
            a = np.array([np.bitwise_xor.reduce(s) for s in sets], np.uint64)
            b = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64)
            flat = [keys.of(minmax.of(s)) for s in sets if len(s)]
            flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            size = np.where(n > 0, bands, 0)
            at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.ListArray.from_arrays(at, pa.array(flat, pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"],
            )

    return named_texts(docs).mapInArrow(run, MARKS)


def similar(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def linked_pairs(sets: list, side: list, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the sets; of sets of two sides, only links across count.

    Shared shingles are counted exactly: pair by pair in small groups, otherwise as products
    of incidence matrices over the shingles that at least two sets have.
    """
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    if m <= 6:
        near = np.zeros((m, m), bool)
        for i in range(m):
            for j in range(i):
                if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]):
                    inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    near[i, j] = near[j, i] = similar(inter, n[i], n[j], percent)
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        row = np.repeat(np.arange(m), n)
        shared = count[column] > 1
        row, column = row[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        inter = np.zeros((m, m), np.float32)
        total = int(number[-1]) + 1 if len(number) else 0
        for k in range(0, total, CHUNK):
            i, j = np.searchsorted(column, (k, k + CHUNK))
            part = np.zeros((m, min(CHUNK, total - k)), np.float32)
            part[row[i:j], column[i:j] - k] = 1
            inter += part @ part.T
        near = similar(inter.astype(np.int64), n[:, None], n[None, :], percent)
        np.fill_diagonal(near, False)
    side = np.array(side)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    seen = np.zeros(m, bool)
    for root in range(m):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            new = np.flatnonzero(near[stack.pop()] & ~seen)
            seen[new] = True
            stack += new.tolist()
            for j in new.tolist():
                yield root, j


def confirmed_links(
    docs: DataFrame, clusters: DataFrame, width: int, percent: int, key: tuple[int, int] = (0, 0)
) -> DataFrame:
    """(a, b) links that join every two similar classes of a cluster, by class_id.

    `clusters` has class_id, cluster, n_shingles, and doc_id and text_key of a row with the class's text.
    Cluster sizes stay in tables; a cluster is cut into as many blocks as its classes and shingles ask for.
    """
    size = clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("w") / BLOCK_WORDS)).cast("int")
    cut = clusters.join(size.where("m > 1").select("cluster", blocks.alias("g")), "cluster")
    block = F.pmod(F.xxhash64("class_id"), "g").cast("int").alias("k")
    cut = cut.select("doc_id", "text_key", "class_id", "cluster", "g", block)
    # Neither side has a size bound, so neither is broadcast at any scale. A row that stands in the
    # table twice is compared once.
    face = ["doc_id", "text_key"]
    texts = named_texts(docs).join(cut.hint("merge"), face).dropDuplicates(face)
    # Block k meets every block: once as first, once as second, and itself.
    tasks = texts.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "cluster",
        F.least("k", "j").alias("i"),
        F.greatest("k", "j").alias("j"),
        (F.col("k") > F.col("j")).alias("second"),
        "class_id",
        "text",
    )
    dealt = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches) -> Iterator:
        import pyarrow as pa

        words = Words(key)

        def links(group):
            rows = {d: (t, s) for d, t, s in group}
            ids = sorted(rows)
            sets = distinct_sets(words, [rows[d][0] for d in ids], width)
            return [(ids[y], ids[x]) for x, y in linked_pairs(sets, [rows[d][1] for d in ids], percent)]

        def out(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        task, group, found = None, [], []
        for batch in batches:
            for c, i, j, second, d, t in zip(*(batch.column(x).to_pylist() for x in range(6))):
                if (c, i, j) != task:
                    found += links(group)
                    task, group = (c, i, j), []
                group.append((d, t, second))
            if len(found) > 10_000:
                yield out(found)
                found = []
        yield out(found + links(group))

    return dealt.mapInArrow(run, "a long, b long")


def groups(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    rows: int = ROWS,
    bands: int = BANDS,
    key: tuple[int, int] | None = None,
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, face_key: the group of each row, and the text that stands for it.

    A group is its component_id, the smallest doc_id in it, with its face_key, the smallest text_key
    among the texts of that doc_id in the group.
    """
    key = key or (secrets.randbits(64), secrets.randbits(64))
    marks = keep(signatures(docs, width, rows, bands, key), "marks")
    whole = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    counted = whole.groupBy(*SAME).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"))
    # Numbers are given once, in a stored table.
    numbered = keep(counted.withColumn("class_id", F.monotonically_increasing_id()), "numbers")
    faces = keep(
        whole.join(numbered.hint("merge"), ["doc_id", *SAME]).select(
            "class_id", "n_rows", "doc_id", "text_key", *SAME, "bands"
        ),
        "faces",
    )
    classes = faces.groupBy("class_id", "n_rows", "doc_id", *SAME).agg(F.min("text_key").alias("text_key"))
    # Where rows repeat, a class enters a bucket more than once, which links nothing to itself.
    entry = faces.select(F.explode("bands").alias("key"), "class_id")
    first = entry.groupBy("key").agg(F.min("class_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    star = entry.join(first.select("key", "first"), "key").where("class_id <> first")
    parts = with_names(connected_components(star.select(F.col("class_id").alias("a"), F.col("first").alias("b"))))
    sized = parts.withColumnRenamed("component", "cluster").join(
        classes.select("class_id", "n_shingles", "doc_id", "text_key"), "class_id"
    )
    links = confirmed_links(docs, keep(sized, "clusters"), width, percent, key)
    found = with_names(connected_components(links))
    linked = found.join(classes.select("class_id", "doc_id", "text_key"), "class_id")
    least = linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    least = found.join(least, "component").select("class_id", "least")
    face = F.coalesce("least", F.struct("doc_id", "text_key"))
    settled = keep(
        classes.join(least, "class_id", "left").select(
            *SAME, "n_rows", face["doc_id"].alias("component_id"), face["text_key"].alias("face_key")
        ),
        "classes",
    )
    total = settled.agg(F.sum("n_rows")).scalar()
    named = settled.withColumn("hot", F.col("n_rows") * HOT > total)
    hot = F.broadcast(named.where("hot").drop("hot", "n_rows"))
    rest = named.where("NOT hot").drop("hot", "n_rows")
    member = whole.select("doc_id", "text_key", *SAME)
    columns = ["doc_id", "text_key", "n_shingles", "component_id", "face_key"]
    alone = marks.where("n_shingles = 0 OR doc_id IS NULL").select(
        *columns[:3], F.col("doc_id").alias("component_id"), F.col("text_key").alias("face_key")
    )
    return (
        member.join(hot, SAME).select(*columns)
        .unionAll(member.join(hot, SAME, "left_anti").join(rest, SAME).select(*columns))
        .unionAll(alone)
    )


def with_names(parts: DataFrame) -> DataFrame:
    """class_id and component of every vertex: a component's smallest names it and belongs to it."""
    return parts.select(F.col("id").alias("class_id"), "component").unionAll(
        parts.select(F.col("component").alias("class_id"), "component").distinct()
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Options are those of `groups`. Words are runs of characters other than ASCII white space, A-Z
    lower-cased; a text of fewer words than a shingle is one shingle; a null text or one without words is
    an empty set and linked with nothing. Sets are compared by 64-bit shingle hashes under a key that is
    drawn for the run unless `key` is given. A row without a doc_id is linked with nothing, has no
    component and is kept. Rows that repeat a doc_id each come back; unlike texts of one doc_id are not
    linked by it. An empty table gives no rows.
    """
    out = groups(docs, **options).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stand for their group; all columns, one row for each group.

    Rows without a doc_id all stay. Unlike texts of one doc_id are groups of their own, and each
    stays where it stands for its group; of rows with one doc_id and text an arbitrary one stays.
    """
    face = ["doc_id", "text_key"]
    kept = groups(docs, **options).where("doc_id = component_id AND text_key = face_key").select(*face).distinct()
    text_key = F.xxhash64(F.col("text").cast("string")).alias("text_key")
    named = docs.where("doc_id IS NOT NULL").select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key
    )
    chosen = named.join(kept, face, "left_semi").dropDuplicates(face)
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    return chosen.select(*columns).unionByName(docs.where("doc_id IS NULL"))
