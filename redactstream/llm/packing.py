"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing places the longest piece first, each into the open sequence with the
least room that still holds it, and opens a sequence only when none does. Pieces of one
length are alike, so the packing is decided on the number of pieces per length: at most one
number per token of capacity, however large the corpus. A segment tree over the remaining
capacities finds the tightest open class in logarithmic time, and a whole run of equal pieces
is placed at once. The result is the packing that the piece-by-piece rule gives.

The plan says for each length which ranks go to which sequences. Pieces get their rank from
counts per (length, slot) and a number inside that group; a slot is a hash of the document, so
a frequent length is spread over `slots` groups. Text is read once; what moves is one narrow row
per piece.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactstream.llm.store import keep
from redactstream.llm.subwords import Subwords, default_tokenizer, text_slices

CAPACITY = 2048
END_ID = 0
SLOTS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: documents longer than the capacity are cut into full pieces and a rest.

    A null text counts as empty: one piece that holds the end id. Every row gives its own
    pieces, repeated rows and null ids too. `with_ids` adds the ids as an array column.
    """
    path = tokenizer or default_tokenizer()

    def run(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        sub = Subwords(path)
        for batch in batches:
            texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            known = np.array(batch.column(0).is_valid())
            for a, b in text_slices(texts):
                ids, at = sub.encode(texts[a:b])
                # The end id goes behind each document.
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                at = at + np.arange(len(at))
                raw = memoryview(ids.tobytes())
                n = np.diff(at)
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[of] - start, capacity)
                left = (at[:-1][of] + start).tolist()
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(left, length.tolist())]
                columns = [
                    pa.array(doc_ids[a:b][of], pa.int64(), mask=~known[a:b][of]),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    bounds = np.append(np.cumsum(length) - length, length.sum()).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<long>" if with_ids else "")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, schema)


class Tightest:
    """A segment tree over remaining capacities: the least open capacity of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def set(self, room: int, open_: bool) -> None:
        i = room + self.leaves
        self.count[i] = int(open_)
        while i > 1:
            i //= 2
            self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    def at_least(self, room: int) -> int | None:
        i = room + self.leaves
        if self.count[i]:
            return room
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces per sequence, offset) of the packing.

    From its first rank up to the next row's, pieces of that length fill sequences from the
    first on, so many in each, the first of them at the offset. Open sequences of equal room
    are kept as runs of numbers, so a step handles a whole run.
    """
    tree, runs, opened, rows = Tightest(capacity), {}, 0, []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not runs.get(room):
                runs[room] = []
                tree.set(room, True)
            runs[room].append((first, n))

    for length in sorted((x for x, c in counts.items() if c and x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                # Further pieces of this length go on into the sequence opened last.
                per = capacity // length
                first, n, room = opened, -(-left // per), capacity
                opened += n
            else:
                per = room // length
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            if full:
                rows.append((length, rank, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                add(room - per * length, first, full)
            if rest:
                rows.append((length, rank, first + full, rest, capacity - room))
                rank, left = rank + rest, 0
                add(room - rest * length, first + full, 1)
                full += 1
            add(room, first + full, n - full)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, slots: int = SLOTS) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces with doc_id, piece and length.

    Only the counts per length come to the driver, at most one row per token of capacity.
    The pieces should be a stored table: they are read twice. Empty in, empty out. Rows that
    are equal in every column are packed as separate pieces.
    """
    slot = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)).cast("int")
    rows = pieces.withColumn("_slot", slot)
    per_slot = rows.groupBy("length", "_slot").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in per_slot.groupBy("length").agg(F.sum("_n")).collect()}
    longest = max(counts, default=0)
    if longest > capacity:
        raise ValueError(f"a piece of {longest} tokens does not fit in {capacity}")
    by_length: dict[int, tuple[list, list]] = {}
    for length, rank, first, per, offset in plan(counts, capacity):
        ranks, steps = by_length.setdefault(length, ([], []))
        ranks.append(rank)
        steps.append((first, per, offset))

    before = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slot.select(
        "length", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("length", "_slot").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(base, ["length", "_slot"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))

    def place(frames) -> Iterator:
        for f in frames:
            sequence, offset = [], []
            for length, rank in zip(f["length"].tolist(), f["_rank"].tolist()):
                ranks, steps = by_length[length]
                k = bisect_right(ranks, rank) - 1
                first, per, at = steps[k]
                q, r = divmod(rank - ranks[k], per)
                sequence.append(first + q)
                offset.append(at + r * length)
            f["sequence_id"], f["offset"] = sequence, offset
            yield f.drop(columns="_rank")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def best_fit_packing(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None
) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(keep(tokenised_pieces(docs, capacity, end_id, tokenizer), "pieces"), capacity)
