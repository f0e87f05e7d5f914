"""Repeated passages removed, by super-k-mers: windows counted where their minimisers meet.

A window is `width` consecutive words. Its minimiser is the least hash among its runs of `seed`
words; consecutive windows with one minimiser travel as one string, the super-k-mer, to the
bucket of that minimiser. Equal windows have equal minimisers, so a bucket sees every start of
its windows, and sorting them there counts them exactly, on their words and not on hashes.

- Equal super-k-mers are one string with several places, so exact copies are never spread out
  into windows. A minimiser seen once, at one place, needs no counting at all.
- A minimiser with more than `HOT` windows is dealt to several buckets. Each counts on its own;
  what is single in a bucket goes on by the window's SHA-256 and is counted once more, where a
  window has at most one row a bucket. The same is done for a bucket beyond `HOT` in one task,
  part by part, so a task holds a bounded number of windows.
- Only places of repeated windows go back to the documents.

Hashes choose minimisers and buckets only; a collision there costs time, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactstream.llm.store import keep
from redactstream.llm.subwords import text_slices
from redactstream.llm.words import PLACES, SPACE, Powers, mix

WIDTH, SEED = 35, 5
HOT = 200_000
# At most so many minimisers are known as hot to every task.
HOT_KEYS = 20_000
SLICE = 2_000_000
LONGEST = 2_048
U = np.uint64
PLACE_BITS = U(30)


def word_bounds(texts: list, powers: Powers):
    """Bytes of the texts with words parted by single spaces, word hashes, and where words and texts begin.

    Words are [begin, end) in the bytes; text i has the words at[i] to at[i + 1].
    """
    raw = [t.encode() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.cumsum([0] + [len(b) + 1 for b in raw])
    gap = SPACE[data]
    before = np.concatenate([[True], gap[:-1]])
    begin, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    hashes = mix(powers.spans(data, begin, end))
    at = np.searchsorted(begin, edge)
    # The first gap byte behind a word stays, as a space; other gap bytes go.
    kept = ~gap | (gap & ~before)
    place = np.cumsum(kept) - 1
    text = np.where(gap, np.uint8(32), data)[kept].tobytes()
    size = end - begin
    begin = place[begin]
    return text, hashes, begin, begin + size, at


def super_kmers(hashes, at, width: int = WIDTH, seed: int = SEED):
    """Arrays (text, minimiser, first window, last window, repeats): runs of windows with one minimiser.

    `repeats` tells that the minimiser stands at several places in the run, so the run may hold
    a window twice. Runs are cut at LONGEST windows.
    """
    n = len(hashes) - seed + 1
    windows = len(hashes) - width + 1
    if windows < 1:
        return [np.zeros(0, np.int64)] * 5
    run = np.zeros(n, U)
    for j in range(seed):
        run += hashes[j : j + n] * PLACES[j]
    run = mix(run)
    # The upper bits order runs, the lower say where: the leftmost of the least wins. The same
    # bits in every batch, so that equal windows choose alike.
    best = (run >> PLACE_BITS << PLACE_BITS) | np.arange(n, dtype=U)
    span, reach = width - seed + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    place = (best & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
    key = run[place]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.arange(windows)
    whole = text[:windows] == text[width - 1 :]
    first, place, key, text = first[whole], place[whole], key[whole], text[:windows][whole]
    if not len(first):
        return [np.zeros(0, np.int64)] * 5
    new = np.ones(len(first), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    inside = np.arange(len(first)) - np.repeat(start, np.diff(np.append(start, len(first))))
    new |= inside % LONGEST == 0
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(first)) - 1
    moved = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
    return text[start], key[start].view(np.int64), first[start], first[stop], moved[stop] > moved[start]


def minimiser_windows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Windows per minimiser, summed within each task's batches."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_slices(texts, SLICE):
                _, hashes, _, _, at = word_bounds(texts[a:b], powers)
                _, name, first, last, _ = super_kmers(hashes, at, width, seed)
                name, which = np.unique(name, return_inverse=True)
                n = np.bincount(which, weights=last - first + 1, minlength=len(name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], ["minimiser", "n"])

    return docs.select("text").mapInArrow(run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))


PIECE = "minimiser long, row_key binary, first int, repeats boolean, words binary"


def pieces(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Every super-k-mer with its document's row_key and the number of its first window."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_slices(texts, SLICE):
                data, hashes, begin, end, at = word_bounds(texts[a:b], powers)
                text, name, first, last, repeats = super_kmers(hashes, at, width, seed)
                if not len(text):
                    continue
                cut = zip(begin[first].tolist(), end[last + width - 1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name),
                        keys.take(pa.array(text + a)),
                        pa.array((first - at[text]).astype(np.int32)),
                        pa.array(repeats),
                        pa.array([data[i:j] for i, j in cut], pa.binary()),
                    ],
                    ["minimiser", "row_key", "first", "repeats", "words"],
                )

    return docs.select("row_key", "text").mapInArrow(run, PIECE)


def windows_of(words: bytes, width: int) -> list[bytes]:
    """All windows of a super-k-mer."""
    edge = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    begin = [0, *[k + 1 for k in edge]]
    edge.append(len(words))
    return [words[i:j] for i, j in zip(begin, edge[width - 1 :])]


def runs_of(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    first = last = None
    for n in numbers:
        if last is not None and n == last + 1:
            last = n
            continue
        if first is not None:
            yield first, last
        first = last = n
    if first is not None:
        yield first, last


def count_windows(members: list[tuple], width: int, split: bool) -> Iterator[tuple]:
    """Repeated windows among super-k-mers (row_key, first, repeats, words) of one minimiser.

    Rows (row_key, first, last, None) for runs of repeated windows. When the minimiser is split,
    also one row per distinct window with its digest: (row_key, window, window, digest) of a
    single one, whose verdict is open, and (None, None, None, digest) for one known to repeat.
    """
    places: dict[bytes, list] = {}
    repeating = False
    for row_key, first, repeats, words in members:
        places.setdefault(words, []).append((row_key, first))
        repeating |= repeats
    if len(places) == 1 and not split and not repeating:
        ((words, at),) = places.items()
        if len(at) > 1:
            last = words.count(b" ") - width + 1
            for row_key, first in at:
                yield row_key, first, first + last, None
        return
    owner, number, windows = [], [], []
    strings = list(places)
    for k, words in enumerate(strings):
        own = windows_of(words, width)
        windows += own
        owner += [k] * len(own)
        number += range(len(own))
    order = sorted(range(len(windows)), key=windows.__getitem__)
    copies = [len(places[s]) for s in strings]
    repeated: list[list[int]] = [[] for _ in strings]
    i = 0
    while i < len(order):
        j, n = i, 0
        window = windows[order[i]]
        while j < len(order) and windows[order[j]] == window:
            n += copies[owner[order[j]]]
            j += 1
        if n > 1:
            for k in order[i:j]:
                repeated[owner[k]].append(number[k])
        if split:
            sha = hashlib.sha256(window).digest()
            if n > 1:
                yield None, None, None, sha
            else:
                ((row_key, first),) = places[strings[owner[order[i]]]]
                yield row_key, first + number[order[i]], first + number[order[i]], sha
        i = j
    for s, numbers in zip(strings, repeated):
        for a, b in runs_of(sorted(numbers)):
            for row_key, first in places[s]:
                yield row_key, first + a, first + b, None


FOUND = "row_key binary, first int, last int, digest binary"


def repeated_windows(docs: DataFrame, width: int, seed: int, hot: int) -> DataFrame:
    """(row_key, first, last): runs of windows that start elsewhere too. `docs` has row_key and text."""
    counted = keep(minimiser_windows(docs, width, seed).where(F.col("n") > hot), "minimisers")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # No more than HOT_KEYS minimisers can have this many windows, so the table is small by
    # construction; the others' share of one task is below 1 / HOT_KEYS of all.
    least = max(hot, total[0] // HOT_KEYS)
    shares = counted.where(F.col("n") > least).select("minimiser", F.ceil(F.col("n") / least).cast("int").alias("shares"))
    made = pieces(docs, width, seed).join(F.broadcast(shares), "minimiser", "left")
    bucket = F.pmod(F.xxhash64("row_key", "first"), F.col("shares"))
    bucket = F.when(F.col("shares").isNull(), -1).otherwise(bucket).cast("int")
    dealt = made.withColumn("bucket", bucket).drop("shares")
    dealt = dealt.repartition("minimiser", "bucket").sortWithinPartitions("minimiser", "bucket")

    def run(batches) -> Iterator:
        import pyarrow as pa

        def record(rows):
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row_key", "first", "last", "digest"])

        last, group, held, split, found = None, [], 0, False, []
        for batch in batches:
            for name, row_key, first, repeats, words, bucket in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, bucket) != last:
                    if len(group) > 1 or split or (group and group[0][2]):
                        found += count_windows(group, width, split)
                    last, group, held, split = (name, bucket), [], 0, bucket >= 0
                elif held > hot:
                    # More than a task should hold: counted in parts, like a split minimiser.
                    split = True
                    found += count_windows(group, width, split)
                    group, held = [], 0
                group.append((row_key, first, repeats, words))
                held += words.count(b" ") - width + 2
            if len(found) > 20_000:
                yield record(found)
                found = []
        if group:
            found += count_windows(group, width, split)
        yield record(found)

    found = keep(dealt.mapInArrow(run, FOUND), "windows")
    # A window has at most one row for each bucket or part of its minimiser.
    again = found.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.collect_list(
        F.when(F.col("row_key").isNotNull(), F.struct("row_key", "first", "last"))
    ).alias("at"))
    again = again.where("n > 1").select(F.explode("at").alias("at")).select("at.*")
    return found.where("digest IS NULL").select("row_key", "first", "last").unionAll(again)


def without_repeats(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot: int = HOT
) -> DataFrame:
    """doc_id, n_words, n_removed, `kept` (the words left, joined by one space) and `spans` of removed words.

    Words are runs of characters other than ASCII white space, as they are. Every word in a
    window of `width` words whose sequence also starts anywhere else goes, the first copy
    included; windows are judged on the input. Null and empty texts have no words, texts of
    fewer than `width` words no window. Rows that repeat, also those that repeat a doc_id, are
    texts of their own; a null doc_id stays null. An empty table gives no rows. One text must
    fit in a task.
    """
    if not 0 < seed <= min(width, len(PLACES)):
        raise ValueError(f"seed must be 1 to {min(width, len(PLACES))}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # Names a row by what it is, in 128 bits of its SHA-256; equal rows share their places.
    row_key = F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text), 256)
    row_key = F.unhex(F.substring(row_key, 1, 32))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key.alias("row_key"))
    runs = repeated_windows(rows, width, seed, hot)
    at = runs.groupBy("row_key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = rows.join(at, "row_key", "left").select("doc_id", "text", "runs")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                spans: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"] + width) for r in runs or ()):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last)
                    else:
                        spans.append([first, last])
                kept, done = [], 0
                for first, last in spans:
                    kept += words[done:first]
                    done = last
                kept += words[done:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<array<int>>")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: the kept words as a digest."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
