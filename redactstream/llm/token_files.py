"""Token id files: patched frame-of-reference blocks with an index of block starts.

File (all numbers little-endian): magic `PFOR0001`; uint32 block length, uint32 number of
documents, uint64 number of ids, uint32 number of blocks; int64 document ids and uint8
known-flags; uint32 ids per document; uint64 start of each block from the file's start; the
blocks. Block: uint32 minimum, uint8 width, uint16 number of exceptions, the values less the
minimum packed at that width in 64-bit words (low bits only for exceptions), then uint16
places and uint32 values of the exceptions. The width holds the given percentile of the
block's values; the others are its exceptions. The last block is filled up with its minimum.
Any block can be read alone through the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactstream.llm.store import fresh_folder, keep, open_store, read_file, write_file
from redactstream.llm.subwords import SLICE_CHARS, Subwords, default_tokenizer, text_slices

MAGIC = b"PFOR0001"
BLOCK = 1024
PERCENTILE = 0.9
SHARD_IDS = 4_000_000
END_ID = 2

HEAD = np.dtype([("block", "<u4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])
BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
MANIFEST = "part int, shard int, path string, n_docs long, n_ids long, n_bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_length(x):
    """Bits of non-negative numbers below 2**52."""
    return np.frexp(np.asarray(x, np.float64))[1]


def pack_bits(values, width: int):
    """Rows of values as 64-bit words, `width` bits a value; a row is a multiple of 64 values."""
    n, k = values.shape
    lanes = values.reshape(n, k // 64, 64)
    out = np.zeros((n, k // 64, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, :, word] |= lanes[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint64(64 - shift)
    return out.reshape(n, -1)


def unpack_bits(words, width: int, k: int):
    n = words.shape[0]
    lanes = words.reshape(n, k // 64, width)
    out = np.empty((n, k // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = lanes[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | lanes[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, j] = v & mask
    return out.reshape(n, k)


def encode_blocks(ids, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    n = -(-len(ids) // block)
    if not n:
        return []
    full = np.empty(n * block, np.uint64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * block :].min()
    v = full.reshape(n, block)
    least = v.min(axis=1)
    d = v - least[:, None]
    at = min(block - 1, int(percentile * block))
    widths = np.maximum(bit_length(np.partition(d.astype(np.uint32), at, axis=1)[:, at]), 1)
    out: list[bytes] = [b""] * n
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        part = d[rows]
        low = part & np.uint64((1 << w) - 1)
        packed = pack_bits(low, w)
        of, place = np.nonzero(part != low)
        bounds = np.searchsorted(of, np.arange(len(rows) + 1)).tolist()
        place, value = place.astype("<u2"), part[of, place].astype("<u4")
        head = np.zeros(len(rows), BLOCK_HEAD)
        head["least"], head["width"] = least[rows], w
        head["exceptions"] = np.diff(bounds)
        for i, r in enumerate(rows.tolist()):
            a, b = bounds[i], bounds[i + 1]
            out[r] = b"".join(
                (head[i].tobytes(), packed[i].tobytes(), place[a:b].tobytes(), value[a:b].tobytes())
            )
    return out


def encode_file(ids, doc_ids, known, sizes, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = encode_blocks(ids, block, percentile)
    head = np.zeros(1, HEAD)
    head["block"], head["docs"], head["ids"], head["blocks"] = block, len(sizes), len(ids), len(blocks)
    parts = [
        MAGIC,
        head.tobytes(),
        np.asarray(doc_ids, "<i8").tobytes(),
        np.asarray(known, "u1").tobytes(),
        np.asarray(sizes, "<u4").tobytes(),
    ]
    first = sum(map(len, parts)) + 8 * len(blocks)
    length = np.fromiter(map(len, blocks), np.int64, len(blocks))
    starts = (first + np.cumsum(length) - length).astype("<u8")
    return b"".join([*parts, starts.tobytes(), *blocks])


def decode_blocks(data: bytes, starts, block: int, n_ids: int):
    raw = np.frombuffer(data, np.uint8)
    n = len(starts)
    if not n:
        return np.zeros(0, "<u4")
    starts = starts.astype(np.int64)
    head = raw[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD)[:, 0]
    out = np.empty((n, block), np.uint32)
    for w in np.unique(head["width"]).tolist():
        rows = np.flatnonzero(head["width"] == w)
        size = block // 64 * w * 8
        body = starts[rows] + BLOCK_HEAD.itemsize
        words = np.empty((len(rows), size), np.uint8)
        for i, a in enumerate(body.tolist()):
            words[i] = raw[a : a + size]
        out[rows] = unpack_bits(words.view("<u8"), w, block)
        for r, a, e in zip(rows.tolist(), (body + size).tolist(), head["exceptions"][rows].tolist()):
            if e:
                out[r, np.frombuffer(data, "<u2", e, a)] = np.frombuffer(data, "<u4", e, a + 2 * e)
    out += head["least"][:, None]
    return out.reshape(-1)[:n_ids]


def decode_file(data: bytes):
    """Ids, document ids, known-flags and ids per document of a file; ValueError if it is not whole."""
    if data[:8] != MAGIC or len(data) < 8 + HEAD.itemsize:
        raise ValueError("not a token id file")
    head = np.frombuffer(data, HEAD, 1, 8)[0]
    at, docs, blocks = 8 + HEAD.itemsize, int(head["docs"]), int(head["blocks"])
    if len(data) < at + 13 * docs + 8 * blocks:
        raise ValueError("the file ends in its index")
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 13 * docs)
    ids = decode_blocks(data, starts, int(head["block"]), int(head["ids"]))
    if int(sizes.sum(dtype=np.int64)) != len(ids):
        raise ValueError("the documents' sizes do not add up to the ids")
    return ids.astype("<u4"), doc_ids, known.astype(bool), sizes


def read_block(data: bytes, k: int):
    """One block through the index."""
    head = np.frombuffer(data, HEAD, 1, 8)[0]
    at = 8 + HEAD.itemsize + 13 * int(head["docs"]) + 8 * k
    block, n = int(head["block"]), int(head["ids"])
    start = np.frombuffer(data, "<u8", 1, at)
    return decode_blocks(data, start, block, min(block, n - k * block))


def write_token_files(
    docs: DataFrame,
    folder: str,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write documents in ascending doc_id order as token id files; returns the manifest, stored.

    A null text counts as empty and gives the end id alone; null doc_ids come first; ties keep
    the order of their texts' hashes. A file holds about `shard_ids` ids, a longer document
    stands in a file of its own. Files are renamed into place and named in the manifest only
    by tasks that ended well. An empty table gives no file.
    """
    path = tokenizer or default_tokenizer()

    def run(batches) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        sub = Subwords(path)
        store, root = open_store(folder)
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal shard
            ids, doc_ids, known, sizes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            data = encode_file(ids, doc_ids, known, sizes)
            name = f"{part:06d}-{shard:06d}-{uuid.uuid4().hex}.pfor"
            write_file(store, f"{root}/{name}", data)
            row = (part, shard, name, len(sizes), len(ids), len(data))
            shard += 1
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types)],
                ["part", "shard", "path", "n_docs", "n_ids", "n_bytes"],
            )

        waiting = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = np.array(batch.column(0).is_valid())
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            for a, b in text_slices(texts, min(SLICE_CHARS, shard_ids)):
                ids, at = sub.encode(texts[a:b])
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                held.append((ids, doc_ids[a:b], known[a:b], np.diff(at) + 1))
                waiting += len(ids)
                if waiting >= shard_ids:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return keep(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(frames) -> Iterator:
        import zlib

        import pandas as pd

        store, root = open_store(folder)
        for f in frames:
            for name, base in zip(f["path"], f["base"].tolist()):
                ids, doc_ids, known, sizes = decode_file(read_file(store, f"{root}/{name}"))
                stop = np.cumsum(sizes, dtype=np.int64)
                start = stop - sizes
                raw = memoryview(ids.tobytes())
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(np.where(known, doc_ids, 0), "Int64").copy()
                        if known.all()
                        else pd.array([i if k else None for i, k in zip(doc_ids.tolist(), known)], "Int64"),
                        "start": base + start,
                        "n_tokens": sizes.astype(np.int64),
                        "ids_crc32": [
                            zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(start.tolist(), stop.tolist())
                        ],
                    }
                )

    # One narrow row per file, not per document, is put in order here.
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks, "path").select("path", "base").mapInPandas(run, DOCS)


def token_files(docs: DataFrame, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Encode, write and read back: the documents as the files hold them."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, end_id, tokenizer), folder)
