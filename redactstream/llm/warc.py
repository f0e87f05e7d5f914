"""WARC archives of pages, and a reader that salvages what damage leaves.

A file holds one gzip member per record (WARC/1.1). A page is a response record with an HTTP
block, or, where an equal payload of at least `least` bytes has a smaller page_id, a revisit
record that names that page. Both carry the length and digest of the full payload.

The reader checks every record: the member's own checksum, version line, headers, block
length, closing lines, and the block digest. After a failed check it looks for the next valid
gzip member or version line, goes on from there and logs the bytes between as a quarantined
gap. Plain (uncompressed) archives are read the same way.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactstream.llm.store import fresh_folder, keep, open_store, read_file, write_file

LEAST_BYTES = 100
SHARD_BYTES = 32_000_000
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
STEP = 16_384
UNPACKS_NOT = "gzip member does not unpack"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
ROWS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, html string, path string, gap_start long, gap_end long, gap_reason string"
)


# --------------------------------------------------------------------- one record
def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_number(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def clean_url(url: str) -> str:
    """White space and control characters, which would end a header line, as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_name(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_url(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_name(refers_to)}"]
    return b"".join((VERSION, "\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(Exception):
    """A record failed a check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at a version line."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers without an end")
    try:
        lines = data[at:stop].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(headers["content-length"])
    except (ValueError, KeyError):
        raise Damaged("headers do not parse") from None
    start, end = stop + 4, stop + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block length is wrong")
    block = data[start:end]
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha256:") and hashlib.sha256(block).hexdigest() != named[7:]:
        raise Damaged("block digest differs")
    return headers, block, end + 4


def unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What unpacks of the gzip member at a position, where reading ended, and what is wrong with it, if anything."""
    z, out, stop, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        # In small steps: what a step leaves unused is copied.
        while not z.eof and stop < len(data):
            out.append(z.decompress(view[stop : stop + STEP]))
            stop = min(stop + STEP, len(data))
    except zlib.error:
        # The step that failed again, byte by byte, for what it gives before the damage.
        z = zlib.decompressobj(31)
        for k in range(at, stop, STEP):
            z.decompress(view[k : k + STEP])
        try:
            for k in range(stop, min(stop + STEP, len(data))):
                out.append(z.decompress(view[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out), stop, UNPACKS_NOT
    if not z.eof:
        return b"".join(out), stop, "gzip member is cut off"
    return b"".join(out), stop - len(z.unused_data), ""


def packed_size(data: bytes, at: int, size: int) -> int:
    """How many bytes of the member at a position give its first `size` unpacked bytes."""
    z, view, stop = zlib.decompressobj(31), memoryview(data), at
    while size > 0:
        size -= len(z.decompress(view[stop : stop + STEP], size))
        stop += STEP - len(z.unconsumed_tail)
    return min(stop, len(data)) - at


def member_items(plain: bytes, digests_only: bool) -> tuple[list[tuple], int]:
    """("record", headers, block) and ("gap", start, end, reason) of unpacked bytes, and where the last record ends.

    After a failed check the next version line where a record passes its checks is looked for.
    """
    items, at, gap, reason, good = [], 0, None, "", 0
    while at < len(plain):
        try:
            headers, block, end = parse_record(plain, at)
            if digests_only and not headers.get("warc-block-digest", "").startswith("sha256:"):
                raise Damaged("no digest to trust in a damaged member")
        except Damaged as problem:
            if gap is None:
                gap, reason = at, str(problem)
            line = VERSION_LINE.search(plain, at + 1)
            at = line.start() if line else len(plain)
            continue
        if gap is not None:
            items.append(("gap", gap, at, reason))
            gap = None
        items.append(("record", headers, block))
        at = good = end
    if gap is not None:
        items.append(("gap", gap, len(plain), reason))
    return items, good


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", headers, block) and ("gap", start, end, reason), in file order.

    A gap runs from the first byte that failed to the next place where a member holds a record that
    passes every check, or a plain record does, or to the file's end. Where a member unpacks but some of its
    records fail, the gap is the member, and its reason says which of the unpacked bytes. Of a member
    that does not unpack to its end, or whose checksum differs, the records with a true block digest are
    kept; but where it holds one record only, a wrong checksum speaks of that record, which is not kept.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        good = 0
        try:
            if data.startswith(GZIP, at):
                plain, end, problem = unpack(data, at)
                found, good = member_items(plain, bool(problem))
                if not good and (problem or plain) or problem == UNPACKS_NOT and len(found) == 1:
                    raise Damaged(problem or found[0][3])
            elif data.startswith(b"WARC/1.", at):
                headers, block, end = parse_record(data, at)
                found, problem = [("record", headers, block)], ""
            else:
                raise Damaged("neither a gzip member nor a version line")
        except Damaged as failed:
            if gap is None:
                gap, reason = at, str(failed)
            at = next_place(data, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        if problem:
            end = at + packed_size(data, at, good)
            if found[-1][0] == "gap":  # what follows the last record is the gap in the file
                found.pop()
        for item in found:
            if item[0] == "gap":
                item = ("gap", at, end, f"unpacked bytes {item[1]} to {item[2]}: {item[3]}")
            yield item
        at = end
        if problem:
            gap, reason = at, problem
            at = next_place(data, at)
    if gap is not None:
        yield "gap", gap, len(data), reason


def next_place(data: bytes, at: int) -> int:
    """The next place that may begin a member or a record; the end if there is none."""
    places = [p for p in (data.find(GZIP, at), data.find(b"WARC/1.", at)) if p >= 0]
    return min(places) if places else len(data)


# ------------------------------------------------------------------- as Spark jobs
def with_first_copies(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload text and digest, record type and the page a revisit refers to.

    A null html is an empty payload. Copies of a payload are found by length and digest; the
    smallest page_id is the response. Rows that repeat that page_id are responses too, rows
    without a page_id revisit if another row has one. The minimum is taken before the shuffle,
    so a payload of many copies costs one row per task; the join back splits large keys.
    """
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_ones = rows.where(F.octet_length("html") >= least)
    first = long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    out = rows.join(first.where("n > 1").drop("n"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(revisit, F.col("first")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def write_archives(
    pages: DataFrame, folder: str, least: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write every page to WARC files in the folder; returns the stored manifest of whole files.

    Files are written under passing names and renamed; those of tasks that died are not named.
    """

    def run(batches) -> Iterator:
        import uuid

        import pyarrow as pa

        store, root = open_store(folder)
        held: list[bytes] = []
        size = 0

        def flush():
            name, data = f"{uuid.uuid4().hex}.warc.gz", b"".join(held)
            write_file(store, f"{root}/{name}", data)
            row = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())],
                ["path", "n_records", "n_bytes"],
            )
            held.clear()
            return row

        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(
                *(batch.column(i).to_pylist() for i in range(6))
            ):
                payload = html.encode()
                held.append(gzip_member(record_bytes(page_id, url, payload, digest, refers_to, revisit)))
                size += len(held[-1])
                if size >= shard_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return keep(with_first_copies(pages, least).mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, strict: bool = False) -> DataFrame:
    """Every record of the files that passes its checks, and every quarantined gap.

    Record rows have a record_type and no gap; gap rows have gap_start, gap_end (bytes, end
    exclusive) and gap_reason. `html` is null for revisits, whose payload is elsewhere. With `strict` a
    file with a gap, or with another number of records than the manifest says, is an error.
    """

    def run(frames) -> Iterator:
        import pandas as pd

        store, root = open_store(folder)
        names = [f.split()[0] for f in ROWS.split(", ")]

        def frame(rows):
            f = pd.DataFrame(rows, columns=names)
            whole = ("page_id", "payload_bytes", "refers_to", "gap_start", "gap_end")
            return f.astype({c: "Int64" for c in whole})

        for f in frames:
            for name, n_records in zip(f["path"], f["n_records"]):
                rows, size, n = [], 0, 0
                for found in salvage(read_file(store, f"{root}/{name}")):
                    if found[0] == "gap":
                        if strict:
                            raise RuntimeError(f"{name}: bytes {found[1]} to {found[2]} are lost: {found[3]}")
                        rows.append((*[None] * 7, name, *found[1:]))
                        continue
                    _, headers, block = found
                    n += 1
                    kind = headers.get("warc-type")
                    payload = block.split(b"\r\n\r\n", 1)[-1] if kind == "response" else b""
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    length = int(headers.get("x-payload-length", len(payload)))
                    if kind == "response":
                        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                    rows.append(
                        (
                            page_number(headers.get("warc-record-id")),
                            length,
                            digest,
                            kind,
                            page_number(headers.get("warc-refers-to")) if kind == "revisit" else None,
                            headers.get("warc-target-uri"),
                            payload.decode("utf-8", "replace") if kind == "response" else None,
                            name,
                            None,
                            None,
                            None,
                        )
                    )
                    size += len(payload)
                    if size > 16_000_000:
                        yield frame(rows)
                        rows, size = [], 0
                if strict and n != n_records:
                    raise RuntimeError(f"{name}: {n} records of {n_records}")
                if rows:
                    yield frame(rows)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_records = F.col("n_records") if strict else F.lit(None).cast("long").alias("n_records")
    return manifest.select("path", n_records).repartition(tasks, "path").mapInPandas(run, ROWS)


def records(rows: DataFrame) -> DataFrame:
    return rows.where("gap_start IS NULL").drop("gap_start", "gap_end", "gap_reason")


def gaps(rows: DataFrame) -> DataFrame:
    return rows.where("gap_start IS NOT NULL").select("path", "gap_start", "gap_end", "gap_reason")


def archive_round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write the pages, read the archives back: one row per page. Damage on the way is an error."""
    folder = fresh_folder(pages.sparkSession, "warc")
    found = records(read_archives(write_archives(pages, folder, least), folder, strict=True))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
