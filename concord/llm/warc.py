"""WARC archives of pages: one gzip member per record, duplicates as revisit records, read back in a stream.

Writing: of pages whose payloads are equal and of at least ``MIN_BYTES``
bytes, the one with the smallest id becomes a response and the others revisit
it; a shuffle by payload digest finds it, and a digest that holds much of the
data is split by the join. Each task writes one archive, which counts only if
it is in the manifest: what a lost task leaves behind is never read.

Reading: archives are read in chunks, members are inflated as they come, the
content length frames each block, and block and payload digests are checked
while the bytes pass, so memory holds one chunk whatever a record's size.

Defined results: null or empty html is an empty payload; a null url is left
out of the header; a null ``page_id`` counts after all others, so such a page
revisits any page with an id (null ids alone: all are responses that refer to
nothing); rows that share the smallest id are all responses; an empty table
gives no rows; only the three named columns are read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import n_tasks, open_store, schema, shared_folder, written

MIN_BYTES = 100
CHUNK = 1 << 18
LEVEL = 4
HEAD = 1 << 20

MANIFEST = schema(part="int", path="string", n_records="long")
RESULT = schema(
    page_id="long", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long"
)


class DamagedRecord(ValueError):
    pass


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the payload's digest and length but not the payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:x-page:{'none' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",  # the table has no time; equal runs give equal archives
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%"),
        "WARC-Refers-To": None if refers_to is None else f"<urn:x-page:{refers_to}>",
        "WARC-Profile": None
        if refers_to is None
        else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gzip.compress(head.encode() + block + b"\r\n\r\n") + gzip.flush()


def fields_of(head: bytes, first: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(first):
        raise DamagedRecord(f"{lines[0][:40]!r} instead of {first!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}


def members(file) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a file, its inflated bytes in pieces of bounded size."""
    waiting = file.read(CHUNK)
    while waiting:
        inflate, rest = zlib.decompressobj(31), [waiting]

        def pieces(inflate=inflate, rest=rest):
            data = rest.pop()
            while not inflate.eof:
                out = inflate.decompress(data, CHUNK)
                if out:
                    yield out
                data = inflate.unconsumed_tail
                if not data and not inflate.eof and not out:
                    data = file.read(CHUNK)
                    if not data:
                        raise DamagedRecord("the archive ends inside a record")

        yield pieces()
        if not inflate.eof:
            raise DamagedRecord("a record was left before its end")
        waiting = inflate.unused_data or file.read(CHUNK)


def until(pieces: Iterator[bytes], have: bytes, mark: bytes) -> tuple[bytes, bytes]:
    """What stands before ``mark`` and what has been read after it."""
    while mark not in have:
        if len(have) > HEAD:
            raise DamagedRecord("a header has no end")
        more = next(pieces, None)
        if more is None:
            raise DamagedRecord("a record ends inside its header")
        have += more
    before, _, after = have.partition(mark)
    return before, after


def page_of(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(none|-?\d+)>", uri)
    if not found:
        raise DamagedRecord(f"unknown record id {uri[:60]}")
    return None if found[1] == "none" else int(found[1])


def parse(pieces: Iterator[bytes]) -> tuple:
    """Row of one record; raises if its framing or a digest is wrong."""
    head, have = until(pieces, b"", b"\r\n\r\n")
    warc = fields_of(head, b"WARC/1.1")
    left = int(warc["content-length"])
    block = hashlib.sha256()

    def body() -> Iterator[bytes]:
        nonlocal left, have
        while left:
            if not have:
                have = next(pieces, b"")
                if not have:
                    raise DamagedRecord("a block is shorter than its content length")
            out, have = have[:left], have[left:]
            left -= len(out)
            block.update(out)
            yield out

    blocks = body()
    head, first = until(blocks, b"", b"\r\n\r\n")
    http = fields_of(head, b"HTTP/1.1")
    payload, n = hashlib.sha256(first), len(first)
    for piece in blocks:
        payload.update(piece)
        n += len(piece)
    have += b"".join(pieces)
    if have != b"\r\n\r\n":
        raise DamagedRecord("a record is longer than its content length")
    if f"sha256:{block.hexdigest()}" != warc["warc-block-digest"]:
        raise DamagedRecord("a block differs from its digest")
    kind, size, digest = warc["warc-type"], int(http["content-length"]), warc["warc-payload-digest"]
    if kind == "response" and (n != size or f"sha256:{payload.hexdigest()}" != digest):
        raise DamagedRecord("a payload differs from its digest or length")
    refers_to = page_of(warc["warc-refers-to"]) if kind == "revisit" else None
    return page_of(warc["warc-record-id"]), size, digest.removeprefix("sha256:"), kind, refers_to


def with_originals(pages: DataFrame) -> DataFrame:
    """Pages with payload digest and, for those that revisit another, its id."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("digest")
    )
    large = pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1 and first is not null").select(F.col("digest").alias("same"), "first")
    found = pages.join(first, F.col("digest") == F.col("same"), "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return found.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task; returns the manifest: part, path, n_records."""

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, out = TaskContext.get().partitionId(), 0, None
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(batch.page_id, batch.url, batch.html, batch.digest, batch.refers_to, strict=True):
                if out is None:
                    system, place = open_store(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                page, url, html, digest, refers = row
                out.write(record(page and int(page), url, html, digest, refers and int(refers)))
                n += 1
        if out:
            out.close()
            yield pd.DataFrame([(part, path, n)], columns=MANIFEST.names)

    # ids travel as text: pandas turns integers with nulls into doubles
    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
    return with_originals(pages).select(as_text).mapInPandas(archives, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that the manifest names."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, expected in zip(batch.path, batch.n_records, strict=True):
                system, place = open_store(path)
                with system.open_input_stream(place, compression=None) as file:
                    rows = [parse(pieces) for pieces in members(file)]
                if len(rows) != expected:
                    raise DamagedRecord(f"{path} has {len(rows)} records instead of {expected}")
                out = pd.DataFrame(rows, columns=RESULT.names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = max(1, min(manifest.count(), 4 * n_tasks(manifest.sparkSession)))
    return manifest.select("path", "n_records").repartition(tasks).mapInPandas(records, RESULT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to a new shared folder and read every record back from them."""
    folder = shared_folder(pages.sparkSession)
    return read(written(write(pages, folder)))
