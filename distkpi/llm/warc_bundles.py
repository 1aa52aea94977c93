"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records up to about ``FRAME`` bytes, followed by the seek table of the
seekable format (a skippable frame with the compressed and plain size of every
frame). Any Zstandard reader can unpack it from the start; with the seek table
a reader finds a frame, and with the record index (record, bundle, frame,
offsets inside the plain frame) one record costs one frame. All reading goes
through the index: ``read_back`` reads the frames that its rows name, and
``lookup`` those of given ids.

Equal payloads of at least ``REVISIT_FROM`` bytes are stored once: the row with
the largest id is the ``response``, the others are ``revisit`` records that
name it and hold no payload. The table of repeated payloads is written first,
so that Spark joins it by its measured size.

Bundles are written by the tasks, each under a name of its own attempt, into
the shared folder (any file system URI that pyarrow opens). The index is a
Parquet table committed by Spark and lists only the bundles of tasks that
succeeded: after a lost executor a task writes new files, and those of the
lost attempt are in no index. Nothing but the current frame is held in memory.

Null html is the empty payload, a null url has no target header, a null id an
empty record name. Repeated rows get a record each; those with the id of the
response are responses. An empty table gives an empty index. A text larger
than ``FRAME`` has a frame of its own. Other columns of ``pages`` are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.llm.common import materialize
from distkpi.session import scratch_path

REVISIT_FROM = 1000
FRAME = 1 << 20
BUNDLE = 1 << 28
LEVEL = 6
FRAMES = 64          # neighbouring frames that a task reads after each other
RUNS = 16            # such runs of frames per task, once every core has some
ROWS = 4096          # rows of a batch that is returned
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = 9

INDEX = ("page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, "
         "record_start bigint, record_bytes bigint")
BACK = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One WARC record; a revisit if it refers to another record."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode()
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Records of a plain frame: WARC headers, HTTP headers, payload."""
    def headers(part: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in part.decode().split("\r\n")[1:])

    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        warc = headers(data[at:end])
        block = data[end + 4:end + 4 + int(warc["Content-Length"])]
        if len(block) != int(warc["Content-Length"]):
            raise ValueError("a record is cut off")
        cut = block.index(b"\r\n\r\n")
        yield warc, headers(block[:cut]), block[cut + 4:]
        at = end + 4 + len(block) + 4


class BundleWriter:
    """Records into frames into bundles; ``rows`` collects the index."""

    def __init__(self, folder: str):
        self.folder, self.file, self.rows = folder, None, []
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.file is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            system, inner = _open(self.name)
            self.file, self.sizes, self.at = system.open_output_stream(inner, compression=None), [], 0
            self.frame, self.waiting = io.BytesIO(), []
        if self.frame.tell() and self.frame.tell() + len(data) > FRAME:
            self._end_frame()
        self.waiting.append((page_id, self.frame.tell(), len(data)))
        self.frame.write(data)
        if self.at > BUNDLE:
            self.close()

    def _end_frame(self) -> None:
        packed = self.compress(self.frame.getvalue())
        self.file.write(packed)
        for page_id, start, size in self.waiting:
            self.rows.append((page_id, self.name, len(self.sizes), self.at, len(packed), start, size))
        self.sizes.append((len(packed), self.frame.tell()))
        self.at += len(packed)
        self.frame, self.waiting = io.BytesIO(), []

    def close(self) -> None:
        if self.file is None:
            return
        self._end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()
        self.file = None

    def take(self) -> pa.RecordBatch | None:
        """The index rows of ended frames, once."""
        if not self.rows:
            return None
        columns, self.rows = list(zip(*self.rows)), []
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["page_id", "bundle", "frame", "frame_start", "frame_bytes", "record_start", "record_bytes"])


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of every frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - FOOTER)
    n, flags, magic = struct.unpack("<IBI", file.read(FOOTER))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - FOOTER - n * width)
    table, out, at = file.read(n * width), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def frames(path: str) -> Iterator[bytes]:
    """The plain frames of a bundle, one after the other."""
    system, inner = _open(path)
    with system.open_input_file(inner) as file:
        for start, packed, plain in seek_table(file):
            file.seek(start)
            yield zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def records(rows: Iterable[tuple[int | None, str, int, int, int]]) -> Iterator[tuple[int | None, bytes]]:
    """The records at (id, bundle, frame, start in the plain frame, bytes).

    A frame is found by the seek table of its bundle and unpacked alone; rows in
    order of bundle and frame open and unpack each once. One frame is held.
    """
    file, path, number = None, None, None
    try:
        for page_id, bundle, frame, start, size in rows:
            if bundle != path:
                if file is not None:
                    file.close()
                system, inner = _open(bundle)
                file, path, number = system.open_input_file(inner), bundle, None
                table = seek_table(file)
            if frame != number:
                at, packed, plain_size = table[frame]
                file.seek(at)
                plain = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain_size)
                number = frame
            yield page_id, plain[start:start + size]
    finally:
        if file is not None:
            file.close()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives into ``folder``; returns the record index (written beside them)."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"),
                         F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    first = materialize(
        named.filter(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(
            F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), "first"), "warc-repeated")
    planned = named.join(first, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= REVISIT_FROM), "left")
    planned = planned.select("page_id", "url", "payload", "digest", F.when(
        ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        out = BundleWriter(folder)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                out.add(page_id, record(page_id, url, payload, digest, refers_to))
            if (done := out.take()) is not None:
                yield done
        out.close()
        if (done := out.take()) is not None:
            yield done

    return materialize(planned.mapInArrow(run, INDEX), "warc-index")


def read_back(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of an index.

    Each record is cut out of its frame by its offsets; frames without a row in
    ``index`` are not read. It is an error if another record is found there or
    if the payload of a response has another digest.
    """
    def row(page_id: int | None, data: bytes) -> tuple:
        (warc, http, payload), = parse(data)
        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
        kind, refers_to = warc["WARC-Type"], warc.get("WARC-Refers-To")
        if _number(warc["WARC-Record-ID"]) != page_id:
            raise ValueError(f"{warc['WARC-Record-ID']} at the place of record {page_id}")
        if kind == "response":
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{warc['WARC-Record-ID']}: the payload has changed")
            return page_id, len(payload), digest, kind, None
        return page_id, int(http["Content-Length"]), digest, kind, _number(refers_to)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        places = (place for batch in batches for place in zip(*(c.to_pylist() for c in batch.columns)))
        found = (row(*x) for x in records(places))
        while part := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*part), kinds)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # Neighbouring frames of a bundle go to one task. The index is small beside its archives,
    # so the number of tasks follows the frames and not the bytes that are dealt out.
    run_of = F.floor(F.col("frame") / FRAMES).alias("run")
    runs = index.select("bundle", run_of).distinct().count()
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(runs, 4 * cores), -(-runs // RUNS))
    dealt = index.repartition(tasks, "bundle", run_of).sortWithinPartitions("bundle", "frame", "record_start")
    return dealt.select("page_id", "bundle", "frame", "record_start", "record_bytes").mapInArrow(run, BACK)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """:func:`read_back` of the records whose ids are in ``wanted.page_id``.

    Unknown and null ids find nothing, repeated ones find a record once; an id
    that several rows of the archive have finds all of them.
    """
    ids = wanted.select(F.col("page_id").cast("long")).distinct()
    return read_back(index.join(ids, "page_id", "left_semi"))


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages into a new folder of the shared folder and read the archives back."""
    folder = scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    system, inner = _open(folder)
    system.create_dir(inner, recursive=True)
    return read_back(write(pages, folder))


def oracle(table: str = "pages") -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM {table}),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_FROM} AND first IS NOT NULL AND page_id IS DISTINCT FROM first
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM r"""
