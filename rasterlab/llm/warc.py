"""WARC archives: a writer with revisits, and a salvage reader that gets past damage."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.llm.shared import shared_dir

#: Payloads of so many bytes can be revisited; archives are closed beyond so many compressed bytes.
REVISIT_BYTES, ARCHIVE_BYTES = 100, 16 << 20
_GZIP, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_HEAD = re.compile(rb"WARC/1\.[0-9](?:\r\n(?:[!-9;-~]+:[^\r\n]*|[ \t][^\r\n]*))*")
_DATE = "2024-01-01T00:00:00Z"


def _clean(value: str) -> str:
    """A header value stands in one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the digest and length of its payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": _DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Payload-Length": str(len(payload)),
    }
    head |= {"WARC-Target-URI": _clean(url)} if url is not None else {}
    head |= {"X-Page-ID": str(page_id)} if page_id is not None else {}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``(page_id, url, html)`` as gzipped WARC archives, a member per record, into ``folder``; return their list.

    Among payloads equal by SHA-256 with at least ``REVISIT_BYTES`` bytes, the smallest page id is the response and
    the others revisit it; rows that repeat that id are responses too. Only digests and ids are grouped and joined by
    digest; payloads move once, spread by a hash of id, url and digest, so that a payload repeated in any number of
    pages is no hot key. Null html is an empty payload; a null page id never is what others revisit, and if no other
    page has the payload, its rows are responses.

    An archive's name holds its task attempt, and only names in the returned list ``(name, records)`` count: it is
    written by Spark's own commit, so archives of lost or repeated tasks are never read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("mark", F.xxhash64("page_id", "url", "digest"))
    narrow = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "mark", "digest")
    same = narrow.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null").drop("copies")
    revisits = narrow.join(same, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).groupBy("mark", "digest").agg(F.min("keeper").alias("keeper"))
    rows = rows.join(revisits, ["mark", "digest"], "left")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        number, out, size, records = 0, None, 0, 0
        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    name = f"{stem}-{number:04d}.warc.gz"
                    out, size, records, number = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0, number + 1
                kind = "response" if x["keeper"] is None else "revisit"
                member = gzip.compress(record(kind, x["url"], x["page_id"], x["payload"], x["digest"], x["keeper"]), 4, mtime=0)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["name", "records"])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["name", "records"])

    names = f"{folder}-names"
    rows.mapInArrow(run, "name string, records long").write.parquet(names)
    return pages.sparkSession.read.schema("name string, records long").parquet(names)


def _head(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines.split(b"\r\n")[1:])
    return {a.decode("utf-8", "replace").strip().lower(): b.decode("utf-8", "replace").strip() for a, _, b in pairs if a}


class _Marks:
    """Where marks stand next in ``data``. Each place is searched once, as what is asked for only moves forward."""

    def __init__(self, data: bytes):
        self.data, self.next, self.zeros = data, {}, None

    def after(self, mark: bytes, at: int) -> int:
        """The first ``mark`` from ``at`` on, or -1."""
        place = self.next.get(mark, -2)
        if place != -1 and place < at:
            place = self.next[mark] = self.data.find(mark, at)
        return place

    def zero(self, at: int) -> int:
        """The first zero byte from ``at`` on, or the end; this may go back and forth."""
        if self.zeros is None:
            self.zeros = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0)
        i = int(np.searchsorted(self.zeros, at))
        return int(self.zeros[i]) if i < len(self.zeros) else len(self.data)

    def first(self, at: int) -> int:
        """The first member or version line from ``at`` on, or the end."""
        return min((x for x in (self.after(_GZIP, at), self.after(_VERSION, at)) if x >= 0), default=len(self.data))


def _one(data: bytes, at: int, marks: _Marks) -> tuple[dict[str, str], bytes, int] | str:
    """The record at ``at`` of uncompressed bytes: its head, block and end; or what is wrong with it."""
    if not data.startswith(_VERSION, at):
        return "no version line"
    stop, another = marks.after(b"\r\n\r\n", at), marks.after(b"\n" + _VERSION, at)
    if stop < 0 or 0 <= another < stop:  # a head that another version line interrupts is cut off
        return "no end of the head"
    if not _HEAD.fullmatch(data, at, stop):
        return "a broken head"
    head = _head(data[at:stop])
    if not head.get("content-length", "").isdigit():
        return "no content length"
    begin, size = stop + 4, int(head["content-length"])
    if data[begin + size : begin + size + 4] != b"\r\n\r\n":
        return "wrong content length"
    block = data[begin : begin + size]
    wanted = head.get("warc-block-digest", "")
    if wanted.startswith("sha256:") and hashlib.sha256(block).hexdigest() != wanted[7:]:
        return "wrong block digest"
    return head, block, begin + size + 4


def _begin(data: bytes, at: int, marks: _Marks) -> int | None:
    """Where the compressed bytes of the member at ``at`` begin, behind its header; None if they don't."""
    if len(data) < at + 10 or data[at + 3] & 0xE0:
        return None
    flags, place = data[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for text in (8, 16):  # name and comment end with a zero byte
        if flags & text:
            place = marks.zero(place) + 1
    place += flags & 2
    return place if place < len(data) else None


def _member(data: bytes, at: int, marks: _Marks, most: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """The gzip member at ``at`` as far as it reads, its end (0 where it fails) and what is wrong with it.

    It is fed in growing slices, so that a false mark costs little and what follows the member is not copied; a slice
    that fails is fed again byte by byte.
    """
    begin = _begin(data, at, marks)
    if begin is None:
        return b"", 0, "a broken header of a member"
    unzip, plain, step, at, checksum, size = zlib.decompressobj(-15), [], 256, begin, 0, 0
    while not unzip.eof:
        if at >= len(data):
            return b"".join(plain) + unzip.flush(), 0, "the member is cut off"
        before = unzip.copy()
        try:
            more = unzip.decompress(data[at : at + step])
        except zlib.error as e:
            try:
                for i in range(at, min(at + step, len(data))):
                    plain.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(plain), 0, str(e)
        plain.append(more)
        checksum, size = zlib.crc32(more, checksum), size + len(more)
        at, step = at + step, min(most, 2 * step)
    end = min(at, len(data)) - len(unzip.unused_data)
    trailer = data[end : end + 8]
    if len(trailer) < 8:
        return b"".join(plain), 0, "the member is cut off"
    if trailer != checksum.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
        return b"".join(plain), 0, "wrong checksum"
    return b"".join(plain), end + 8, None


def _inside(plain: bytes) -> tuple[list[tuple], list[str], bool]:
    """The records of decompressed bytes, what is wrong between them, and whether the last bytes are such a gap."""
    found, wrong, place, lost, marks = [], [], 0, False, _Marks(plain)
    while place < len(plain):
        one = _one(plain, place, marks)
        if isinstance(one, str):
            if not lost:
                wrong.append(one)
            lost = True
            following = marks.after(_VERSION, place + 1)
            place = following if following >= 0 else len(plain)
        else:
            found.append(one[:2])
            place, lost = one[2], False
    return found, wrong, lost


def _reads_well(data: bytes, at: int, marks: _Marks) -> bool:
    """Whether a member with a version line in front, or a whole record, begins at ``at``."""
    return _member(data, at, marks)[0].startswith(_VERSION) if data.startswith(_GZIP, at) else not isinstance(_one(data, at, marks), str)


def salvage(data: bytes) -> Iterator[tuple]:
    """``("record", start, end, head, block)`` and ``("gap", start, end, reason)`` over a whole archive, in order.

    Gzip members and plain records may follow each other in any order. Members are checked by gzip's own checksum,
    records by their length, end and block digest. After a failed check the reader goes to the next mark of either
    kind, member or version line, and tries again there; what lies between is a gap. Where a member fails, or a record
    in it, the version lines of what could be decompressed are searched too: records that check out are kept, with the
    member's place, and each stretch between them is a gap of the same place. Of a member that fails, only records with
    a block digest count, as no checksum covers the others. A member without records is a gap, too.
    """
    at, gap, reason, marks = 0, None, "", _Marks(data)
    while at < len(data):
        found, wrong, after = [], [], 0
        if data.startswith(_GZIP, at):
            plain, after, failed = _member(data, at, marks)
            found, wrong, lost = _inside(plain)
            if failed is not None:
                found = [x for x in found if x[0].get("warc-block-digest", "").startswith("sha256:")]
                wrong = [*(wrong[:-1] if lost else wrong), failed]
                after = marks.first(at + 1)
                while found and after < len(data) and not _reads_well(data, after, marks):
                    after = marks.first(after + 1)
        elif isinstance(one := _one(data, at, marks), str):
            wrong, after = [one], marks.first(at + 1)
        else:
            found, after = [one[:2]], one[2]
        if not found:
            if gap is None:
                gap, reason = at, wrong[0] if wrong else "an empty member"
            at = after
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        for head, block in found:
            yield "record", at, after, head, block
        for x in wrong:
            yield "gap", at, after, x
        at = after
    if gap is not None:
        yield "gap", gap, len(data), reason


def read_archives(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """All records and gaps of the archives in ``folder``: ``kind`` is ``record`` or ``gap``.

    ``archive, kind, start, end`` (bytes of the archive), ``reason`` of a gap, and of a record ``record_type, page_id,
    url, payload_digest`` (of the payload itself where the record holds it, else as its head says), ``payload_bytes``,
    ``refers_to`` and ``payload``. With ``names``, the list that ``write_archives`` returned, tasks open the archives of
    their part of the list. Without, Spark reads all files ending in .warc or .warc.gz, which are limited to 2 GB each.
    An archive is read by one task, so its size bounds the memory; ``write_archives`` closes archives early for that.
    """
    if names is not None:
        files = names.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))
        files = files.repartition(max(1, files.count()), "path")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path", "content")
    schema = "archive string, kind string, start long, end long, reason string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"

    def number(x: str | None) -> int | None:
        return int(x) if x and re.fullmatch(r"-?\d+", x) else None

    def content(batch: pa.RecordBatch, i: int) -> bytes:
        if "content" in batch.schema.names:
            return batch["content"][i].as_buffer().to_pybytes()
        fs, path = pafs.FileSystem.from_uri(batch["path"][i].as_py())
        with fs.open_input_file(path) as f:
            return f.read()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive, out, held = batch["path"][i].as_py(), [], 0
                for kind, start, end, *rest in salvage(content(batch, i)):
                    row = dict.fromkeys(_FIELDS) | {"archive": archive, "kind": kind, "start": start, "end": end}
                    if kind == "gap":
                        row["reason"] = rest[0]
                    else:
                        head, block = rest
                        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                        row |= {"record_type": head.get("warc-type"), "page_id": number(head.get("x-page-id")), "url": head.get("warc-target-uri"), "refers_to": number(head.get("x-refers-to-page-id"))}
                        if row["record_type"] == "revisit":
                            row |= {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:"), "payload_bytes": number(head.get("x-payload-length"))}
                        else:
                            row |= {"payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload}
                    out.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return files.mapInArrow(run, schema)


_SCHEMA = pa.schema([
    ("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()),
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
_FIELDS = _SCHEMA.names


def archive_pages(pages: DataFrame) -> tuple[str, DataFrame]:
    """Write ``pages`` to a new folder of the shared storage; the folder and the list of its archives."""
    folder = f"{shared_dir(pages.sparkSession)}-warc"
    return folder, write_archives(pages, folder)
