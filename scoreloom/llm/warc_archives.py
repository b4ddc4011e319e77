"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdxj``, a line for each record with its place in the first. The reader needs no extraction: it parses
the end record, the ZIP64 end record where there is one, the central directory with its ZIP64 fields and the local headers, finds the
index, and then reads each record by its range.

Of records with equal payloads of at least LEAST bytes that with the largest page_id is a response; the others
are revisits, which carry the HTTP head but no payload, and name it. The writer puts each task's records into archives of its own,
whose names the manifest gives; what a lost task left is never read.

Defined cases: null html is an empty payload; a null url gives an empty target; rows that repeat page_id and payload are told apart
by ``row`` and one of them is the response; an empty table gives no rows; extra columns are ignored; archives with no such index raise.
Of equal payloads with the largest page_id more than once (or a null one alone) the row that was numbered last is the response. A very long
payload is held alone, whole; it may make its archive longer than ARCHIVE_BYTES.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, partitions, record_batch, slices, store

LEAST = 1000
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Bytes of records that are read one after another, and of archives that a task reads at most.
RUN_BYTES, TASK_BYTES = 2 << 20, 256 << 20
SLICE = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ROOM = 0xFFFFFFFF


# --- ZIP ---------------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, written front to back; sizes go to ZIP64 fields always, so that any size fits."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        if self.members and self.members[-1]["open"]:
            m = self.members[-1]
            m["size"] += len(data)
            m["crc"] = zlib.crc32(data, m["crc"])

    def begin(self, name: str) -> None:
        """Size and checksum follow the data (bit 3), as they aren't known yet."""
        raw, start = name.encode(), self.at
        self.put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 8, 0, 0, 33, 0, ROOM, ROOM, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.members.append({"name": raw, "start": start, "size": 0, "crc": 0, "open": True})

    def end(self) -> None:
        m = self.members[-1]
        m["open"] = False
        self.put(struct.pack("<4sIQQ", b"PK\7\x08", m["crc"], m["size"], m["size"]))

    def close(self) -> None:
        begin = self.at
        for m in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["start"])
            self.put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 8, 0, 0, 33, m["crc"], ROOM, ROOM, len(m["name"]), len(extra), 0, 0, 0, 0, ROOM) + m["name"] + extra)
        size, n, end = self.at - begin, len(self.members), self.at
        self.put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin))
        self.put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, ROOM, ROOM, 0))


class ZipReader:
    """Members of a ZIP file by name: (offset of the data, size). ``src``: size() and read_at(n, offset)."""

    def __init__(self, src):
        self.src, self.members = src, {}
        total = src.size()
        tail_at = max(0, total - 22 - 0xFFFF)
        tail = src.read_at(total - tail_at, tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        n, size, begin = struct.unpack_from("<HII", tail, end + 10)
        if end + tail_at >= 20 and (n == 0xFFFF or ROOM in (size, begin)):
            mark, _, at, _ = struct.unpack("<4sIQI", src.read_at(20, tail_at + end - 20))
            if mark == b"PK\6\7":
                n, size, begin = struct.unpack_from("<QQQ", src.read_at(56, at), 32)
        directory, at = src.read_at(size, begin), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            method, stored, whole, name, extra, comment, start = (*struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<IIHHH", directory, at + 20), *struct.unpack_from("<I", directory, at + 42))
            title = directory[at + 46 : at + 46 + name].decode()
            field, stop = at + 46 + name, at + 46 + name + extra
            while field + 4 <= stop:
                kind, length = struct.unpack_from("<HH", directory, field)
                if kind == 1:  # ZIP64: only the values that have no room above, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", directory, field + 4))
                    whole = next(values) if whole == ROOM else whole
                    stored = next(values) if stored == ROOM else stored
                    start = next(values) if start == ROOM else start
                field += 4 + length
            if method == 0:  # of packed members no range can be read
                self.members[title] = start, stored
            at = stop + comment
        self.found: dict[str, tuple[int, int]] = {}

    def place(self, name: str) -> tuple[int, int]:
        """The local header says where the data of a member begins."""
        if name not in self.found:
            start, size = self.members[name]
            head = self.src.read_at(30, start)
            if head[:4] != b"PK\3\4":
                raise ValueError(f"no local header of {name}")
            self.found[name] = start + 30 + sum(struct.unpack_from("<HH", head, 26)), size
        return self.found[name]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        at, size = self.place(name)
        if offset + (size - offset if length is None else length) > size:
            raise ValueError(f"range beyond {name}")
        return self.src.read_at(size - offset if length is None else length, at + offset)


# --- WARC --------------------------------------------------------------------------------------------------------------


def record(row: int, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, gzipped. A revisit has the HTTP head alone, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{row}>", f"WARC-Target-URI: {''.join(url.splitlines())}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parsed(raw: bytes) -> dict:
    """Headers and payload of one gzipped record; a response's digest is checked."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1].split(":")[0]
    refers = fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
    return {"page_id": int(page) if page else None, "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers not in ("", "None") else None}


# --- writing and reading -------------------------------------------------------------------------------------------------

MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def planned(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """row, page_id, url, body, digest, revisit, refers_to of every row of ``pages``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("body"))
    rows = scratch.table(rows.withColumns({"digest": F.sha1("body"), "key": F.when(F.length("body") >= LEAST, F.sha2("body", 256))}), "rows")
    first = rows.where("key is not null").groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = rows.select("row", "key").join(first.hint("merge"), "key").where(F.col("row") != F.col("first.row")).select("row", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    return rows.join(scratch.table(marks, "marks").hint("merge"), "row", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))


def write(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes the archives; their manifest: archive, records, bytes."""
    root = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        fs.create_dir(base, recursive=True)
        done, out, z, lines = [], None, None, []

        def close() -> None:
            z.end()
            z.begin(INDEX)
            z.put("".join(lines).encode())
            z.end()
            z.close()
            out.close()
            done.append((name, len(lines), z.at))

        for b in (part for whole in batches for part in slices(whole, "body", SLICE)):
            for r in b.to_pylist():
                if z is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out, lines = fs.open_output_stream(f"{base}/{name}"), []
                    z = ZipWriter(out)
                    z.begin(DATA)
                    start = z.at
                raw = record(r["row"], r["page_id"], r["url"], r["body"], r["digest"], r["refers_to"], r["revisit"])
                lines.append(json.dumps({"page": r["page_id"], "row": r["row"], "offset": z.at - start, "length": len(raw)}) + "\n")
                z.put(raw)
                if z.at > ARCHIVE_BYTES:
                    close()
                    z = None
        if z is not None:
            close()
        if done:
            yield record_batch({k: list(v) for k, v in zip(MANIFEST.names, zip(*done, strict=True), strict=True)}, MANIFEST)

    rows = planned(pages, scratch).select("row", "page_id", "url", "body", "digest", "refers_to", "revisit")
    return scratch.table(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "manifest")


def read(manifest: DataFrame, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives of a manifest.

    Indexes are cut into runs of records of about RUN_BYTES, which tasks read by ranges on their own: a large archive is no task's burden. There are as
    many tasks as partitions, or more where a task would have more than TASK_BYTES of archives to read.
    """
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("archives")).first()
    tasks = max(partitions(manifest.sparkSession), -(-total["bytes"] // TASK_BYTES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        for b in batches:
            for archive in b.column("archive").to_pylist():
                with fs.open_input_file(f"{base}/{archive}") as src:
                    lines = [json.loads(x) for x in ZipReader(src).read(INDEX).decode().splitlines()]
                sizes = itertools.accumulate(x["length"] for x in lines)
                cuts = [[x for x, _ in g] for _, g in itertools.groupby(zip(lines, sizes, strict=True), key=lambda x: x[1] // RUN_BYTES)]
                if cuts:
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(cuts)), pa.array([[x["offset"] for x in c] for c in cuts], pa.list_(pa.int64())), pa.array([[x["length"] for x in c] for c in cuts], pa.list_(pa.int64()))], names=["archive", "offsets", "lengths"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        for b in batches:
            for run in b.to_pylist():
                with fs.open_input_file(f"{base}/{run['archive']}") as src:
                    z, out = ZipReader(src), []
                    for offset, length in zip(run["offsets"], run["lengths"], strict=True):
                        r = parsed(z.read(DATA, offset, length))
                        out.append([r[k] for k in READ.names])
                yield record_batch({k: list(v) for k, v in zip(READ.names, zip(*out, strict=True), strict=True)}, READ)

    cut = manifest.select("archive").repartition(max(1, min(tasks, total["archives"])), "archive").mapInArrow(runs, "archive string, offsets array<bigint>, lengths array<bigint>")
    # with a number, so that tasks aren't put together by the size of the offsets
    cut = cut.repartition(tasks, F.xxhash64("archive", F.element_at("offsets", 1)))
    return cut.mapInArrow(records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), scratch)
    return read(manifest, scratch.path("archives"))


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
     b as (select page_id, octet_length(encode(h)) as n, sha1(h) as d, max(page_id) over (partition by h) as m from p)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> m then m end as refers_to
from b
"""
