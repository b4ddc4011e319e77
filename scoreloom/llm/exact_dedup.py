"""Exact dedup with an extendible-hash index on shared files.

Keys are 64-bit hashes of the texts, lower-cased in A-Z only. The key space is cut into as many ranges as there are
owner tasks. Each map task first folds equal texts into one row, so that a text that a third of all rows
repeat reaches its owner about once a task. An owner gets its range in key order and inserts into its buckets by the place of a key within the range
(so that all bits of the directory tell): an overfull bucket is split by the next bit, and where its depth passes that of the directory, the directory
doubles. Texts that share a key chain within the bucket; bytes decide which entry of the chain a text is. As keys come
in order, a bucket that lies below the present key is complete and goes to the owner's file in the shared folder: an
owner holds one bucket and the directory. The file ends with the directory. ``Index`` reads files by ranges: the range of a key names the file,
the directory its bucket, and one page is read.

Defined cases: null counts as the empty text; equal texts keep the largest doc_id; of rows that repeat both doc_id
and text one is kept; null doc_ids are smaller than all others; an empty table gives no rows; further columns pass ``dedup`` under any name.
A very long text is held whole, and alone fills its bucket.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, blobs, deal, documents, low, partitions, record_batch, store, with_class

BUCKET_ENTRIES = 4096
BUCKET_BYTES = 8 << 20
KEY_BITS = 64
#: The directory of an owner has 2 ** MOST_DEPTH places at most, for some 4 * 10^9 texts; a bucket that is still overfull then chains on.
MOST_DEPTH = 20
#: Bytes of texts that a map task holds while it folds.
HELD = 6 << 20


class Bucket:
    """Entries of the keys that begin with ``prefix``, a number of ``depth`` bits."""

    def __init__(self, prefix: int, depth: int):
        self.prefix, self.depth, self.chains, self.entries, self.bytes = prefix, depth, {}, 0, 0

    def add(self, key: int, entry: list) -> None:
        self.chains.setdefault(key, []).append(entry)
        self.entries += 1
        self.bytes += len(entry[0])

    def overfull(self, entries: int, size: int) -> bool:
        return (self.entries > entries or self.bytes > size) and len(self.chains) > 1 and self.depth < MOST_DEPTH

    def split(self) -> tuple[Bucket, Bucket]:
        halves = Bucket(self.prefix * 2, self.depth + 1), Bucket(self.prefix * 2 + 1, self.depth + 1)
        for key, chain in self.chains.items():
            for entry in chain:
                halves[key >> (KEY_BITS - 1 - self.depth) & 1].add(key, entry)
        return halves

    def page(self) -> bytes:
        """Its entries: key, keep id (with a flag for null), group size, length of the text, and the texts behind."""
        rows = [(entry[4], *entry[:4]) for _, chain in sorted(self.chains.items()) for entry in chain]
        head = b"".join(struct.pack("<QqBqQ", key, keep or 0, keep is not None, n, len(text)) for key, text, keep, n, _ in rows)
        raw = struct.pack("<I", len(rows)) + head + b"".join(r[1] for r in rows)
        return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def read_page(page: bytes) -> Iterator[tuple[int, int | None, int, bytes]]:
    raw = pa.decompress(page[8:], struct.unpack_from("<Q", page)[0], codec="zstd", asbytes=True)
    at, step = 4, struct.calcsize("<QqBqQ")
    count = struct.unpack_from("<I", raw)[0]
    text = at + step * count
    for _ in range(count):
        key, keep, known, n, length = struct.unpack_from("<QqBqQ", raw, at)
        yield key, keep if known else None, n, raw[text : text + length]
        at, text = at + step, text + length


def owner_of(key: int, owners: int) -> tuple[int, int]:
    """(the owner of a key, its place in the owner's range as a number of 64 bits, which rises with the key)."""
    high = (key >> 33) * owners
    return high >> 31, (high & 0x7FFFFFFF) << 33 | key & 0x1FFFFFFFF


class Builder:
    """The index of one owner. ``directory[p]`` is the bucket of the keys whose first ``depth`` bits are p; None once it is written."""

    def __init__(self, out, entries: int = BUCKET_ENTRIES, size: int = BUCKET_BYTES, owner: tuple[int, int] = (0, 1)):
        self.out, self.most, self.depth, self.owner = out, (entries, size), 0, owner
        self.directory: list[Bucket | None] = [Bucket(0, 0)]
        self.next, self.written, self.offset = 0, [], 0

    def insert(self, key: int, text: bytes, keep: int | None, n: int, digest: str, whole: int | None = None) -> None:
        """Keys (places in the owner's range) must not fall; ``whole`` is the key that pages hold."""
        bucket = self.directory[key >> (KEY_BITS - self.depth) if self.depth else 0]
        for entry in bucket.chains.get(key, ()):
            if entry[0] == text:
                entry[1] = _larger(entry[1], keep)
                entry[2] += n
                return
        bucket.add(key, [bytes(text), keep, n, digest, key if whole is None else whole])
        while bucket.overfull(*self.most):
            if bucket.depth == self.depth:
                self.directory = [b for b in self.directory for _ in (0, 1)]
                self.depth, self.next = self.depth + 1, self.next * 2
            halves, span = bucket.split(), 1 << (self.depth - bucket.depth - 1)
            for half in halves:
                self.directory[half.prefix * span : (half.prefix + 1) * span] = [half] * span
            bucket = max(halves, key=lambda b: b.entries)

    def finished(self, key: int | None) -> Iterator[tuple[int, int | None, int, str, int]]:
        """Writes the buckets that lie wholly below ``key`` (all, if None) and yields their entries, with their place in the chain."""
        stop = len(self.directory) if key is None else key >> (KEY_BITS - self.depth) if self.depth else 0
        while self.next < stop:
            bucket = self.directory[self.next]
            span = 1 << (self.depth - bucket.depth)
            if self.next + span > stop:  # the present key falls into it
                return
            if bucket.entries:
                page = bucket.page()
                self.out.write(page)
                self.written.append([bucket.prefix, bucket.depth, self.offset, len(page)])
                self.offset += len(page)
            self.directory[self.next : self.next + span] = [None] * span
            self.next += span
            for chain in bucket.chains.values():
                for place, (_, keep, n, digest, k) in enumerate(chain):
                    yield k, keep, n, digest, place

    def close(self) -> None:
        """The directory (for each place the number of its page, -1 if it has none), the pages' places and the owner, and their sizes."""
        directory = np.full(1 << self.depth, -1, np.int32)
        for i, (prefix, depth, _, _) in enumerate(self.written):
            span = 1 << (self.depth - depth)
            directory[prefix * span : (prefix + 1) * span] = i
        tail = json.dumps({"depth": self.depth, "owner": self.owner, "pages": [w[2:] for w in self.written]}).encode()
        packed = directory.tobytes()
        self.out.write(packed + tail + struct.pack("<QQ", len(packed), len(tail)))


class Index:
    """The files of all owners, read by ranges: the directory first, then the one page that may hold a key."""

    def __init__(self, files: list[str]):
        self.owners, self.files = 1, {}
        for f in files:
            fs, path = store(f)
            with fs.open_input_file(path) as src:
                end = src.size()
                packed, n = struct.unpack("<QQ", src.read_at(16, end - 16))
                tail = json.loads(src.read_at(n, end - 16 - n))
                directory = np.frombuffer(src.read_at(packed, end - 16 - n - packed), np.int32)
            part, self.owners = tail["owner"]
            self.files[part] = fs, path, tail["depth"], directory, tail["pages"]

    def page_of(self, key: int) -> tuple | None:
        """(file system, path, offset, length) of the page of a key, by one look into the directory; None if no key lies there."""
        part, place = owner_of(key, self.owners)
        if part not in self.files:
            return None
        fs, path, depth, directory, pages = self.files[part]
        number = int(directory[place >> (KEY_BITS - depth) if depth else 0])
        return (fs, path, *pages[number]) if number >= 0 else None

    def find(self, text: bytes) -> tuple[int | None, int] | None:
        """(keep id, group size) of a text, or None; ``text`` is already lower-cased."""
        import xxhash

        key = xxhash.xxh64(text, seed=42).intdigest()
        at = self.page_of(key)
        if at:
            fs, path, offset, length = at
            with fs.open_input_file(path) as src:
                for k, keep, n, own in read_page(src.read_at(length, offset)):
                    if k == key and own == text:
                        return keep, n
        return None


FOLDED = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("body", pa.binary())])
OWNED = pa.schema([("key", pa.int64()), ("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("place", pa.int32()), ("file", pa.string())])


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a task, with its largest id and count: texts are held up to HELD bytes; beyond that those seen once go on, or else all."""
    held: dict[int, list[list]] = {}  # key -> [text, part, digest, keep, n] of each text with it
    size = 0

    def out(rows: list[tuple[int, list]]) -> pa.RecordBatch:
        columns = {"part": [e[1] for _, e in rows], "key": [k for k, _ in rows], "keep_id": [e[3] for _, e in rows], "n": [e[4] for _, e in rows], "digest": [e[2] for _, e in rows], "body": [e[0] for _, e in rows]}
        return record_batch(columns, FOLDED)

    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("key", "part", "digest", "doc_id"))
        for text, key, part, digest, doc in zip(blobs(b, "body"), *columns, strict=True):
            chain = held.setdefault(key, [])
            for e in chain:
                if e[0] == text:
                    e[3], e[4] = _larger(e[3], doc), e[4] + 1
                    break
            else:
                chain.append([bytes(text), part, digest, doc, 1])
                size += len(text) + 200
            if size > HELD:
                all_ = [(k, e) for k, chain in held.items() for e in chain]
                once = [(k, e) for k, e in all_ if e[4] == 1]
                go = once if sum(len(e[0]) + 200 for _, e in once) > size // 2 else all_
                yield out(go)
                pa.default_memory_pool().release_unused()
                held = {}
                for k, e in all_ if go is once else ():
                    if e[4] > 1:
                        held.setdefault(k, []).append(e)
                size = sum(len(e[0]) + 200 for chain in held.values() for e in chain)
    rows = [(k, e) for k, chain in held.items() for e in chain]
    if rows:
        yield out(rows)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with key and digest of its normalised text."""
    body = F.encode(low(F.coalesce("text", F.lit(""))), "UTF-8")
    return docs.withColumns({"body": body}).withColumns({"key": F.xxhash64("body"), "digest": F.sha2("body", 256)})


def index(docs: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """Builds the index; one row for each text: key, digest, keep_id, group_size, place in its chain, file of its page."""
    n, root = partitions(spark), scratch.path("index")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(f"{root}/{uuid.uuid4().hex}.xh")  # a lost task's file is never read: the rows name the files
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            builder, rows = None, []

            def told() -> pa.RecordBatch:
                k, keep, size, digest, place = zip(*rows, strict=True)
                return record_batch({"key": np.array(k, np.uint64).view(np.int64), "keep_id": list(keep), "group_size": list(size), "digest": list(digest), "place": list(place), "file": [path] * len(rows)}, OWNED)

            for b in batches:
                keys = np.asarray(b.column("key")).view(np.uint64).tolist()
                for key, text, keep, size, digest in zip(keys, blobs(b, "body"), b.column("keep_id").to_pylist(), b.column("n").to_pylist(), b.column("digest").to_pylist(), strict=True):
                    part, place = owner_of(key, n)
                    builder = builder or Builder(out, owner=(part, n))
                    rows += builder.finished(place)
                    builder.insert(place, text, keep, size, digest, key)
                if rows:
                    yield told()
                    rows = []
            if builder:
                rows += builder.finished(None)
                builder.close()
            if rows:
                yield told()

    owner = F.shiftright(F.shiftrightunsigned("key", 33) * n, 31).cast("int")
    folded = keyed(docs).select(owner.alias("part"), "key", "doc_id", "digest", "body").mapInArrow(_fold, "part int, key bigint, keep_id bigint, n bigint, digest string, body binary")
    # signed order within an owner's range is unsigned order: no range but the middle one spans the sign, and the flipped bit mends it
    dealt = deal(folded, n).sortWithinPartitions(F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return scratch.table(dealt.mapInArrow(own, "key bigint, digest string, keep_id bigint, group_size bigint, place int, file string"), "owned")


def dedup(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows that stay: of equal texts the one with the largest doc_id."""
    scratch = Scratch(spark, "exact")
    kept = index(docs.select("doc_id", "text"), spark, scratch).select(F.col("key").alias("k"), F.col("digest").alias("d"), "keep_id")
    both = keyed(docs.select(F.struct(*docs.columns).alias("row")).select("row", "row.doc_id", "row.text")).drop("body", "text")
    # by id too, so that a hot text's rows lie apart; rows that repeat both become one where they are read
    both = both.join(kept.hint("merge"), (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return both.groupBy("key", "digest", "doc_id").agg(F.any_value("row").alias("row")).select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``documents``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scratch = Scratch(spark, "op3")
    owned = index(docs, spark, scratch).select("key", "digest", "keep_id", "group_size")
    rows = keyed(docs).select("doc_id", "key", "digest")
    rows = scratch.table(rows.withColumn("again", F.row_number().over(W.partitionBy("doc_id", "key").orderBy("key"))), "rows")
    both = with_class(rows, owned, ["key", "digest"], "group_size", spark)
    return both.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
window w as (partition by t)
"""
