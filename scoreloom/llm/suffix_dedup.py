"""Suffix-array dedup by a depth-limited radix sort.

The suffixes of all texts, as bytes, are ordered only through THRESHOLD bytes, by most-significant-digit passes: groups that
still hold together after the last pass are exactly the repeated windows. What a pass leaves alone in its group is done.

The first digit of a window is the 32-byte gram in it with the least hash (the leftmost of equals). Equal windows have it at the same
place, and a run of neighbouring windows shares one, so the first pass moves one entry a run, about one for 35 bytes, not one a suffix; the
hash deals the entries and nothing more. Runs whose gram another run has send their bytes. Bytes alone decide from there: MSD passes over
whole runs, eight bytes a digit, leave groups of equal runs, of which all but the earliest lose every window; only where a gram has
different runs left, passes over their single suffixes up to the threshold find what else is equal. A map task folds equal runs of
a pack beforehand, in the same way.

Texts travel as compressed packs of whole documents; messages for a pack (ranges to remove, runs whose bytes are wanted) are joined to it.

Defined cases: null is the empty text; texts below the threshold lose nothing; rows that repeat a doc_id count as one document, of
which only an earlier start precedes; a null doc_id comes last; very long texts are cut into segments that overlap, for hashing alone; an
empty table gives no rows; extra columns are ignored. A gram that occurs in very many different surroundings meets in one task.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, deal, documents, joined_bytes, mixed, partitions, record_batch, slices, small_batches

THRESHOLD, GRAM = 100, 32
SPAN = THRESHOLD - GRAM + 1
PACK = 1 << 20
#: Arrow batches hold a pack or two: what the JVM allocates for larger ones beside its heap it gives back late.
BATCH = 1 << 20
SEGMENT = 1 << 20
#: Windows that a task sorts at once, runs that it folds at once, and bytes of packs for each part.
SORTED, FOLDED, PART = 400_000, 8_000, 48 << 20
BASE = 0x2545F4914F6CDD1D
TABLE = np.random.default_rng(6).integers(0, 1 << 64, 256, np.uint64)
LAST = (1 << 63) - 1

RUN = np.dtype([("gram", "u8"), ("lo", "u4"), ("idx", "u4"), ("span", "u1"), ("off", "u1")])
GONE = np.dtype([("idx", "u4"), ("lo", "u4"), ("hi", "u4")])


class Powers:
    """Powers of BASE and of its inverse, modulo 2^64; made once a worker."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            make = lambda b: np.r_[np.uint64(1), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)]
            cls.up, cls.down = make(BASE), make(pow(BASE, -1, 1 << 64))
        return cls.up[:n], cls.down[:n]


def runs(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The runs of windows that share a least gram: idx (of the text), lo (first start), span (last start less the first), off (of the gram from lo)."""
    out = [np.zeros(0, RUN)]
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for a in range(0, len(flat), SEGMENT):
        part = flat[a : a + SEGMENT + THRESHOLD - 1]
        n = len(part)
        if n < THRESHOLD:
            break
        up, down = Powers.get(SEGMENT + THRESHOLD)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[part] * up[:n], out=sums[1:])
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        least, width = np.arange(len(gram), dtype=np.int32), 1
        while width < SPAN:
            step = min(width, SPAN - width)
            left, right = least[:-step], least[step:]
            least, width = np.where(gram[left] <= gram[right], left, right), width + step
        doc = text[a : a + len(least)]
        start = np.flatnonzero(np.arange(a, a + len(least)) + THRESHOLD <= bounds[doc + 1])
        if not len(start):
            continue
        at, doc = least[start], doc[start]
        cut = np.flatnonzero((at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(start)] - 1
        lo, hi, at, doc = start[first], start[last], at[first], doc[first]
        r = np.zeros(len(lo), RUN)
        # hashed once more: the least of many hashes are small, and parts are ranges of this value
        r["gram"], r["idx"], r["lo"], r["span"], r["off"] = mixed(gram[at] + np.uint64(BASE)), doc, a + lo - bounds[doc], hi - lo, at - lo
        out.append(r)
    return np.concatenate(out)


def gone(r: np.ndarray) -> np.ndarray:
    """All bytes that the windows of runs cover."""
    out = np.zeros(len(r), GONE)
    out["idx"], out["lo"] = r["idx"], r["lo"]
    out["hi"] = r["lo"] + r["span"].astype(np.uint32) + np.uint32(THRESHOLD)
    return out


def passes(group: np.ndarray, digit, depths) -> tuple[np.ndarray, np.ndarray]:
    """MSD passes: (members of ``group`` that are not alone after the last, the group of each); ``digit(members, depth)`` gives their next digits."""
    live, group = np.arange(len(group)), np.asarray(group)
    for depth in (None, *depths):
        d = np.zeros(len(live), np.uint64) if depth is None else digit(live, depth)
        order = np.lexsort((d, group))
        d, g = d[order], group[order]
        change = np.ones(len(live), bool)
        change[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        alone = change.copy()
        alone[:-1] &= change[1:]
        live, group = live[order[~alone]], np.cumsum(change)[~alone]
        if not len(live):
            break
    return live, group


def numbered(*keys: np.ndarray) -> np.ndarray:
    """Equal rows of keys as equal numbers."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change)
    return out


def digits(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs, eight a column, the last filled with zeros."""
    step = np.arange(-(-int(size.max(initial=1)) // 8) * 8)
    place = at[:, None] + step[None]
    body = np.where(step[None] < size[:, None], flat[np.minimum(place, len(flat) - 1)], np.uint8(0))
    return body.view(">u8").astype(np.uint64)


def folded(r: np.ndarray, doc: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which runs repeat an earlier one byte by byte; ``r`` comes in the order of gram, document and start, its bytes begin at ``at``."""
    later, carry, a = np.zeros(len(r), bool), np.zeros(0, np.int64), 0
    while a < len(r):
        z = min(a + FOLDED, len(r))
        mine = np.r_[carry, np.arange(a, z)]
        s = r[mine]
        body = digits(flat, at[mine], s["span"].astype(np.int64) + THRESHOLD)
        live, group = passes(numbered(s["gram"], s["span"], s["off"]), lambda members, k, body=body: body[members, k], range(body.shape[1]))
        order = np.lexsort((live, group))
        g, x = group[order], mine[live[order]]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        head = x[np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))]
        later[x[(doc[x] != doc[head]) | (r["lo"][x] != r["lo"][head])]] = True
        carry = mine[(s["gram"] == r["gram"][z - 1]) & ~later[mine]]
        a = z
    return later


def twins(gram: np.ndarray) -> np.ndarray:
    """Which of sorted grams occur more than once."""
    out = np.zeros(len(gram), bool)
    out[1:] = gram[1:] == gram[:-1]
    out[:-1] |= out[1:]
    return out


MESSAGE = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("kind", pa.string()), ("body", pa.binary())])
MESSAGE_SQL = "part int, pack bigint, kind string, body binary"


def squeezed(r: np.ndarray) -> bytes:
    """Runs as compressed columns, grams as steps: small where they come in the order of gram."""
    columns = [np.diff(r["gram"], prepend=np.uint64(0)), *[np.ascontiguousarray(r[f]) for f in RUN.names[1:]]]
    raw = b"".join(c.tobytes() for c in columns)
    return struct.pack("<I", len(r)) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def restored(body: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", body)[0]
    out = np.zeros(n, RUN)
    if n:
        raw, at = pa.decompress(body[4:], n * RUN.itemsize, codec="zstd", asbytes=True), 0
        for f in RUN.names:
            out[f] = np.frombuffer(raw, RUN[f], n, at)
            at += n * RUN[f].itemsize
        out["gram"] = np.cumsum(out["gram"], dtype=np.uint64)
    return out


def parts_of(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int32)


def by_part(records: np.ndarray, n: int, pack: int, kind: str) -> list[tuple]:
    """Messages with the records of each part; records come in the order of gram."""
    parts = parts_of(records["gram"], n)
    cuts = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)]
    return [(int(parts[a]), pack, kind, squeezed(records[a:z])) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]


def messages(rows: list[tuple]) -> pa.RecordBatch:
    return record_batch({k: [r[i] for r in rows] for i, k in enumerate(MESSAGE.names)}, MESSAGE)


def harder(raw: bytes) -> bytes:
    """A pack's bytes, which are written once and move twice."""
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def pack(docs: DataFrame) -> DataFrame:
    """pack, ids, bounds, body: texts of some documents, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", PACK)):
            flat, bounds = joined_bytes(b, "text")
            body = struct.pack("<Q", len(flat)) + (harder(flat.tobytes()) if len(flat) else b"")
            ids = np.array([LAST if i is None else i for i in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([bounds.tobytes()], pa.binary()), pa.array([body], pa.binary())], names=["pack", "ids", "bounds", "body"])

    return docs.select("doc_id", "text").mapInArrow(run, "pack bigint, ids binary, bounds binary, body binary")


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """(pack, ids, bounds, bytes, the row's other columns) of each pack."""
    for i in range(b.num_rows):
        row = {n: b.column(n)[i].as_py() for n in b.schema.names}
        size = struct.unpack_from("<Q", row["body"])[0]
        raw = pa.decompress(row["body"][8:], size, codec="zstd", asbytes=True) if size else b""
        yield row["pack"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64), np.frombuffer(raw, np.uint8), row


def by_pack(kind: str, records: np.ndarray, packs: np.ndarray) -> list[tuple]:
    """Messages with the records of each pack."""
    order = np.argsort(packs, kind="stable")
    p = packs[order]
    cuts = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)]
    body = squeezed if records.dtype == RUN else np.ndarray.tobytes
    return [(0, int(p[a]), kind, body(records[order[a:z]])) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]


def first_pass(packs: DataFrame, n: int) -> DataFrame:
    """The runs of all packs, as messages to the part of their gram; repeats within a pack become ranges to remove at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ids, bounds, flat, _ in unpacked(b):
                r = runs(flat, bounds)
                if len(r):
                    r = r[np.lexsort((r["lo"], ids[r["idx"]], r["gram"]))]
                    twin = np.flatnonzero(twins(r["gram"]))
                    later = np.zeros(len(r), bool)
                    later[twin] = folded(r[twin], ids[r["idx"][twin]], bounds[r["idx"][twin]] + r["lo"][twin], flat)
                    rows = by_part(r[~later], n, name, "run")
                    if later.any():
                        rows.append((name % n, name, "gone", gone(r[later]).tobytes()))
                    yield messages(rows)

    return packs.select("pack", "ids", "bounds", "body").mapInArrow(run, MESSAGE_SQL)


def second_pass(dealt: DataFrame) -> DataFrame:
    """By gram: runs that are alone with theirs are done; the others' bytes are wanted of their packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, packs, rows = [np.zeros(0, RUN)], [np.zeros(0, np.int64)], []
        for b in batches:
            for pack_, kind, body in zip(b.column("pack").to_pylist(), b.column("kind").to_pylist(), b.column("body").to_pylist(), strict=True):
                if kind == "run":
                    all_.append(restored(body))
                    packs.append(np.full(len(all_[-1]), pack_))
                else:
                    rows.append((0, pack_, kind, body))
        r, p = np.concatenate(all_), np.concatenate(packs)
        del all_, packs
        order = np.argsort(r["gram"], kind="stable")
        order = order[twins(r["gram"][order])]
        rows += by_pack("want", r[order], p[order])
        if rows:
            yield messages(rows)

    return dealt.mapInArrow(run, MESSAGE_SQL)


def third_pass(wanted: DataFrame, n: int) -> DataFrame:
    """The bytes of the wanted runs, as messages to the part of their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ids, bounds, flat, row in unpacked(b):
                w = np.sort(np.concatenate([restored(x) for x in row["bodies"]]), order=["gram", "idx", "lo"])
                parts = parts_of(w["gram"], n)
                cuts, rows = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)], []
                raw = flat.tobytes()
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    mine = w[a:z]
                    at = bounds[mine["idx"]] + mine["lo"]
                    texts = b"".join(raw[i : i + s + THRESHOLD] for i, s in zip(at.tolist(), mine["span"].tolist(), strict=True))
                    pieces = [squeezed(mine), *[pa.compress(x, codec="zstd", asbytes=True) for x in (ids[mine["idx"]].tobytes(), texts)]]
                    rows.append((int(parts[a]), name, "text", struct.pack("<IIQ", *map(len, pieces[:2]), len(texts)) + b"".join(pieces)))
                yield messages(rows)

    return wanted.mapInArrow(run, MESSAGE_SQL)


def repeated(words: np.ndarray, start: np.ndarray, gram: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that equal another through the threshold, and the group of each.

    ``words[i]`` has the eight bytes at i; suffixes begin at ``start``. Groups begin as equal gram and offset of it.
    """
    return passes(numbered(gram, off), lambda members, depth: words[start[members] + depth], [*range(0, THRESHOLD - 7, 8), THRESHOLD - 8])


def last_pass(dealt: DataFrame) -> DataFrame:
    """By gram: the windows among the wanted runs that an earlier one equals, as ranges to remove."""

    def sort(w: np.ndarray, doc: np.ndarray, packs: np.ndarray, at: np.ndarray, words: np.ndarray) -> list[tuple]:
        n = w["span"].astype(np.int64) + 1
        owner = np.repeat(np.arange(len(w)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        live, group = repeated(words, at[owner] + step, w["gram"][owner], w["off"][owner].astype(np.int64) - step)
        if not len(live):
            return []
        o, s = owner[live], w["lo"][owner[live]].astype(np.int64) + step[live]
        order = np.lexsort((s, doc[o], group))
        o, s, g = o[order], s[order], group[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        late = np.flatnonzero((doc[o] != doc[o[head]]) | (s != s[head]))
        order = late[np.lexsort((s[late], w["idx"][o[late]], packs[o[late]]))]
        o, s = o[order], s[order]
        if not len(o):
            return []
        # neighbouring starts make one range
        cut = np.ones(len(o), bool)
        cut[1:] = (packs[o][1:] != packs[o][:-1]) | (w["idx"][o][1:] != w["idx"][o][:-1]) | (s[1:] > s[:-1] + 1)
        begin = np.flatnonzero(cut)
        end = np.r_[begin[1:], len(o)] - 1
        out = np.zeros(len(begin), GONE)
        out["idx"], out["lo"], out["hi"] = w["idx"][o[begin]], s[begin], s[end] + THRESHOLD
        return by_pack("gone", out, packs[o[begin]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, docs, packs, texts = [np.zeros(0, RUN)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for b in batches:
            for name, body in zip(b.column("pack").to_pylist(), b.column("body").to_pylist(), strict=True):
                heads, owners, size = struct.unpack_from("<IIQ", body)
                a, z = 16 + heads, 16 + heads + owners
                ws.append(restored(body[16:a]))
                docs.append(np.frombuffer(pa.decompress(body[a:z], 8 * len(ws[-1]), codec="zstd", asbytes=True), np.int64))
                packs.append(np.full(len(ws[-1]), name))
                texts.append(pa.decompress(body[z:], size, codec="zstd", asbytes=True))
        w, doc, pk, flat = np.concatenate(ws), np.concatenate(docs), np.concatenate(packs), np.frombuffer(b"".join(texts), np.uint8)
        del ws, docs, packs, texts
        size = w["span"].astype(np.int64) + THRESHOLD
        at = np.cumsum(size) - size
        order = np.lexsort((w["lo"], doc, w["gram"]))
        later = folded(w[order], doc[order], at[order], flat)
        rows = by_pack("gone", gone(w[order[later]]), pk[order[later]])
        # what is left of a gram is one run, or runs of different bytes
        order = order[~later]
        order = order[twins(w["gram"][order])]
        if rows:
            yield messages(rows)
        g = w["gram"][order]
        ends = np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        windows = np.cumsum(w["span"][order].astype(np.int64) + 1)
        a = 0
        while a < len(order):  # whole gram groups, about SORTED windows at a time
            base = windows[a - 1] if a else 0
            k = max(np.searchsorted(windows[ends - 1], base + SORTED, side="right") - 1, np.searchsorted(ends, a, side="right"))
            z = int(ends[min(k, len(ends) - 1)])
            mine = order[a:z]
            sizes = size[mine]
            piece = flat[np.repeat(at[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))].astype(np.uint64)
            two = piece[:-1] << np.uint64(8) | piece[1:]
            four = two[:-2] << np.uint64(16) | two[2:]
            words = four[:-4] << np.uint64(32) | four[4:]
            rows = sort(w[mine], doc[mine], pk[mine], np.cumsum(sizes) - sizes, words)
            if rows:
                yield messages(rows)
            a = z

    return dealt.mapInArrow(run, MESSAGE_SQL)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def removed(packs: DataFrame, ranges: DataFrame, text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, if ``text``) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ids, bounds, flat, row in unpacked(b):
                out: dict[str, list] = {f.name: [] for f in OUT}
                g = np.sort(np.frombuffer(b"".join(row["bodies"] or []), GONE), order=["idx", "lo"])
                first = np.searchsorted(g["idx"], np.arange(len(ids) + 1))
                for i, doc in enumerate(ids.tolist()):
                    whole, at, spans, cut, kept = flat[bounds[i] : bounds[i + 1]].tobytes(), 0, 0, 0, []
                    for lo, hi in zip(g["lo"][first[i] : first[i + 1]].tolist(), g["hi"][first[i] : first[i + 1]].tolist(), strict=True):
                        if lo > at or not spans:
                            kept.append(whole[at:lo])
                            spans += 1
                            cut += hi - lo
                            at = hi
                        elif hi > at:
                            cut += hi - at
                            at = hi
                    kept.append(whole[at:])
                    left = b"".join(kept)
                    for k, v in zip(out, (None if doc == LAST else doc, len(whole), cut, spans, hashlib.sha256(left).hexdigest(), left if text else None), strict=True):
                        out[k].append(v)
                yield record_batch(out, OUT)

    bodies = ranges.groupBy("pack").agg(F.collect_list("body").alias("bodies"))
    rows = packs.join(bodies.hint("shuffle_hash"), "pack", "left")  # packs are large to sort; their messages are bounded by a part
    rows = rows.select("pack", "ids", "bounds", "body", "bodies")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, spark: SparkSession, text: bool = True) -> DataFrame:
    """Every document without its repeated windows."""
    scratch = Scratch(spark, "suffix")
    small_batches(spark, BATCH)
    packs = scratch.table(pack(docs), "packs")
    n = max(partitions(spark), packs.count() * PACK // PART)  # so that what a part holds does not grow with the data
    told = scratch.table(second_pass(deal(first_pass(packs, n), n)), "told")
    scratch.release()
    # a pack is wanted by its own runs only: the list is bounded by the pack
    bodies = told.where("kind = 'want'").groupBy("pack").agg(F.collect_list("body").alias("bodies"))
    wanted = packs.join(bodies.hint("shuffle_hash"), "pack").select("pack", "ids", "bounds", "body", "bodies")
    late = scratch.table(last_pass(deal(third_pass(wanted, n), n)), "late")
    scratch.release()
    return removed(packs, told.where("kind = 'gone'").unionByName(late), text)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``documents``."""
    return dedup(documents(spark, sf_dir), spark, text=False).drop("kept")
