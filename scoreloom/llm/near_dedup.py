"""MinHash near-dedup with an LSH forest: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Documents with the same set are one class, of which one member goes on. Each class has TREES signatures of DEPTH digits, minima of
independent hash functions. For each tree the classes are put in the order of their signatures (a range-partitioned sort), so that those
with the longest common prefixes are neighbours. A region is a run of classes that share the first ROOT digits. A region of at most MOST classes is one
block; a larger one is cut into blocks of neighbours, each time where the common prefix is shortest (adaptive depth), and its classes are
marked as cut. So are the first and the last region of a partition, for they may go on in the next one. A block never exceeds MOST classes, and
sorting is the only thing that meets a hot region whole; ties in the order go by id, so ranges split even equal signatures.

1. In the blocks of FIRST trees pairs whose signatures agree on ESTIMATE of their digits or more are tried on full sets; connected components follow.
2. So are pairs between components in those blocks of the other trees in which components meet.
3. Classes marked as cut are completed by a prefix-filter join over these classes alone: each has its rarest shingles as keys, as many as leave no pair of 0.8
without a common one, and members of a key that are of different components after step 2 are compared, with bounds on size and position: what a pair has in
common begins at its first common key, so what follows that key in both must do. Members of a key that no other one's size lets reach 0.8 leave it beforehand.
The largest component of a key is only compared with the rest, in tiles of LOT by LOT classes, so a group of near copies costs in proportion to its size.

Recall: a pair at 0.8 exactly shares no region in any of 16 trees with probability (1 - 0.8^4)^16 = 0.0002, and has fewer than ESTIMATE equal digits with
probability 0.00002; pairs in regions that are cut, however they are cut, all come to step 3 (which leaves out pairs with under SURE equal digits: 1e-11).
Sets are sets of 64-bit shingle hashes: two shingles of a pair of documents of 10,000 words are mistaken for one with probability 5e-12.

Rows without words (null and empty texts too) have an empty set and are linked with nothing. Equal rows, and rows with a null doc_id, count like others:
classes are told apart by doc_id and set, and a null doc_id comes after all others. Very long texts are held one at a time, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, documents, joined_bytes, mixed, partitions, record_batch, slices, with_class

TREES, ROOT, DEPTH = 16, 4, 7
MOST, FIRST, ESTIMATE = 128, 2, 0.64
#: Of step 3: members of a side of a tile, the least share of equal digits, and bits of a shingle that count its frequency.
LOT, SURE, COUNTED = 1024, 0.5, 18
#: Rows of a tile that are held against all its rows at once.
ROWS = 256
#: Links that one task of ``components`` holds.
HELD = 1 << 20
#: Similarity as a share: 100 * intersection >= 80 * union.
SHARE = (80, 100)
SLICE = 2 << 20

_RNG = np.random.default_rng(20)
TABLE, MUL, XOR = (_RNG.integers(0, 1 << 64, n, np.uint64) for n in (256, TREES * DEPTH, TREES * DEPTH))
MUL |= np.uint64(1)
SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_hashes(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its document) of texts laid end to end."""
    inside = ~SEPARATOR[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letters = np.flatnonzero(inside)
    first = np.searchsorted(letters, starts)
    lengths = np.diff(np.r_[first, len(letters)])
    place = letters - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = np.add.reduceat(TABLE[LOWER[flat[letters]]] * powers[place], first)
    return mixed(sums + lengths.astype(np.uint64)), np.searchsorted(bounds, starts, side="right") - 1


def shingle_sets(flat: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, as 64-bit hashes."""
    words, doc = word_hashes(flat, bounds)
    first = np.searchsorted(doc, np.arange(len(bounds)))
    h = words.copy()
    for i in range(1, k):
        h = mixed(h[: len(words) - i] * np.uint64(0xC2B2AE3D27D4EB4F) + words[i:]) if len(words) > i else h[:0]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:  # too few words: the sequence as a whole
            one = words[a : a + 1]
            for i in range(a + 1, b):
                one = mixed(one * np.uint64(0x165667B19E3779F9) + words[i : i + 1])
            out.append(mixed(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH 16-bit digits for each non-empty set."""
    x = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    for p in range(TREES * DEPTH):
        low = np.minimum.reduceat(((x ^ XOR[p]) * MUL[p]) >> np.uint64(32), at)
        out[:, p] = mixed(low) >> np.uint64(48)
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


#: An id orders classes by doc_id (null last) and tells those of one doc_id apart: 9 bytes of doc_id, then the digest of the set.
ID_BYTES = 9


def ids(doc_id: pa.Array, digests: list[bytes | None]) -> list[bytes | None]:
    values = np.asarray(doc_id.cast(pa.int64()).fill_null(0), np.int64)
    packed = (values.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes()
    last = bytes([1] + [0] * 8)
    return [
        None if d is None else (last if null else b"\0" + packed[8 * i : 8 * i + 8]) + d
        for i, (d, null) in enumerate(zip(digests, doc_id.is_null().to_pylist(), strict=True))
    ]


def doc_of(id_: F.Column) -> F.Column:
    """The doc_id in an id."""
    ordered = F.conv(F.hex(F.substring(id_, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(id_, 1, 1)) == "00", ordered.cast("bigint"))


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.binary()), ("digest", pa.binary()), ("sig", pa.binary())])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), id, digest of the set, sig and what else ``docs`` has; id, digest and sig are null for an empty set."""
    more = [f for f in docs.schema if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            sets = shingle_sets(*joined_bytes(b, "text"), k)
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full) if full else ())
            digests = [digest(s) if len(s) else None for s in sets]
            out = {"doc_id": b.column("doc_id"), "n": [len(s) for s in sets], "id": ids(b.column("doc_id"), digests), "digest": digests, "sig": [next(sigs).tobytes() if len(s) else None for s in sets]}
            out = record_batch(out, SIGNED)
            yield pa.RecordBatch.from_arrays([*out.columns, *[b.column(f.name) for f in more]], names=[*out.schema.names, *[f.name for f in more]])

    schema = "doc_id bigint, n bigint, id binary, digest binary, sig binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return docs.mapInArrow(run, schema)


MEMBER = "id binary, n bigint, sig binary, set binary"


def sets_of(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """id, n, sig, set (its hashes, packed) of the classes in ``needed`` (id, n, sig; an id names a member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            sets = shingle_sets(*joined_bytes(b, "text"), k)
            own = [i for i, (d, s) in enumerate(zip(b.column("id").to_pylist(), sets, strict=True)) if len(s) and digest(s) == d[ID_BYTES:]]
            if own:
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("id", "n", "sig")], pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["id", "n", "sig", "set"])

    needed = needed.withColumn("doc", doc_of(F.col("id")))
    both = docs.select("doc_id", "text").join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc")))
    return both.select("id", "n", "sig", "text").mapInArrow(run, MEMBER)


def _same_region(tree: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Where a row of the order lies in the same region as the row before it (false for the first)."""
    same = np.zeros(len(tree), bool)
    same[1:] = (tree[1:] == tree[:-1]) & (root[1:] == root[:-1])
    return same


def cut_points(keys: np.ndarray, most: int) -> list[int]:
    """Where a region in the order of ``keys`` (rows of digits) is cut, so that no block has more than ``most`` rows: where neighbours have least in common."""
    common = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    at, out = 0, []
    while len(keys) - at > most:
        low = at + max(1, most // 2)
        span = common[low - 1 : at + most]
        at = low + int(len(span) - 1 - np.argmin(span[::-1]))
        out.append(at)
    return out


BLOCKS = "block bigint, tree int, id binary, cut boolean"


def neighbourhoods(ordered: DataFrame, most: int) -> DataFrame:
    """block, tree, id, cut: the blocks of neighbours of each tree. ``ordered``: tree, key, id, in this order within ranges of it.

    A class that is alone in its region has no row, unless the region touches the edge of a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        salt = mixed(np.array([number + 1], np.uint64))[0]
        made = 0  # blocks of cut regions so far

        def rows(t: pa.Table, block: np.ndarray, cut: bool) -> pa.RecordBatch:
            columns = [pa.array(block.view(np.int64)), t.column("tree").combine_chunks(), t.column("id").combine_chunks(), pa.array(np.full(t.num_rows, cut))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "tree", "id", "cut"])

        def cut_region(t: pa.Table, keys: np.ndarray, whole: bool) -> tuple[list[pa.RecordBatch], int]:
            """Blocks of a region that is cut, and how many of its rows are in them; the last rows wait if the region goes on."""
            nonlocal made
            points = cut_points(keys, most)
            ends = [*points, t.num_rows] if whole else points
            out, at = [], 0
            for end in ends:
                made += 1
                out.append(rows(t.slice(at, end - at), np.full(end - at, mixed(np.array([made], np.uint64) + salt)[0]), True))
                at = end
            return out, at

        rest, going, first = None, False, True
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            keys, tree, root = digits_of(t)
            starts = np.flatnonzero(~_same_region(tree, root))
            last = int(starts[-1])
            # regions that are whole: all but the last one
            sizes = np.diff(starts)
            large = sizes > most
            if len(sizes) and (first or going):
                large[0] = True
            small = np.repeat((sizes > 1) & ~large, sizes)
            if small.any():
                block = mixed(root[:last][small] + mixed(tree[:last][small].astype(np.uint64)) + salt)
                yield rows(t.slice(0, last).filter(pa.array(small)), block, False)
            for i in np.flatnonzero(large):
                a, z = int(starts[i]), int(starts[i + 1])
                yield from cut_region(t.slice(a, z - a), keys[a:z], True)[0]
            if len(sizes):
                first = going = False
            rest = t.slice(last)
            if rest.num_rows > 2 * most:
                blocks, used = cut_region(rest, keys[last:], False)
                yield from blocks
                rest, going = rest.slice(used), True
        if rest is not None and rest.num_rows:
            yield from cut_region(rest, digits_of(rest)[0], True)[0]

    return ordered.select("tree", "key", "id").mapInArrow(run, BLOCKS)


def digits_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digits, tree, first ROOT digits as a number) of rows of the order."""
    keys = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint16).reshape(t.num_rows, DEPTH)
    root = np.ascontiguousarray(keys[:, :ROOT]).view(np.uint64).reshape(-1)
    return keys, np.asarray(t.column("tree").combine_chunks(), np.int64), root


def in_order(nodes: DataFrame, spark: SparkSession) -> DataFrame:
    """tree, key, id of every class in every tree, sorted by signature over all partitions."""
    key = F.substring(F.col("sig"), (2 * DEPTH * F.col("tree") + 1).cast("int"), F.lit(2 * DEPTH))
    rows = nodes.select("id", "sig", F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("tree")).select("tree", key.alias("key"), "id")
    return rows.repartitionByRange(partitions(spark), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of rows in its order."""
    rest: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([*[x for r in rest for x in r.to_batches()], b])
        keys = np.asarray(t.column(key).combine_chunks() if t.num_rows else [])
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, z in zip([0, *cuts[:-1]], cuts, strict=False):
            yield t.slice(a, z - a)
        rest = [t.slice(int(cuts[-1]) if len(cuts) else 0)]
    for r in rest:
        if r.num_rows:
            yield r


def by_block(df: DataFrame, spark: SparkSession) -> DataFrame:
    return df.repartition(partitions(spark), "block").sortWithinPartitions("block", "id")


class Forest:
    """Union-find of the members of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def estimates(t: pa.Table, least: float, also: np.ndarray | bool = True) -> Iterator[tuple[int, int]]:
    """Pairs of members whose signatures agree on ``least`` of the digits or more and whose sizes (and ``also``) allow a link, best first."""
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1)
    n = np.asarray(t.column("n"))
    same = np.stack([(sig == s).sum(axis=1) for s in sig])
    fits = np.minimum(n[:, None], n[None]) * SHARE[1] >= SHARE[0] * np.maximum(n[:, None], n[None])
    i, j = np.nonzero(np.triu(fits & also & (same >= least * sig.shape[1]), 1))
    order = np.argsort(-same[i, j], kind="stable")
    return zip(i[order].tolist(), j[order].tolist(), strict=True)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common)


EDGES = "a binary, b binary"


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    """Equal values of a column as equal numbers."""
    seen: dict = {}
    return np.array([seen.setdefault(x, len(seen)) for x in t.column(column).to_pylist()])


def _across(least: float):
    """By block: links between members of different components, found on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "block"):
            labels, ids = _numbers(t, "label"), t.column("id").to_pylist()
            if labels.any():
                sets, forest, seen, out = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()], Forest(len(ids)), {}, []
                for i, label in enumerate(labels.tolist()):
                    forest.join(i, seen.setdefault(label, i))
                for i, j in estimates(t, least, labels[:, None] != labels[None]):
                    if forest.root(i) != forest.root(j) and similar(sets[i], sets[j]):
                        forest.join(i, j)
                        out.append((ids[i], ids[j]))
                if out:
                    yield _edges(out)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.frombuffer(b"".join(b.column("set").to_pylist()), np.uint64) >> np.uint64(64 - COUNTED)
        at, n = np.unique(x.astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])


def keys_of(sets: DataFrame) -> DataFrame:
    """key, id, label, n, place of each class: its rarest shingles, in one order for all; those that no other class can have are left out.

    How often a shingle occurs is counted by its first COUNTED bits, a table of a fixed size; any order gives the same links.
    """
    often = np.zeros(1 << COUNTED, np.int64)
    found = sets.select("set").mapInArrow(_counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    often[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    often = np.minimum(often, (1 << 31) - 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners, places = [], [], []
            for i, x in enumerate(b.column("set").to_pylist()):
                s = np.frombuffer(x, np.uint64)
                n = often[s >> np.uint64(64 - COUNTED)]
                place = np.lexsort((s, n))[: len(s) + SHARE[0] * -len(s) // SHARE[1] + 1]
                at = np.flatnonzero(n[place] > 1)
                keys.append(s[place[at]])
                owners.append(np.full(len(at), i))
                places.append(at)
            if keys:
                at = pa.array(np.concatenate(owners), pa.int64())
                columns = [pa.array(np.concatenate(keys).view(np.int64)), *[b.column(c).take(at) for c in ("id", "label", "n")], pa.array(np.concatenate(places), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "label", "n", "place"])

    return sets.select("id", "label", "n", "set").mapInArrow(run, "key bigint, id binary, label binary, n bigint, place bigint")


def _pairs(t: pa.Table) -> list[tuple[int, int]]:
    """Pairs of a tile that are to be tried on full sets, those with most equal digits first.

    All that a pair has in common lies at its first common key or after it. At a later one the same bound may leave the pair out, for it was tried at the first.
    """
    labels, side, n, place = _numbers(t, "label"), *(np.asarray(t.column(c)) for c in ("side", "n", "place"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1)
    one_side, left, found = (side == side[0]).all(), n - place, [np.zeros((0, 3), np.int64)]
    for a in range(0, t.num_rows, ROWS):
        z = slice(a, a + ROWS)
        fits = (labels[z, None] != labels[None]) & (sum(SHARE) * np.minimum(left[z, None], left[None]) >= SHARE[0] * (n[z, None] + n[None]))
        if not one_side:  # pairs of one side have a tile of their own
            fits &= side[z, None] != side[None]
        i, j = np.nonzero(np.triu(fits, a + 1))
        for b in range(0, len(i), 1 << 14):
            x, y = i[b : b + (1 << 14)] + a, j[b : b + (1 << 14)]
            same = (sig[x] == sig[y]).sum(axis=1)
            found.append(np.stack([-same, x, y], axis=1)[same >= SURE * sig.shape[1]])
    pairs = np.concatenate(found)
    return [(i, j) for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist()]


TILE = "block bigint, side int, id binary, place bigint"


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By tile: the members of some pair that is to be tried on full sets."""
    for t in groups(batches, "block"):
        if at := sorted({i for p in _pairs(t) for i in p}):
            names = ["block", "side", "id", "place"]
            yield pa.RecordBatch.from_arrays([t.column(c).take(pa.array(at)).combine_chunks() for c in names], names=names)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By tile: links between members of different components, found on full sets."""
    for t in groups(batches, "block"):
        ids, sets = t.column("id").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        forest, seen, out = Forest(len(ids)), {}, []
        for i, label in enumerate(_numbers(t, "label").tolist()):
            forest.join(i, seen.setdefault(label, i))
        for i, j in _pairs(t):
            if forest.root(i) != forest.root(j) and similar(sets[i], sets[j]):
                forest.join(i, j)
                out.append((ids[i], ids[j]))
        if out:
            yield _edges(out)


def reaching(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Of keys with members of different components those members that could reach SHARE with one as small as the key's smallest, all they have from the key on being common."""
    least = keys.groupBy("key").agg(F.min("n").alias("least"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "least")
    least = scratch.table(least, "least")
    fits = sum(SHARE) * (F.col("n") - F.col("place")) >= SHARE[0] * (F.col("n") + F.col("least"))
    return keys.join(least.hint("merge"), "key").where(fits).select(*keys.columns)


def tiles_of(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """block, side, id, label, n, place: each member of a key in the tiles in which it can meet members of other components.

    Members of a key's largest component (in lots of LOT) meet the lots of the rest; lots of the rest meet one another.
    """
    one = keys.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    of_key = one.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size")).where("size > top.n")
    lots = lambda n: F.ceil(n / LOT).cast("int")
    of_key = of_key.select("key", F.col("top.label").alias("top"), lots(F.col("top.n")).alias("tops"), lots(F.col("size") - F.col("top.n")).alias("others"))
    of_key = scratch.table(of_key, "met-keys")  # so that the join of a hot key stands alone and Spark can split it
    met = keys.join(of_key.hint("merge"), "key")
    lot = F.pmod(F.xxhash64("id"), F.when(F.col("label") == F.col("top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    met = met.withColumn("lot", lot).withColumn("is_top", F.col("label") == F.col("top"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    with_top = lambda top, other, side: F.struct(F.xxhash64("key", F.lit("top"), top, other).alias("block"), F.lit(side).alias("side"))
    tops = F.transform(each(F.col("others")), lambda o: with_top(F.col("lot"), o, -1))
    to_top = F.transform(each(F.col("tops")), lambda t: with_top(t, F.col("lot"), -2))
    to_others = F.transform(
        each(F.col("others")), lambda o: F.struct(F.xxhash64("key", F.lit("rest"), F.least("lot", o), F.greatest("lot", o)).alias("block"), F.col("lot").alias("side"))
    )
    tile = F.explode(F.when(F.col("is_top"), tops).otherwise(F.concat(to_top, to_others)))
    return met.select("id", "label", "n", "place", tile.alias("tile")).select("tile.block", "tile.side", "id", "label", "n", "place")


def completed(cut: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, spark: SparkSession) -> DataFrame:
    """Links between different components among the classes of ``cut``: a prefix-filter join."""
    named = cut.join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = scratch.table(named.join(sets.hint("merge"), "id"), "cut-sets")
    keys = scratch.table(reaching(scratch.table(keys_of(named), "all-keys"), scratch), "keys")
    tiles = scratch.table(tiles_of(keys, scratch), "laid").join(named.select("id", "sig").hint("merge"), "id")
    tiles = scratch.table(by_block(tiles, spark).mapInArrow(_tried, TILE), "tiles")
    full = tiles.join(named.hint("merge"), "id")
    return by_block(full.select("block", "side", "id", "label", "n", "place", "sig", "set"), spark).mapInArrow(_confirmed, EDGES)


STARS = "id binary, label binary"


def _contracted(held: int):
    """Links in lots of ``held`` at most: each id that has a smaller one in its component of the lot, and the smallest of them."""

    def stars(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(lot)
        both = pa.concat_arrays([*t.column(0).chunks, *t.column(1).chunks]).dictionary_encode()
        order = pc.sort_indices(both.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        codes = rank[np.asarray(both.indices)]
        a, b = codes[: t.num_rows], codes[t.num_rows :]
        label = np.arange(len(order))
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]
        names = both.dictionary.take(order)
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(label[own]))], names=["id", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, held):
                part = b.slice(at, held)
                if n + part.num_rows > held:
                    yield stars(lot)
                    lot, n = [], 0
                lot.append(part)
                n += part.num_rows
        if n:
            yield stars(lot)

    return run


def components(links: DataFrame, scratch: Scratch, name: str, held: int | None = None) -> DataFrame:
    """id, label (the least id reachable) of every class that has a link to a smaller one.

    Each task contracts its links to stars. Where that took one task it is the result. Else rounds follow: an id with several labels links these
    with one another, and labels jump to labels of their own, until neither happens.
    """
    held = held or HELD
    tasks = max(1, -(-links.count() // held))
    stars = scratch.table(links.coalesce(tasks).mapInArrow(_contracted(held), STARS), f"{name}-0")
    step = 0
    while tasks > 1:
        step += 1
        least = stars.groupBy("id").agg(F.min("label").alias("label"))
        least = scratch.table(least, f"{name}-least-{step}")
        others = stars.join(least.withColumnRenamed("label", "low").hint("merge"), "id").where("label <> low")
        others = scratch.table(others.select(F.col("label").alias("id"), F.col("low").alias("label")), f"{name}-others-{step}")
        jump = least.join(least.select(F.col("id").alias("label"), F.col("label").alias("lower")).hint("merge"), "label", "left")
        jump = scratch.table(jump.select("id", F.coalesce("lower", "label").alias("label"), F.col("lower").isNotNull().alias("moved")), f"{name}-jump-{step}")
        if others.isEmpty() and jump.where("moved").isEmpty():
            return least
        # an id keeps its link to the old label through the label's own row
        both = jump.select("id", "label").union(others)
        stars = scratch.table(both.mapInArrow(_contracted(held), STARS), f"{name}-{step}")
    return stars


def linked(docs: DataFrame, spark: SparkSession, k: int, name: str) -> DataFrame:
    """doc_id, n, id, label for every row of ``docs``, and its further columns but text: id is that of the row, label the least id of its component.

    Both are null for rows with an empty set.
    """
    scratch = Scratch(spark, name)
    rows = scratch.table(signed(docs, k), "signed")
    nodes = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "sig")).alias("x"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.table(nodes.select("digest", "x.id", "x.n", "x.sig", "copies"), "nodes")
    blocks = scratch.table(neighbourhoods(in_order(nodes, spark), MOST), "blocks")
    needed = nodes.select("id", "n", "sig").join(blocks.select("id").distinct().hint("merge"), "id", "left_semi")
    sets = scratch.table(sets_of(docs, needed, k), "sets")

    met = blocks.where(F.col("tree") < FIRST).select("block", "id").join(sets.hint("merge"), "id").withColumn("label", F.col("id"))
    links = scratch.table(by_block(met.select("block", "id", "label", "n", "sig", "set"), spark).mapInArrow(_across(ESTIMATE), EDGES), "links-1")
    labels = components(links, scratch, "components-1")

    # blocks of the other trees in which components meet
    met = blocks.where(F.col("tree") >= FIRST).select("block", "id").join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = scratch.table(met, "met")
    differ = own.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("block")
    met = own.join(differ.hint("merge"), "block", "left_semi").join(sets.hint("merge"), "id")
    links = scratch.table(by_block(met.select("block", "id", "label", "n", "sig", "set"), spark).mapInArrow(_across(ESTIMATE), EDGES), "links-2")
    labels = components(labels.union(links), scratch, "components-2")  # a label is a link too
    cut = scratch.table(blocks.where("cut").select("id").distinct(), "cut")
    links = scratch.table(completed(cut, labels, sets, scratch, spark), "links-3")
    labels = components(labels.union(links), scratch, "components-3")
    least = scratch.table(nodes.select("digest", "id", "copies").join(labels.hint("merge"), "id", "left").select("digest", F.coalesce("label", "id").alias("label"), "copies"), "labelled")
    scratch.drop("sets", "met", "blocks", "cut-sets", "all-keys", "keys", "laid")
    return named(rows.drop("sig"), least, spark)


def named(rows: DataFrame, least: DataFrame, spark: SparkSession) -> DataFrame:
    """``rows`` with the label of their digest, dropping the digest; the label is null for rows with an empty set."""
    there = with_class(rows.where("digest is not null"), least, ["digest"], "copies", spark).drop("copies")
    bare = rows.where("digest is null").withColumn("label", F.lit(None).cast("binary"))
    return there.unionByName(bare).drop("digest")


def dedup(docs: DataFrame, spark: SparkSession, k: int = 5) -> DataFrame:
    """One row of each component: of the rows with the smallest doc_id (null last) that with the least MD5 of its text. Rows with empty sets all stay.

    All columns of ``docs`` pass, whatever their names.
    """
    scratch = Scratch(spark, "near-kept")
    mark = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = linked(docs.select("doc_id", "text", mark.alias("mark")), spark, k, "near")
    keep = rows.where("n > 0 and id = label").groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select("x.doc_id", "x.mark", F.lit(True).alias("worded"))
    bare = rows.where("n = 0").select("doc_id", "mark", F.lit(False).alias("worded")).distinct()
    keep = scratch.table(keep.union(bare), "keep")
    packed = docs.select(F.col("doc_id").alias("doc"), mark.alias("text_mark"), F.struct(*docs.columns).alias("row"))
    both = packed.join(keep.hint("merge"), F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("text_mark") == F.col("mark")))
    first = both.where("worded").groupBy("doc", "text_mark").agg(F.any_value("row").alias("row")).select("row.*")
    return first.union(both.where("not worded").select("row.*"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``, with shingles of two words."""
    out = linked(documents(spark, sf_dir).select("doc_id", "text"), spark, 2, "op7")
    component = F.coalesce(doc_of(F.col("label")), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
