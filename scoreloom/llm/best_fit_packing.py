"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens; full pieces are sequences of their own. The others are dealt to
shards of some thousand pieces, each a bin-packing problem with several islands. An island holds a population of
packings, begun from best-fit decreasing and from best-fit in random orders. Every island makes CROSSOVERS crossovers a round, and goes on above
the lower bound, ceil(tokens / capacity), until STALE of them in a row bring nothing. In a crossover, whole well-filled bins of one parent are
injected into another; bins of the receiver that share a document with them are emptied, and the displaced documents that remain
go by best fit, longest first. After each round an island's elite moves to the next island of its shard. Of packings with as many bins
the one that fills them most unevenly is the better one: it leaves its slack in few bins, and what is in the emptiest bins of many shards is
packed once more, together. Bins from TAIL_FILL on stay closed, so up to 1 - TAIL_FILL of their room is given up for good.

Defined cases: a null text is the empty one, a piece of the end token alone; rows that repeat a doc_id are packed
each for itself and told apart by ``row_id``; an empty table gives no rows; further columns are ignored. A very long text is encoded alone, whole.
Pieces of equal length are taken in the order of row_id and piece.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, documents, record_batch, slices

CAPACITY = 4096
END = 1
SHARD_PIECES = 1500
ISLANDS, ROUNDS, POPULATION, CROSSOVERS, STALE = 2, 2, 6, 8, 30
#: Bins filled less than this go to the last packing, of the leavings of TAILS shards at once.
TAIL_FILL, TAILS = 0.97, 256
#: Chunks whose ids a task remembers; when they are so many, it begins anew.
MEMO = 500_000
#: Bytes of text that are encoded at once.
SLICE = 3 << 20
#: Lower-case Latin-1 letters: the normaliser leaves them, and a chunk of them is one pre-token.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


#: The normaliser and the pre-tokenizer for which chunks can be encoded apart, as a tokenizer's file states them (fixed values).
WORD_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


class Encoder:
    """Token ids of texts; other tokenizers than that of WORD_RULES encode whole texts. With its rules, chunk by chunk: no pre-token of the word vocabulary spans a space, so the ids of a text are those of its chunks.

    A full stop or comma between a letter and a space is a pre-token of its own, so it is a chunk of its own too. Each distinct chunk
    is encoded once; the ids of the texts are then gathered from the pool.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_chunks = [rules["normalizer"], rules["pre_tokenizer"]] == WORD_RULES and rules["model"].get("end_of_word_suffix") == "</w>"
        self.whole.no_padding()
        self.whole.no_truncation()
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        pairs = ((c.encode().decode("latin-1"), byte.pre_tokenize_str(c)[0][0]) for c in map(chr, range(0xDF, 0x100)))
        self.moved = sorted({(a, b) for was, now in pairs for a, b in zip(was, now, strict=True) if a != b})
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.lengths = np.zeros((2, 1 << 12), np.int64)

    def bytewise(self, text: str) -> str:
        """Plain text with its UTF-8 bytes as the byte-level signs that the vocabulary has for them."""
        text = text.encode().decode("latin-1")
        for a, b in self.moved:
            text = text.replace(a, b)
        return text

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Where the pool has each of ``chunks`` from now on; they are distinct and new."""
        groups: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, c in enumerate(chunks):
            groups[(0 if c.isascii() else 1) if PLAIN(c) else 2].append(i)
        ascii_, accented, other = ([chunks[i] for i in g] for g in groups)
        at, n = np.empty(len(chunks), np.int64), len(self.memo)
        at[np.array([i for g in groups for i in g], np.int64)] = np.arange(n, n + len(chunks))
        for plain, text in ((ascii_, " ".join(ascii_)), (accented, self.bytewise(" ".join(accented)))):
            if plain:
                ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                self.store(plain, ids, np.diff(ends, prepend=0))
        if other:
            each = [e.ids for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
            self.store(other, np.array([i for ids in each for i in ids], "<u4"), np.array([len(ids) for ids in each], np.int64))
        return at

    def store(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        assert len(chunks) == len(lengths) and lengths.sum() == len(ids)
        n, m = len(self.memo), len(self.memo) + len(chunks)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        if m > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * m), np.resize(self.lengths, 2 * m)
        self.pool[self.used : self.used + len(ids)] = ids
        self.lengths[n:m], self.starts[n:m] = lengths, self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.memo.update(zip(chunks, range(n, m), strict=True))

    def known(self, chunks: list[str]) -> np.ndarray:
        """Where the pool has each chunk; -1 for those that are new."""
        return np.fromiter(map(self.memo.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, where each text begins and ends among them)."""
        if not self.by_chunks:
            each = [e.ids for e in self.whole.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], "<u4"), np.cumsum([0, *map(len, each)])
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")  # ascii_lower misreads slices
        texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(texts, r"(\pL)([.,]) ", r"\1 \2 "), " ")
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known(distinct)
        if len(self.memo) + int((known < 0).sum()) > MEMO:
            self.forget()
            known[:] = -1
        new = np.flatnonzero(known < 0).tolist()
        known[new] = self.learn([distinct[i] for i in new])
        at = known[np.asarray(words.indices)]
        n = self.lengths[at]
        ends = np.cumsum(n)
        place = np.repeat(self.starts[at] - ends + n, n)
        place += np.arange(len(place))
        return self.pool[place], np.r_[0, ends][bounds]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


CUT = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CUT_SQL = "doc_id bigint, row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_batch(batch: pa.RecordBatch, enc: Encoder, capacity: int) -> pa.RecordBatch:
    """The pieces of a batch's documents. Equal texts, which a mix puts side by side, are encoded and cut once."""
    texts, end = batch.column("text").dictionary_encode("encode"), np.array([END], "<u4").tobytes()
    flat, bounds = enc(texts.dictionary)
    cuts: list[list[tuple[int, int, int, int]]] = []
    for begin, stop in zip(bounds[:-1], bounds[1:], strict=True):
        ids = memoryview(flat[begin:stop].tobytes() + end)
        parts = ((at, ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity))
        cuts.append([(n, at // 4, len(part) // 4, zlib.crc32(part)) for n, (at, part) in enumerate(parts)])
    out: dict[str, list] = {f.name: [] for f in CUT}
    for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_id").to_pylist(), texts.indices.to_pylist(), strict=True):
        for piece in cuts[text]:
            for k, v in zip(out, (doc, row, *piece), strict=True):
                out[k].append(v)
    return record_batch(out, CUT)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents; row_id tells rows of one doc_id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            yield cut_batch(b, enc, capacity)
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text").mapInArrow(cut, CUT_SQL)


def best_fit(sizes: np.ndarray, order, capacity: int, owner: np.ndarray, loads: list[int]) -> None:
    """Puts the pieces of ``order``, one by one, into the fullest bin that still holds them; else opens a bin. ``owner`` and ``loads`` change in place."""
    free = sorted((capacity - load, b) for b, load in enumerate(loads) if load)
    for i in order:
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        owner[i] = b
        loads[b] += s
        if room > s:
            insort(free, (room - s, b))


def value(loads: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven fill, which leaves room to empty a bin."""
    return -int((loads > 0).sum()), float(np.square(loads / capacity).sum())


def compact(owner: np.ndarray) -> np.ndarray:
    return np.unique(owner, return_inverse=True)[1].astype(np.int32)


def crossover(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``taker`` with well-filled bins of ``giver``."""
    loads = np.bincount(giver, sizes, minlength=1)
    full = np.flatnonzero(loads >= np.quantile(loads, 0.5))
    picked = np.zeros(len(loads), bool)
    picked[rng.choice(full, max(1, len(full) // 2), replace=False)] = True
    injected = picked[giver]
    emptied = np.zeros(taker.max() + 1, bool)
    emptied[taker[injected]] = True
    # the displaced are what the emptied bins held beyond the injected; the emptiest bins that remain are opened too
    rest = np.bincount(taker, sizes, minlength=len(emptied))
    rest[emptied] = np.inf
    emptied[np.argsort(rest)[: min(3, int((~emptied).sum()))]] = True
    displaced = emptied[taker] & ~injected
    child = np.where(injected, giver + taker.max() + 1, taker)
    held = compact(child[~displaced]) if not displaced.all() else np.zeros(0, np.int32)
    owner = np.zeros(len(sizes), np.int32)
    owner[~displaced] = held
    loads = np.bincount(held, sizes[~displaced]).astype(int).tolist() if len(held) else []
    order = np.flatnonzero(displaced)
    best_fit(sizes, order[np.argsort(-sizes[order], kind="stable")], capacity, owner, loads)
    return compact(owner)


def evolve(sizes: np.ndarray, start: list[np.ndarray], capacity: int, seed: int, crossovers: int = CROSSOVERS) -> list[np.ndarray]:
    """A population after ``crossovers`` crossovers, best first; above the lower bound they go on until STALE in a row have not made the best one better."""
    rng, bound = np.random.default_rng(seed), -(-int(sizes.sum()) // capacity)
    people = list(start)
    worth = lambda o: value(np.bincount(o, sizes), capacity)
    if not people:
        for order in [np.argsort(-sizes, kind="stable"), *(rng.permutation(len(sizes)) for _ in range(POPULATION - 1))]:
            owner, loads = np.zeros(len(sizes), np.int32), []
            best_fit(sizes, order, capacity, owner, loads)
            people.append(owner)
    ranked = sorted(((worth(o), i, o) for i, o in enumerate(people)), key=lambda x: x[:2], reverse=True)
    made = stale = 0
    while len(sizes) > 1 and (made < crossovers or crossovers and -ranked[0][0][0] > bound and stale < STALE):
        a, b = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = crossover(sizes, ranked[a][2], ranked[b][2], capacity, rng)
        made, best = made + 1, ranked[0][0]
        if (own := worth(child)) not in {x[0] for x in ranked}:
            ranked = sorted([*ranked, (own, len(people) + made, child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
        stale = 0 if ranked[0][0] > best else stale + 1
    return [o for _, _, o in ranked]


def _pack(items: DataFrame, scratch: Scratch, name: str, capacity: int) -> DataFrame:
    """row_id, piece, length, shard, bin: the best packing of each shard after all rounds. ``items``: row_id, piece, length, shard."""
    population = "shard bigint, island int, people array<binary>, least int, begun int, bins int"
    key = ["length", "row_id", "piece"]

    def island(round_: int):
        def run(ids: tuple, own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
            if own.empty:
                return pd.DataFrame({"shard": [], "island": [], "people": [], "least": [], "begun": [], "bins": []})
            sizes = own.sort_values(key)["length"].to_numpy(np.int64)
            start = [np.frombuffer(x, np.int32) for people in (guests["people"] if len(guests) else []) for x in people]
            seed = hash((int(ids[0]), int(ids[1]), round_)) & 0x7FFFFFFF
            start = start or evolve(sizes, [], capacity, seed, crossovers=0)
            people = evolve(sizes, start, capacity, seed)
            bins = lambda x: [min(int(o.max()) + 1 for o in x)]
            return pd.DataFrame({"shard": [ids[0]], "island": [ids[1]], "people": [[x.tobytes() for x in people]], "least": [-(-int(sizes.sum()) // capacity)], "begun": bins(start), "bins": bins(people)})

        return run

    laid = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    people = scratch.spark.createDataFrame([], population)
    for r in range(ROUNDS):
        evolved = laid.groupBy("shard", "island").cogroup(people.groupBy("shard", "island")).applyInPandas(island(r), population)
        evolved = scratch.table(evolved, f"{name}-{r}")
        # an island keeps its people and gets the elite of the one before it
        elite = evolved.withColumn("island", (F.col("island") + 1) % ISLANDS).withColumn("people", F.slice("people", 1, 1))
        people = evolved.unionByName(elite)

    def settle(ids: tuple, own: pd.DataFrame, islands: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        sizes = own["length"].to_numpy(np.int64)
        best = max((np.frombuffer(p, np.int32) for ps in islands.sort_values("island")["people"] for p in ps), key=lambda o: value(np.bincount(o, sizes), capacity))
        return own.assign(bin=best.astype(np.int64))[["row_id", "piece", "length", "shard", "bin"]]

    best = evolved.select("shard", "island", F.slice("people", 1, 1).alias("people"))
    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(settle, "row_id bigint, piece int, length bigint, shard bigint, bin bigint")


def pack(docs: DataFrame, spark: SparkSession, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_id for every piece of every row."""
    scratch = Scratch(spark, "pack")
    # numbered as it is written, so that a task that runs again finds the same numbers
    cut = scratch.table(pieces(docs, tokenizer, capacity).withColumn("number", F.monotonically_increasing_id()), "pieces")
    part = cut.where(F.col("length") < capacity).select("row_id", "piece", "length")
    shards = max(1, part.count() // SHARD_PIECES)
    items = part.withColumn("shard", F.pmod(F.xxhash64("row_id", "piece"), F.lit(shards)))
    first = scratch.table(_pack(items, scratch, "first", capacity), "first")
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    loose = fills.where(F.col("fill") < TAIL_FILL * capacity).select("shard", "bin", F.lit(True).alias("loose"))
    first = first.join(loose, ["shard", "bin"], "left")
    tail = first.where("loose").select("row_id", "piece", "length", F.floor(F.col("shard") / TAILS).alias("shard"))
    last = scratch.table(_pack(tail, scratch, "last", capacity), "last")
    placed = first.where("loose is null").select("row_id", "piece", F.lit(0).alias("level"), "shard", "bin").unionByName(
        last.select("row_id", "piece", F.lit(1).alias("level"), "shard", "bin"))
    # level and shard and bin make the number; full pieces take the numbers below zero
    number = (F.col("level").cast("long") * (1 << 62)) + F.col("shard") * (1 << 20) + F.col("bin")
    both = cut.join(placed.select("row_id", "piece", number.alias("sequence_id")), ["row_id", "piece"], "left")
    both = both.withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("number")))
    before = W.partitionBy("sequence_id").orderBy("row_id", "piece").rowsBetween(W.unboundedPreceding, -1)
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "row_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``documents``."""
    return pack(documents(spark, sf_dir), spark)
