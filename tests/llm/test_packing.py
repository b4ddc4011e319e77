import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scoreloom.llm import best_fit_packing as e

from .helpers import SF, empty, odd, tables_at

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "a", "Don't  STOP, it's ok. x,y. İstanbul ΣΑΣ, 12.5, é. ², <|endoftext|>, hi<|startoftext|> ß. Éa.b. c., d\n\n.\n", "we're. 'sx, 日本語, テスト. x́, y", "\x0b\x0c\x1c\x85 q\ttab,  x. ﬁ, ñ. À Ⅷ. ⅷ,  ", "a, b, c. d.", "x" * 5000]


def test_ids_are_the_tokenizers():
    tokenizer, enc = Tokenizer.from_file(PATH), e.Encoder(PATH)
    for batch in (TEXTS, TEXTS[::-1]):
        flat, bounds = enc(pa.array(batch))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [tokenizer.encode(x, add_special_tokens=False).ids for x in batch]


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(e, "MEMO", 5)
    tokenizer, enc = Tokenizer.from_file(PATH), e.Encoder(PATH)
    for x in ("one two three four five six", "seven one two", "six five four three two one zero"):
        assert enc(pa.array([x]))[0].tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_crossover_keeps_every_piece_in_bounds():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 200)
    people = e.evolve(sizes, [], 100, 3, crossovers=0)
    for _ in range(10):
        child = e.crossover(sizes, people[0], people[-1], 100, rng)
        assert len(child) == 200 and np.bincount(child, sizes).max() <= 100 and (np.bincount(child) > 0).all()
    better = e.evolve(sizes, people, 100, 4, crossovers=30)
    assert better[0].max() <= people[0].max()


def test_crossovers_close_what_best_fit_leaves_open():
    open_, closed = 0, 0
    for seed in range(60):
        sizes = np.random.default_rng(seed).integers(20, 50, 30)
        bound = -(-int(sizes.sum()) // 100)
        begun = e.evolve(sizes, [], 100, seed, crossovers=0)  # best fit in six orders, decreasing among them
        if begun[0].max() + 1 > bound:
            people = e.evolve(sizes, begun, 100, seed)
            assert np.bincount(people[0], sizes).max() <= 100
            open_, closed = open_ + 1, closed + (people[0].max() + 1 == bound)
    assert open_ >= 20 and closed >= 4


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tokenizer = e.Encoder(path), Tokenizer.from_file(path)
    flat, bounds = enc(pa.array([*TEXTS, None]))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [tokenizer.encode(x, add_special_tokens=False).ids for x in [*TEXTS, ""]]


def test_equal_texts_of_a_batch_are_encoded_once():
    texts, seen, enc, tokenizer = ["é, b b c", None, "é, b b c", "", "d", "é, b b c", None], [], e.Encoder(PATH), Tokenizer.from_file(PATH)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 1, 3, 4, 5, 6, 7], "row_id": [*range(10, 18)], "text": ["before", *texts]}).slice(1)
    out = e.cut_batch(batch, lambda t: seen.extend(t.to_pylist()) or enc(t), 2).to_pylist()
    assert seen == ["é, b b c", None, "", "d"]
    want = []
    for doc, row, t in zip([2, 1, 3, 4, 5, 6, 7], range(11, 18), texts, strict=True):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(doc, row, n, a, len(ids[a : a + 2]), zlib.crc32(ids[a : a + 2].tobytes())) for n, a in enumerate(range(0, len(ids), 2))]
    assert [tuple(r.values()) for r in out] == want


def check(rows, docs, capacity=4096):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values(), default=0) <= capacity
    return len(fill), -(-sum(fill.values()) // capacity)


def test_odd_rows(spark, tmp_path):
    check(e.op8(spark, tables_at(spark, tmp_path, documents=odd(spark))).collect(), [(r.doc_id, r.text) for r in odd(spark).collect()])


def test_whole_table_is_packed_tightly(spark):
    docs = e.documents(spark, SF)
    used, least = check(e.op8(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least + 1


def test_small_capacity_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(e, "SHARD_PIECES", 50)
    rng = random.Random(5)
    rows = [(i, "the " * rng.randrange(120)) for i in range(300)]
    used, least = check(e.pack(spark.createDataFrame(rows, "doc_id long, text string"), spark, capacity=100).collect(), rows, 100)
    assert used <= least * 1.05 + 1


def test_empty(spark, tmp_path):
    assert e.op8(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0
