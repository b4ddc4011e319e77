import hashlib
import io
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import exact_dedup as e

from .helpers import LOWER, ODD, SF, empty, odd, tables_at


@pytest.mark.parametrize(("bits", "most"), [(64, 3), (12, 1), (5, 16)])
def test_builder_splits_and_chains(bits, most):
    rng = random.Random(bits)
    rows = sorted((rng.getrandbits(bits) << (64 - bits), bytes([rng.randrange(4)]), rng.randrange(1000)) for _ in range(2000))
    out, got, want = io.BytesIO(), [], {}
    b = e.Builder(out, most, 1 << 30)
    for k, t, i in rows:
        got += b.finished(k)
        b.insert(k, t, i, 1, "")
        w = want.setdefault((k, t), [i, 0])
        w[0], w[1] = max(w[0], i), w[1] + 1
    got += b.finished(None)
    b.close()
    assert sorted((k, i, n) for k, i, n, _, _ in got) == sorted((k, *w) for (k, _), w in want.items())
    assert b.depth > 0 and len(b.directory) == 2**b.depth
    pages = [p for _, _, at, n in b.written for p in e.read_page(out.getvalue()[at : at + n])]
    assert b.depth <= 20
    assert sorted((k, t) for k, _, _, t in pages) == sorted(want)


def test_odd_rows(spark, tmp_path):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in e.op3(spark, tables_at(spark, tmp_path, documents=odd(spark))).collect())
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert sum(g[3] for g in got) == len(groups)  # one of two rows with the same doc_id and text
    kept = e.dedup(odd(spark), spark)
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_empty(spark, tmp_path):
    assert e.op3(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0 and e.dedup(empty(spark), spark).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(e.SQL).fetchall())
    assert sorted(tuple(r) for r in e.op3(spark, SF).collect()) == want


def test_index_finds_by_ranges(spark):
    scratch = e.Scratch(spark, "test")
    docs = e.documents(spark, SF)
    owned = e.index(docs, spark, scratch).collect()
    index = e.Index(sorted({r.file for r in owned}))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault((r.text or "").translate(LOWER).encode(), []).append(r.doc_id)
    assert all(index.find(t) == (max(i), len(i)) for t, i in want.items()) and index.find(b"not there") is None


def test_many_buckets_are_found_through_the_directory(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    keys = sorted(rng.getrandbits(64) for _ in range(3000))
    files = []
    for part in range(3):
        path = tmp_path / f"{part}.xh"
        with open(path, "wb") as out:
            b = e.Builder(out, 8, 1 << 30, (part, 3))
            for k in keys:
                own, place = e.owner_of(k, 3)
                if own == part:
                    list(b.finished(place))
                    b.insert(place, str(k).encode(), k % 1000, 1, "", k)
            list(b.finished(None))
            b.close()
        assert 7 <= b.depth <= 12  # about log2 of a third of the keys by the entries of a bucket: no bit is spent on the owner
        files.append(f"file://{path}")
    index = e.Index(files)
    for k in keys[::37]:
        fs, path, at, n = index.page_of(k)
        with fs.open_input_file(path) as src:
            assert (k, k % 1000, 1, str(k).encode()) in list(e.read_page(src.read_at(n, at)))


@pytest.mark.parametrize("held", [1 << 30, 700, 1])
def test_fold_counts_every_row(monkeypatch, held):
    monkeypatch.setattr(e, "HELD", held)
    rng, rows = random.Random(4), []
    for i in range(500):
        t = rng.choice([b"hot"] * 5 + [b"%d" % rng.randrange(90)])
        rows.append((t, rng.choice([7, hash(t) % 1000]), None if i % 50 == 0 else i))
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.string()), ("body", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * 50, pa.int32()), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.int64()), pa.array(["d"] * 50), pa.array([r[0] for r in part])], schema=schema) for part in (rows[a : a + 50] for a in range(0, 500, 50))]
    got, want = defaultdict(lambda: [None, 0]), defaultdict(lambda: [None, 0])
    out = list(e._fold(iter(batches)))
    for b in out:
        for r in b.to_pylist():
            g = got[r["key"], r["body"]]
            g[0], g[1] = e._larger(g[0], r["keep_id"]), g[1] + r["n"]
    for t, k, i in rows:
        w = want[k, t]
        w[0], w[1] = e._larger(w[0], i), w[1] + 1
    assert got == want and (held > 1 << 20) == (sum(b.num_rows for b in out) == len(want))


def test_clashing_names(spark):
    docs = odd(spark).withColumns({c: F.lit(1) for c in ("key", "digest", "keep_id", "k", "d", "row", "first", "body", "n")})
    assert e.dedup(docs, spark).columns == docs.columns and e.dedup(docs, spark).count() == 8
