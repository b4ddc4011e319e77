import hashlib
import random

from scoreloom.llm import suffix_dedup as e

from .helpers import empty, odd, tables_at


def brute(rows):
    first, out = {}, []
    for i, t in rows:
        x = (t or "").encode()
        for s in range(len(x) - 99):
            k = x[s : s + 100]
            first[k] = min(first.get(k, (i, s)), (i, s))
    for i, t in rows:
        x = (t or "").encode()
        m = bytearray(len(x))
        for s in range(len(x) - 99):
            if first[x[s : s + 100]] < (i, s):
                m[s : s + 100] = b"\1" * 100
        out.append((i, len(x), sum(m), sum(m[k] and not (k and m[k - 1]) for k in range(len(m))), hashlib.sha256(bytes(b for b, q in zip(x, m) if not q)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r)[:5] for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    base = ["a" * 150, "ab" * 90, "xyz" * 70, letters(300), letters(130)]
    rows = [(i, "".join(rng.choice([*base, "é", "qqq"])[rng.randrange(9) :] for _ in range(rng.randrange(6)))) for i in range(150)] + [(500, None), (501, ""), (502, "a" * 100), (503, "a" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(e.dedup(docs, spark)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert result(e.op6(spark, tables_at(spark, tmp_path, documents=odd(spark)))) == brute(rows)


def test_segments_cut_long_texts(monkeypatch, spark):
    import numpy as np

    flat = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8)
    whole = e.runs(flat, np.array([0, 1000, 1000, 3000]))
    monkeypatch.setattr(e, "SEGMENT", 700)
    for powers in ("up", "down"):  # both come back as they were
        monkeypatch.setattr(e.Powers, powers, np.zeros(0, np.uint64))
    parts = e.runs(flat, np.array([0, 1000, 1000, 3000]))
    windows = lambda r: sorted((int(x["idx"]), int(x["lo"]) + k, int(x["gram"]), int(x["off"]) - k) for x in r for k in range(int(x["span"]) + 1))
    assert windows(whole) == windows(parts) and len(windows(whole)) == 901 + 1901


def test_kept_bytes(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(120))
    docs = spark.createDataFrame([(1, text), (2, "x" + text + "y")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in e.dedup(docs, spark).collect()} == {1: text.encode(), 2: b"xy"}


def test_empty(spark, tmp_path):
    assert e.op6(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0


class Step:
    """Stands for a DataFrame and gives the function that it is mapped by, so that passes run in this process."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):  # noqa: N802
        return f


def in_process(rows, n):
    """The ranges that the passes remove, without Spark: doc_id -> removed bytes."""
    import numpy as np
    import pyarrow as pa

    batch = lambda r: [pa.RecordBatch.from_pylist(r)] if r else []
    told = lambda f, r: [x for b in f(iter(batch(r))) for x in b.to_pylist()]
    packs = [x for k in range(0, len(rows), 7) for b in e.pack(Step())(iter([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[k : k + 7]])])) for x in b.to_pylist()]
    parts = lambda ms: [[m for m in ms if m["part"] == p] for p in range(n)]
    second = [m for part in parts(told(e.first_pass(Step(), n), packs)) for m in told(e.second_pass(Step()), part)]
    wanted = [p | {"bodies": [m["body"] for m in second if m["kind"] == "want" and m["pack"] == p["pack"]]} for p in packs]
    last = [m for part in parts(told(e.third_pass(Step(), n), [w for w in wanted if w["bodies"]])) for m in told(e.last_pass(Step()), part)]
    bodies = lambda p: [m["body"] for m in second + last if m["kind"] == "gone" and m["pack"] == p["pack"]]
    out = {}
    for p in packs:
        ids = np.frombuffer(p["ids"], np.int64)
        cut = {i: set() for i in ids.tolist()}
        for g in np.frombuffer(b"".join(bodies(p)), e.GONE):
            cut[int(ids[g["idx"]])].update(range(g["lo"], g["hi"]))
        out |= {i: len(c) for i, c in cut.items()}
    return out


def test_bytes_decide_where_hashes_collide(monkeypatch):
    import numpy as np

    rng, plain = random.Random(5), e.mixed
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    base = [letters(140), letters(220), "xy" * 80, "q" * 130]
    rows = [(i, "".join(rng.choice([*base, letters(60), "é"])[rng.randrange(7) :] for _ in range(rng.randrange(5)))) for i in range(60)]
    wanted = {r[0]: r[2] for r in brute(rows)}
    assert in_process(rows, 3) == wanted
    monkeypatch.setattr(e, "mixed", lambda x: plain(x) & np.uint64(15))
    for folded, sorted_ in ((50_000, 400_000), (5, 40)):
        monkeypatch.setattr(e, "FOLDED", folded)
        monkeypatch.setattr(e, "SORTED", sorted_)
        assert in_process(rows, 3) == wanted
