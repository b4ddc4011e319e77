import random
import re

import numpy as np
from pyspark.sql import functions as F

from scoreloom.llm import near_dedup as e

from .helpers import LOWER, empty, odd, tables_at


def sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute(rows, k):
    s = sets(rows, k)
    up = list(range(len(s)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for j, (i, _) in enumerate(s):
        least[root(j)] = min(least.get(root(j), i), i)
    return sorted((i, len(x), least[root(j)]) for j, (i, x) in enumerate(s))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words) if rng.random() < 0.9 else "\t".join(words).upper()))
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = corpus(1, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in e.op7(spark, tables_at(spark, tmp_path, documents=docs)).collect())
    assert got == brute(rows, 2)


def got(spark, rows, k=2):
    out = e.linked(spark.createDataFrame(rows, "doc_id long, text string"), spark, k, "test")
    return sorted((r.doc_id, r.n, r.c) for r in out.select("doc_id", "n", F.coalesce(e.doc_of(F.col("label")), "doc_id").alias("c")).collect())


def test_regions_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(e, "MOST", 8)
    rows = corpus(2, 200)
    assert got(spark, rows) == brute(rows, 2)


def family(seed, n, own=8):
    """Twins at a little over 0.8, and less between the pairs of twins (0.6, or 0.7 if ``own`` is 12): all lie in the same large regions."""
    rng, rows = random.Random(seed), []
    base = [f"b{i}" for i in range(120)]
    for i in range(n):
        words = list(base)
        for p in range(0, 120, own):
            words[p] = f"f{i}x{p}"
        rows.append((2 * i, " ".join(words)))
        for p in rng.sample(range(4, 120, 8), 6):
            words[p] = f"t{i}x{p}"
        rows.append((2 * i + 1, " ".join(words)))
    return rows


def test_cut_regions_are_completed(spark, monkeypatch):
    monkeypatch.setattr(e, "MOST", 2)
    monkeypatch.setattr(e, "LOT", 16)
    rows = family(3, 60)
    assert got(spark, rows) == brute(rows, 2)


def test_regions_cut_by_digits_are_completed(spark, monkeypatch):
    monkeypatch.setattr(e, "MOST", 8)
    rows = family(4, 100, own=12)
    assert got(spark, rows) == brute(rows, 2)


def cores(seed, n, m=6):
    """``n`` texts of unequal sizes around each of ``m`` cores; those of one core have 0.6 to 0.95 in common."""
    rng, rows = random.Random(seed), []
    for c in range(m):
        core = [f"c{c}x{i}" for i in range(60)]
        for _ in range(n):
            words = core[: rng.randrange(44, 61)]
            for p in rng.sample(range(len(words)), rng.randrange(5)):
                words[p] = f"z{rng.randrange(40)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_the_join_of_cut_classes_alone_finds_all_components(spark):
    rows = cores(6, 30)
    scratch = e.Scratch(spark, "test")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = e.signed(docs, 2).where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "sig")).alias("x")).select("x.*")
    sets = scratch.table(e.sets_of(docs, scratch.table(nodes, "nodes"), 2), "sets")
    links = scratch.table(e.completed(sets.select("id"), sets.select("id", F.col("id").alias("label")), sets, scratch, spark), "links")
    found = {r.id: r.label for r in e.components(links, scratch, "found").select(e.doc_of(F.col("id")).alias("id"), e.doc_of(F.col("label")).alias("label")).collect()}
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    assert [found.get(first[t], first[t]) for _, t in rows] == [c for _, _, c in brute(rows, 2)]


def test_what_cannot_reach_the_share_is_not_tried(spark, monkeypatch):
    """All lie in the same large regions. Twins are linked before step 3; the others, at 0.7, share keys too late in their order to reach 0.8."""
    monkeypatch.setattr(e, "MOST", 2)
    made, table = {}, e.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(e.Scratch, "table", counted)
    for rows in (family(7, 80), family(8, 80, own=12)[::2]):
        assert got(spark, rows) == brute(rows, 2)
        assert made["all-keys" if "all-keys" in made else "keys"] and made["laid"] + made["tiles"] <= len(rows)


def test_near_copies_of_the_pipeline_make_few_tiles(spark, monkeypatch):
    """The pipeline's stage, with five-word shingles: pairs below 0.8 make no tiles, and all but one of each group's copies go."""
    import corpus_pipeline

    monkeypatch.setattr(e, "MOST", 2)
    made, table = {}, e.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(e.Scratch, "table", counted)
    rows = family(9, 60, own=40)[::2]
    rows += [(1000 + i, t + " more") for i, t in rows]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 5)})
    assert made["laid"] + made["tiles"] <= len(rows)


def test_neighbourhoods_hold_every_pair_or_mark_it(spark):
    """Of a region that is not cut all members share one block; cut ones, and those at the edges of ranges, are marked."""
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (300, e.TREES, e.DEPTH)).astype(np.uint16)
    sig[:, :, : e.ROOT] = (rng.integers(0, 40, (300, e.TREES, 1)) ** 2 // 40).astype(np.uint16)
    nodes = spark.createDataFrame([(bytearray(i.to_bytes(4, "big")), bytearray(s.tobytes())) for i, s in enumerate(sig)], "id binary, sig binary")
    rows = e.neighbourhoods(e.in_order(nodes, spark), 16).collect()
    blocks, cut = {}, {(r.tree, bytes(r.id)) for r in rows if r.cut}
    for r in rows:
        blocks.setdefault((r.tree, r.block), set()).add(bytes(r.id))
    assert max(map(len, blocks.values())) <= 16 and cut
    together = {(t, frozenset((a, b))) for (t, _), x in blocks.items() for a in x for b in x if a < b}
    regions = {}
    for i, s in enumerate(sig):
        for t in range(e.TREES):
            regions.setdefault((t, s[t, : e.ROOT].tobytes()), []).append(i.to_bytes(4, "big"))
    for (t, _), x in regions.items():
        for a in x:
            for b in x:
                assert a >= b or (t, frozenset((a, b))) in together or {(t, a), (t, b)} <= cut


def test_cuts_lie_where_neighbours_have_least_in_common():
    keys = np.array([[1, 1], [1, 1], [1, 2], [1, 2], [2, 2], [2, 2], [2, 2]])
    assert e.cut_points(keys, 4) == [4] and e.cut_points(keys, 3) == [2, 4] and e.cut_points(keys, 1) == [1, 2, 3, 4, 5, 6]


def test_components_in_rounds(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 90)] + [(100 + i, 100) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    rng.shuffle(pairs)
    links = spark.createDataFrame([(bytearray(a.to_bytes(4, "big")), bytearray(b.to_bytes(4, "big"))) for a, b in pairs], "a binary, b binary").repartition(6)
    scratch, up = e.Scratch(spark, "test"), list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = sorted((i, root(i)) for i in range(400) if root(i) != i)
    for held in (7, 40, 1000):
        found = e.components(scratch.table(links, f"links-{held}"), scratch, f"c{held}", held).collect()
        assert sorted((int.from_bytes(r.id, "big"), int.from_bytes(r.label, "big")) for r in found) == want


def test_rows_that_share_a_doc_id_or_have_none(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (None, "other words here and now"), (1, long + " more"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, None), (2, ""), (-5, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, keep_id int, _first int")
    kept = e.dedup(docs, spark, k=2)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert found == [(False, -5, "a b c d e f g"), (False, 1, long + " more"), (False, 2, ""), (False, 2, ""), (True, 0, "other words here and now")]


def test_odd_rows(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in e.op7(spark, tables_at(spark, tmp_path, documents=odd(spark))).collect())
    assert got == brute(rows, 2)
    kept = e.dedup(odd(spark), spark, k=5)
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 5)})


def test_empty(spark, tmp_path):
    assert e.op7(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0


def test_words_of_joined_texts():
    flat, bounds = np.frombuffer(b"ab Cdef", np.uint8), np.array([0, 2, 2, 7])
    words, doc = e.word_hashes(flat, bounds)
    assert doc.tolist() == [0, 2] and words[1] == e.word_hashes(np.frombuffer(b"cDEF", np.uint8), np.array([0, 4]))[0][0]
