import gzip
import io
import json
import zipfile
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import language_id, metric_search, pii_surrogates, source_mixing, toxicity, warc_archives

from .helpers import LOWER, ODD, SF, empty, odd, tables_at

# --- language ID ---------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    got = language_id.op1(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 200 and held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, tmp_path):
    got = {r.doc_id: r.lang_pred for r in language_id.op1(spark, tables_at(spark, tmp_path, documents=odd(spark))).collect()}
    assert len(got) == 10 and all(got[i] == "und" for i in (1, 2, 8, 9)) and got[5] in ("en", "de", "fr")
    assert language_id.op1(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0


def test_language_long_text_goes_in_parts(monkeypatch):
    text = "le chat dort sur la table. " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 200)
    f, n = language_id.counts(text)
    assert set(f) >= set(whole[0]) - set() and abs(int(n.sum()) - int(whole[1].sum())) < 0.1 * whole[1].sum()


def test_temperature_mends_confidence():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    logits = np.zeros((500, 2))
    logits[np.arange(500), np.where(rng.random(500) < 0.8, y, 1 - y)] = 20.0
    assert language_id.temperature(logits, y) > 5


# --- PII --------------------------------------------------------------------------------------------------------------------


def test_surrogates_keep_format_and_coreference(spark):
    rows = [
        (1, "Call Mr. John Smith or Mrs. Jane Smith at +1 (212) 555-1234, 1-212-555-1234. Mr. Smith: J.Doe@Mail.example.com j.doe@mail.example.com"),
        (2, None), (3, ""), (4, "Госпожа Анна Иванова 4111 1111 1111 1111 and 4111-1111-1111-1111 ip 10.20.30.41."), (4, "DE89 3704 0044 0532 0130 00 123-45-6789"), (5, "nothing here 12"), (5, "nothing here 12"),
    ]
    out = pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")), spark, "k").collect()
    texts = defaultdict(list)
    for r in out:
        texts[r.doc_id].append(r.text)
    assert len(out) == 7 and texts[2] == [None] and texts[3] == [""] and texts[5] == ["nothing here 12"] * 2
    (one,) = texts[1]
    names = one.split(" or ")
    assert one.startswith("Call Mr. ") and "Smith" not in one and names[0].split()[-1] == names[1].split()[2]
    assert names[1].split()[1][-1] == "a"  # a woman's name
    emails = one.split()[-2:]
    assert emails[0].lower() == emails[1] and emails[0].endswith(".com") and emails[0][0].isupper()
    digits = ["".join(c for c in part if c.isdigit()) for part in (one[one.index("+") : one.index(",")], one[one.index(",") : one.index(". Mr.")])]
    assert digits[0] == digits[1] and digits[0][0] == "1" and len(digits[0]) == 11
    card = next(t for t in texts[4] if "Госпожа" in t)
    a, b = ("".join(c for c in x if c.isdigit()) for x in (card.split(" and ")[0], card.split(" and ")[1].split(" ip ")[0]))
    assert a == b and a[0] == "4" and sum(sum(divmod(int(d) * (1 + (15 - i) % 2), 10)) for i, d in enumerate(a)) % 10 == 0
    assert all(0 <= int(o) <= 255 for o in card.split(" ip ")[1].strip(".").split(".")) and "10.20.30.41" not in card


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr. {'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[i % 26]}{'abcdefghij'[i // 26]}") for i in range(200)]
    out = pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), spark, "k").collect()
    assert len({r.text.lower() for r in out}) == 200 and not {r.text for r in out} & {t for _, t in rows}


def test_bare_mentions_and_other_scripts(spark):
    rows = [
        (1, "Mr. John Smith came. Smith left; John's hat stayed. Smithson did not come."), (2, "Dr. Jane Doe and Prof Doe met Mlle. Anne Petit."), (3, "السيد محمد علي هنا"), (4, "Κυρία Μαρία Παππά"),
        (5, "+49 30 123456 or +33 1 23 45 67 89; +44 (20) 7946 0958, +5 apples, 12 345"), (6, "Smith is no name here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_entities", "found", "whole", "row", "new")})
    out = pii_surrogates.replace(docs, spark, "k")
    assert out.columns == docs.columns and {r.n_entities for r in out.collect()} == {"x"}
    t = {r.doc_id: r.text for r in out.collect()}
    assert "Smith " not in t[1].replace("Smithson", "") and "John" not in t[1] and "Smithson" in t[1]
    given, surname = t[1].split()[1:3]
    assert t[1].split()[4] == surname and t[1].split()[6].startswith(given)
    assert not any(x in t[2] for x in ("Jane", "Doe", "Anne", "Petit")) and t[2].startswith("Dr. ") and t[2].split()[2] == t[2].split()[5]
    assert t[3].startswith("السيد ") and "محمد" not in t[3] and all("\u0621" <= c <= "\u064a" for c in t[3].split()[1])
    assert "Μαρία" not in t[4] and t[4].startswith("Κυρία ")
    assert not any(x in t[5] for x in ("123456", "45 67 89", "7946")) and t[5].endswith("+5 apples, 12 345") and t[5].startswith("+49 ") is False or t[5][0] == "+"
    assert t[6] == rows[5][1]
    other = {r.doc_id: r.text for r in pii_surrogates.replace(docs, spark, "another key").collect()}
    assert other[1] != t[1] and other[6] == t[6]


def test_surrogates_against_brute_force(spark):
    """Card numbers by the definition: HMAC, sign by sign, Luhn."""
    import hashlib
    import hmac

    rows = [(i, f"pay 4{i:03d} 1234 5678 901{i % 10} now") for i in range(30)]
    out = {r.doc_id: r.text for r in pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), spark, "secret").collect()}
    for i, text in rows:
        canon = "".join(c for c in text if c.isdigit())
        h = hmac.new(b"secret", f"card|{canon}|0".encode(), hashlib.sha512).hexdigest()
        value = lambda k: int(h[(2 * k) % 126 : (2 * k) % 126 + 2], 16)  # noqa: E731, B023
        body = canon[0] + "".join(str(value(k) % 10) for k in range(1, 15))
        total = sum(sum(divmod(int(d) * (1 + (15 - k) % 2), 10)) for k, d in enumerate(body))
        want = body + str(-total % 10)
        assert "".join(c for c in out[i] if c.isdigit()) == want and out[i].startswith("pay ") and [len(x) for x in out[i].split()] == [3, 4, 4, 4, 4, 3]


def test_surrogates_of_empty_table(spark, tmp_path):
    assert pii_surrogates.op2(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0


# --- learning, against brute force ------------------------------------------------------------------------------------------


def test_ftrl_against_plain_loops(monkeypatch):
    monkeypatch.setattr(language_id, "FEATURES", 12)
    rng = np.random.default_rng(5)
    data, y = [], []
    for _ in range(40):
        f = np.sort(rng.choice(12, 4, replace=False))
        data.append((f, rng.random(4)))
        y.append(int(f[0] % 3))
    got, bias = language_id.fit(data, np.array(y), 3)
    z, n, b = [[[0.0] * 3 for _ in range(12)] for _ in range(2)] + [[0.0] * 3]

    def weight(j, k):
        shrunk = max(abs(z[j][k]) - language_id.L1, 0) * (1 if z[j][k] > 0 else -1)
        return -shrunk / ((language_id.BETA + n[j][k] ** 0.5) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(data)):
            f, x = data[i]
            w = [[weight(j, k) for k in range(3)] for j in f]
            s = [b[k] + sum(x[a] * w[a][k] for a in range(4)) for k in range(3)]
            e = [np.exp(v - max(s)) for v in s]
            p = [v / sum(e) for v in e]
            for k in range(3):
                g0 = p[k] - (k == y[i])
                for a, j in enumerate(f):
                    g = x[a] * g0
                    sigma = ((n[j][k] + g * g) ** 0.5 - n[j][k] ** 0.5) / language_id.ALPHA
                    z[j][k] += g - sigma * w[a][k]
                    n[j][k] += g * g
                b[k] -= 0.01 * g0
    assert np.allclose(got, [[weight(j, k) for k in range(3)] for j in range(12)]) and np.allclose(bias, b) and (got == 0).any()


def test_many_languages_are_all_learnt(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ALL", 600)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, (letters[i % 26] + letters[(i * 7 + 3) % 26]) * 12, f"l{i % 26:02d}") for i in range(2600)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 26 and np.mean([model.predict(t)[0] == lang for _, t, lang in rows[:260]]) > 0.95


def test_gradients_of_the_pu_risk():
    rng = np.random.default_rng(6)
    p, u, w = rng.random((30, 5)), rng.random((50, 5)), rng.normal(size=6)
    a, b, ga, gb = toxicity.risks(w, p, u, 0.3)
    loss = lambda g: np.log1p(np.exp(-g))
    assert a == pytest.approx(0.3 * loss(p @ w[:5] + w[5]).mean()) and b == pytest.approx(loss(-(u @ w[:5] + w[5])).mean() - 0.3 * loss(-(p @ w[:5] + w[5])).mean())
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        hi, lo = toxicity.risks(w + step, p, u, 0.3), toxicity.risks(w - step, p, u, 0.3)
        assert (hi[0] - lo[0]) / 2e-6 == pytest.approx(ga[i], abs=1e-6) and (hi[1] - lo[1]) / 2e-6 == pytest.approx(gb[i], abs=1e-6)


def test_scores_against_a_dense_scorer():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcde fg"), 200)) for _ in range(20)] + ["", "a"]
    seen = toxicity.Presence()
    picked = np.unique(np.concatenate([seen(t) for t in texts]))[::3]
    model = toxicity.Model(picked, rng.normal(size=len(picked)), 0.4)
    for t in texts:
        s = f" {' '.join(t.lower().split())} "
        grams = {s[i : i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1]}
        found = set(seen(t).tolist())
        assert len(found) <= len(grams)
        x = np.isin(picked, sorted(found)).astype(float)
        g = float(x @ model.weights) / np.sqrt(max(1, x.sum())) + 0.4
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-g)), abs=1e-6)


# --- WARC -------------------------------------------------------------------------------------------------------------------

PAGES = [(1, "u", "x" * 2000), (2, "u", "x" * 2000), (3, None, "x" * 2000), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é" * 500), (8, "u", "é" * 500), (9, "u\r\nX: y", "é" * 499)]


def test_warc_round_trip_matches_sql(spark, tmp_path):
    path = tables_at(spark, tmp_path, pages=spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("row", F.lit(1)).repartition(3))
    got = sorted(tuple(r) for r in warc_archives.op4(spark, path).collect())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(warc_archives.SQL).fetchall())
    assert {r[0]: r[4] for r in got if r[3] == "revisit"} == {1: 3, 2: 3, 7: 8}


def test_warc_archives_roll_over_and_long_payloads_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_archives, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc_archives, "RUN_BYTES", 3_000)
    rng = np.random.default_rng(4)
    rows = [(i, f"u{i}", "".join(map(chr, rng.integers(97, 123, 3000)))) for i in range(60)] + [(60, "u", "".join(map(chr, rng.integers(97, 123, 300_000))) * 10), (60, "v", "w" * 2000), (60, "v", "w" * 2000), (None, "x", "w" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    scratch = warc_archives.Scratch(spark, "test")
    manifest = warc_archives.write(pages, scratch)
    assert manifest.count() > 4 and sum(r.records for r in manifest.collect()) == len(rows)
    got = warc_archives.read(manifest, scratch.path("archives")).collect()
    assert sorted((r.page_id or -1, r.payload_bytes) for r in got) == sorted((i or -1, len(t)) for i, _, t in rows)
    assert [r.record_type for r in got if r.payload_bytes == 2000].count("response") == 1 and all(r.refers_to == 60 for r in got if r.record_type == "revisit")


def test_warc_empty(spark, tmp_path):
    assert warc_archives.op4(spark, tables_at(spark, tmp_path, pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_zip_of_either_writer_and_reader():
    out = io.BytesIO()
    w = warc_archives.ZipWriter(out)
    for name, parts in (("a", [b"hello ", b"world"]), ("b/c", [])):
        w.begin(name)
        for p in parts:
            w.put(p)
        w.end()
    w.close()
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert z.testzip() is None and z.read("a") == b"hello world" and z.read("b/c") == b""
    r = warc_archives.ZipReader(Bytes(out.getvalue()))
    assert r.read("a", 6, 5) == b"world" and r.read("b/c") == b""
    with pytest.raises(ValueError, match="range"):
        r.read("a", 6, 50)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("stored", b"123")
        z.writestr(zipfile.ZipInfo("packed"), b"123" * 50, zipfile.ZIP_DEFLATED)
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"456")
        z.comment = b"a comment PK"
    r = warc_archives.ZipReader(Bytes(other.getvalue()))
    assert r.read("stored") == b"123" and r.read("big") == b"456" and "packed" not in r.members
    with pytest.raises(ValueError, match="end of central"):
        warc_archives.ZipReader(Bytes(b"none"))


def test_damaged_record_is_found():
    raw = warc_archives.record(0, 1, "u", b"payload", "0" * 40, None, False)
    with pytest.raises(ValueError, match="does not match"):
        warc_archives.parsed(raw)
    assert b"WARC/1.1" in gzip.decompress(raw)


# --- toxicity ---------------------------------------------------------------------------------------------------------------


def test_toxic_words_are_learnt(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]
    rows, labels = [], []
    for i in range(1200):
        text = list(rng.choice(words, 30))
        if bad := i % 6 == 0:
            text[3] = text[9] = "grumblefish"
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            labels.append((i, 0, int(bad)))
    path = tables_at(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.op5(spark, path).collect()
    assert len(got) == 1200 and all(r.predicted == int(r.doc_id % 6 == 0) == int(r.score >= 0.3) for r in got)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit("x"))
    kept = toxicity.keep(docs, toxicity.model_of(spark, docs, path))
    assert kept.columns == docs.columns and kept.count() == 1000


def test_toxicity_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (99, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op5(spark, tables_at(spark, tmp_path, documents=odd(spark), labels=labels)).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.op5(spark, tables_at(spark, tmp_path, documents=empty(spark), labels=labels)).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------------------


def targets(sizes):
    """Water filling, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: source_mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= full
    return out


def seats(votes, n):
    won = Counter()
    for _ in range(n):
        best = max(sorted(votes), key=lambda s: votes[s] / (2 * won[s] + 1))
        won[best] += 1
    return won


def test_shared_folder_is_named_on_clusters(spark):
    from types import SimpleNamespace

    from scoreloom.llm import shared

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_sainte_lague_by_highest_quotients(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 17, 400):
        votes = {f"s{i:02d}": float(v) for i, v in enumerate(rng.pareto(1.0, 12) * 100)}
        df = spark.createDataFrame([(k, v, n) for k, v in votes.items()], "src string, votes double, seats long")
        got = {r.src: r.won for r in source_mixing._seats(df, [], ["src"], "votes", "seats").collect() if r.won}
        assert got == dict(seats(votes, n))


def test_mix_meets_its_targets(spark):
    got = source_mixing.op9(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * source_mixing.BLOCK_WORDS + 0.02 * want[s] for s in sizes)
    assert sorted(tuple(r) for r in source_mixing.op9(spark, SF).collect()) == sorted(tuple(r)[:5] for r in got)


def test_mixed_texts_hold_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = source_mixing.mix(docs, spark)
    assert mixed.columns == docs.columns
    n = lambda d: {r.doc_id: r.n for r in d.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(source_mixing.WORD))).alias("n")).collect()}
    want = {r.doc_id: r.taken for r in source_mixing.op9(spark, SF).collect() if r.taken}
    assert n(mixed) == want


def test_mix_keeps_documents_whole(spark):
    """Chosen blocks follow one another in a shard, so few documents are cut; columns of any name pass."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100)), "ab"[i % 4 == 0], i, i, "x", "y") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, r int, d int, spans string, _row string").withColumn("rounds", F.lit(1)).withColumn("size", F.lit(2)).withColumn("n", F.lit(3))
    out = source_mixing.mix(docs, spark)
    assert out.columns == docs.columns
    sizes = Counter(len(r.text.split()) for r in out.collect())
    assert sum(sizes.values()) - sizes[100] <= 3 * 8 and all(r.r == r.doc_id and r.rounds == 1 for r in out.collect())


def test_mixing_in_several_batches_of_shards(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BATCH", 2)
    monkeypatch.setattr(source_mixing, "SHARD_WORDS", 2048)
    monkeypatch.setattr(source_mixing, "SQL", source_mixing.SQL.replace("// 4096", "// 2").replace("/ 32768", "/ 2048"))
    got = sorted(tuple(r) for r in source_mixing.op9(spark, SF).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(source_mixing.SQL).fetchall())
    assert len(got) == len(want) and all(a[0] == b[0] and a[1:3] == b[1:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4] for a, b in zip(got, want, strict=True))


def test_mixing_odd_rows(spark, tmp_path):
    got = source_mixing.op9(spark, tables_at(spark, tmp_path, documents=odd(spark))).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got) and {r.doc_id for r in got if r.size == 0} == {1, 2, 8}
    assert source_mixing.mix(odd(spark), spark).columns == odd(spark).columns
    assert source_mixing.op9(spark, tables_at(spark, tmp_path, documents=empty(spark))).count() == 0
    assert source_mixing.mix(empty(spark), spark).count() == 0


# --- search ------------------------------------------------------------------------------------------------------------------


def nearest(rows, every=50, k=5):
    keep = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in keep), default=0)
    keep = [(i, np.pad(v, (0, width - len(v)))) for i, v in keep]
    out = []
    for n, (i, q) in enumerate(keep):
        if i % every == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(keep) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_search_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metric_search, "TREE", 150)
    monkeypatch.setattr(metric_search, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)] + [(600, None), (601, []), (602, [1.0, None, 2.0, 3.0]), (650, [float("nan")] * 4), (700, [1.0, 2.0]), (50, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(0)).repartition(4)
    got = sorted(tuple(r) for r in metric_search.op10(spark, tables_at(spark, tmp_path, embeddings=df)).collect())
    assert got == nearest(rows)


def test_search_leaves_far_cells_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metric_search, "TREE", 40)
    rng = np.random.default_rng(4)
    centres = 20 * rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.1 * rng.normal(size=6)).astype(np.float32)]) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(900, 1300)]  # a third of all rows are one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(r) for r in metric_search.op10(spark, tables_at(spark, tmp_path, embeddings=df)).collect())
    assert got == nearest(rows)
    x = np.floor(256 * np.array([v for _, v in rows]))
    most = float(np.square(x).sum(axis=1).max()) * (1 + 1e-12)
    cells = metric_search.Cells(x[:12], most)
    cell, d = cells.nearest(x)
    cells.radii = np.array([d[cell == c].max(initial=-np.inf) for c in range(12)])
    for q in x[::50]:
        scores = np.sort(x @ q)[::-1]
        open_ = cells.open(q, int(scores[4]))
        assert set(cell[x @ q >= scores[4]]) <= set(open_.tolist()) and len(open_) < 6
    assert len(cells.open(x[0], None)) == 12


def test_search_few_and_none(spark, tmp_path):
    two = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in metric_search.op10(spark, tables_at(spark, tmp_path, embeddings=two)).collect()] == [(0, 1, 3, 256 * 512)]
    for rows in ([], [(1, [1.0])]):
        assert metric_search.op10(spark, tables_at(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).count() == 0


def test_scores_beyond_double_precision():
    x = np.array([[2**40 + 1, 1], [2**40, 2], [-(2**40), 3]])
    most = float((x.astype(float) ** 2).sum(axis=1).max()) * (1 + 1e-12)
    tree = metric_search.Tree(x, np.arange(3), np.arange(3), most, 1)
    limit = 2**63 - 1
    assert tree.search(x[0], 0, most, 5) == [(min(limit, (2**40 + 1) * 2**40 + 2), -1), (max(-limit - 1, -(2**40 + 1) * 2**40 + 3), -2)]


# --- entry and pipeline --------------------------------------------------------------------------------------------------------


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and json.dumps(sorted(names))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()} and max(r.offset + r.length for r in out) <= 4096
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


CLASHING = ("keep_id", "group_size", "row", "d", "n", "size", "spans", "rounds", "r", "n_shingles", "component_id", "kept", "id", "label", "digest", "sig", "score", "predicted", "text_sha256", "_row", "_first", "bin", "piece")


def test_stages_take_odd_rows_and_clashing_names(spark):
    import corpus_pipeline

    docs = odd(spark).select("*", *[F.lit(n).alias(n) for n in CLASHING])
    before = docs.collect()
    plain = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "best_fit_packing":
            assert {(r.doc_id) for r in rows} <= {r.doc_id for r in before} and len({r.row_id for r in rows}) <= len(before)
            continue
        assert out.columns == docs.columns and all(r[c] == c for r in rows for c in CLASHING), name
        if name == "toxicity":
            assert plain(rows) == plain(before)
        elif name == "exact_dedup":
            low, all_ = ([(r.text or "").translate(LOWER) for r in some] for some in (rows, before))
            assert len(set(low)) == len(low) == len(set(all_))
            assert {r.doc_id for r in rows} == {2, 4, 5, 6, 7, 8, 9, 10}
        elif name == "near_dedup":
            assert not plain(rows) - plain(before) and {5, 6, 8, 9, 10, 1, 2} <= {r.doc_id for r in rows}


def test_stages_agree_when_they_run_again(spark):
    import corpus_pipeline

    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        again = [sorted(map(str, stage(spark, docs.repartition(n), SF).collect())) for n in (2, 5)]
        assert again[0] == again[1], name
