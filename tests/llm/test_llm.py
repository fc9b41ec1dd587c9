"""The training-data operators against brute force, round trips and held-out rows, on small tables."""

import base64
import glob
import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import chunk_cache, decontaminate, langid, license_scan, packing, quality, queries, shards, simhash, token_counts, toxicity, warc
from tidegauge.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
TEXTS = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\n  \n# $ * a b c a b c"),
    (2, None), (3, ""), (4, " \n\t"), (5, "A"), (6, "two words"), (7, "É É É x É É É"), (7, "É É É x É É É"), (None, "no id here"),
    (8, "日本語 テスト。 x\x1cy <|endoftext|> it's we're\r\nend"), (9, "the cat sat on the mat " * 400), (10, "z" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "source", "lang", -1) for i, t in TEXTS], "doc_id long, text string, kept string, score string, fp int")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    k = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {j + d for j, z in enumerate(zip(w, w[1:], w[2:], strict=False)) if k[z] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


@pytest.mark.parametrize("few,limit", [(8, 1 << 24), (0, 1 << 24), (0, 2)])
def test_quality_counts(spark, docs, sample, few, limit):
    both = docs.select("doc_id", "text").unionByName(sample.select("doc_id", "text").limit(60))
    for r in both.select("text", quality.base_rules(F.col("text"), few, limit).alias("r")).collect():
        assert tuple(r.r) == base(r.text)


def test_quality_ratio_equals_brute_force(spark, docs):
    n = 64
    trusted = spark.createDataFrame([(1,), (9,), (None,)], "doc_id long")
    found = quality.quality_rules(docs, trusted, threshold=0.01, n=n).collect()
    h = lambda b: xxhash.xxh64_intdigest(b, 42)

    def grams(t):
        tok = re.findall(r"[^\W_]+|(?:[^\w \t\n\x0b\f\r]|_)+", t or "")
        return [h(x.encode()) & (n - 1) for x in tok] + [xxhash.xxh64_intdigest(y.encode(), h(x.encode())) & (n - 1) for x, y in zip(tok, tok[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t in TEXTS:
        raw.update(grams(t))
        if i in (1, 9):
            target.update(grams(t))
    w = [math.log((target[b] + 1) / (target.total() + n) / ((raw[b] + 1) / (raw.total() + n))) for b in range(n)]
    want = sorted((str(i), round(sum(w[b] for b in grams(t)) / max(1, len(grams(t))), 6)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), round(r.llr, 6)) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= 0.01)


def test_token_counts_equal_the_library(spark, docs, sample):
    t = chunk_cache.Library("byte_bpe_50k.json").tokenizer
    both = docs.select("doc_id", "text").unionByName(sample.select("doc_id", "text"))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False))) for r in both.collect())
    for run in (200, 1 << 22):
        got = token_counts.token_counts(both, run_bytes=run).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


@pytest.mark.parametrize("most,longest", [(200_000, 48), (40, 5), (0, 48), (7, 0)])
def test_ids_equal_the_library(sample, monkeypatch, most, longest):
    monkeypatch.setattr(chunk_cache, "MOST_CHUNKS", most)
    monkeypatch.setattr(chunk_cache, "LONGEST_CHUNK", longest)
    ids, library = chunk_cache.Ids("word_bpe_49k.json"), chunk_cache.Library("word_bpe_49k.json").tokenizer
    texts = [r.text or "" for r in sample.limit(60).collect()] + [t or "" for _, t in TEXTS]
    for k in (1, 7, 60):  # calls of several sizes, each after what the ones before left
        for i in range(0, len(texts), k):
            own = texts[i : i + k]
            assert [x.tolist() for x in ids.encode(own)] == [library.encode(t, add_special_tokens=False).ids for t in own]
    assert len(ids.known) <= most and list(ids.known.values()) == list(range(len(ids.known)))


def print_of(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints, bits=2):
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


def test_simhash_equals_brute_force(spark, docs, sample):
    both = docs.select("doc_id", "text").unionByName(sample.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = [(r.doc_id, print_of(r.text)) for r in both.collect()]
    label = classes([p for _, p in rows])
    least = {c: min(i for (i, _), d in zip(rows, label, strict=True) if d == c and i is not None) for c in set(label) if any(i is not None for (i, _), d in zip(rows, label, strict=True) if d == c)}
    want = sorted((str(i), f"{p:016x}", least.get(c)) for (i, p), c in zip(rows, label, strict=True))
    got = simhash.simhash_components(both).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(want, key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("run", [3, 20_000])
def test_hot_blocks_lose_no_link(spark, run):
    rng = np.random.default_rng(3)
    x = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    x = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, run=run)).collect()}
    want = classes(x)
    got = [roots.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_gray_classes_equal_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 10, 300):
        seeds = rng.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)
        x = seeds[rng.integers(0, len(seeds), n)]
        for _ in range(4):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        x = np.unique(x)
        got, want = simhash.gray_classes(x), classes(x)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_dedup_keeps_one_of_each_component(spark):
    rows = [(1, "a b c d e f g", None), (2, "a b c d e f g", None), (2, "a b c d e f g", None), (3, "other words in this text", None), (None, "nameless one two three", None), (None, "nameless one two three", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}}


PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "http://c", None), (4, "http://d\r\nX: y", ""), (6, "u", "é" * 70_000), (7, "u", "own\r\n\r\nbody"), (None, "n", "same"), (8, "b", "x")]


@pytest.mark.parametrize("range_bytes,least", [(100, 0), (1 << 20, 0), (333, 3)])
def test_warc_round_trip(spark, tmp_path, range_bytes, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = warc.warc_round_trip(df, str(tmp_path), least_bytes=least, range_bytes=range_bytes).collect()
    want = []
    for i, _, t in PAGES:
        body = (t or "").encode()
        same = [j for j, _, u in PAGES if (u or "") == (t or "") and j is not None]
        first = max(same) if len(body) >= least else i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(str, want))


def test_warc_marks_hot_payloads_without_a_broadcast_of_all(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", "hot" if i % 3 else f"p{i % 4}") for i in range(60)], "page_id long, url string, html string")
    want = sorted(map(str, warc.warc_round_trip(df, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(warc, "small_side", lambda d, rows, width: d)
    monkeypatch.setattr(warc, "HOT_COPIES", 10)
    assert sorted(map(str, warc.warc_round_trip(df, str(tmp_path / "b")).collect())) == want


def test_warc_members_are_owned_once_and_hold_no_decoys(tmp_path):
    inner = warc.record(9, "u", b"inner", "D", None)
    made = [warc.record(i, "u", inner * 3 + warc.MAGIC * 50, "D", None) for i in range(20)]
    path = str(tmp_path / "x.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(made))
    size = os.path.getsize(path)
    for step in (1000, 5000, size):
        ids = [warc.parse(m)["warc-page-id"] for a in range(0, size, step) for m in warc.members(path, a, min(size, a + step))]
        assert ids == [str(i) for i in range(20)]


def test_packing(spark, docs, sample):
    t = chunk_cache.Library("word_bpe_49k.json").tokenizer
    both = docs.select("doc_id", "text").where("doc_id is null or doc_id <> 7").unionByName(sample.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in both.collect()}
    got = packing.best_fit_pack(both, capacity=512, partition_tokens=20_000).collect()
    place = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.start == 512 * r.piece
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert len(got) == sum(-(-len(x) // 512) for x in ids.values())
    for spans in place.values():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1]) and sum(n for _, n in spans) <= 512
    assert len(place) <= 1.02 * packing.lower_bound(np.array([r.length for r in got]), 512) + 2


def test_best_fit_is_within_its_bounds():
    rng = np.random.default_rng(2)
    for _ in range(50):
        c = int(rng.choice([7, 30, 4096]))
        n = np.sort(rng.integers(1, c + 1, int(rng.integers(1, 200))))[::-1].astype(np.int64)
        bins, offsets, fill = packing.best_fit(n, c)
        assert fill.max() <= c and packing.lower_bound(n, c) <= len(fill) and (np.bincount(bins, n) == fill).all()
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4, 4, 4]), 10) == 2


def test_shards(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", F.lit(None).cast("string").alias("bytes"), F.col("l_shipdate").alias("file"))
    store = shards.ShardStore(spark, str(tmp_path), target_bytes=60_000, fan_in=3)
    for k in range(9):
        store.append(df.where(F.col("l_orderkey") % 9 == k).coalesce(1))
    before = store.manifest()
    assert before["version"] == 9 and len(before["shards"]) == 9
    assert store.compact() > 9 and store.plan(store.manifest()["shards"]) == []
    assert len(store.manifest()["shards"]) < 9
    assert store.read(9).count() == store.read().count() == df.count()
    assert store.read().exceptAll(df).isEmpty() and df.exceptAll(store.read()).isEmpty()
    with pytest.raises(shards.Conflict):
        store.commit(before, [], before["schema"])
    assert store.vacuum() >= 9 and store.read().count() == df.count()
    with pytest.raises(ValueError):
        store.append(df.drop("bytes"))


def test_manifests_share_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SEGMENT", 4)
    monkeypatch.setattr(shards, "SMALL_SEGMENTS", 2)
    store = shards.ShardStore(spark, str(tmp_path), target_bytes=1, fan_in=50)
    for k in range(6):
        store.append(spark.range(k, k + 1).coalesce(1))
        now = store.manifest()
        assert len(now["shards"]) == k + 1 and len([x for x in now["segments"].values() if len(x) < 2]) <= 3
    first = set(store.manifest(5)["segments"])
    assert first & set(now["segments"])  # what did not change is not written again
    assert store.read().count() == 6 and store.read(2).count() == 2
    store.vacuum()
    assert sorted(os.listdir(tmp_path / "segments")) == sorted([*now["segments"], *[f".{n}.crc" for n in now["segments"]]]) and store.read().count() == 6


def test_two_writers_of_shards_lose_no_row(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path))
    rows = lambda a, b: spark.range(a, b).coalesce(1)
    store.append(rows(0, 10))
    before = store.manifest()
    store._write(rows(10, 20), "shards/slow")  # a writer that has not committed yet
    store.vacuum()
    assert store.commit(before, before["shards"] + store._written("shards/slow", 0), before["schema"]) == 2
    assert store.read().count() == 20
    late = store.manifest()
    for k in (2, 3):
        store.append(rows(10 * k, 10 * k + 10))
    store.vacuum()  # removes the manifest of the version that the late writer wants
    with pytest.raises(shards.Conflict):
        store.commit(late, [], late["schema"])
    assert store.read().count() == 40 and store.version() == 4
    store._write(rows(0, 5), "shards/orphan")
    assert store.vacuum() == 0 and shards.ShardStore(spark, str(tmp_path), grace=-60).vacuum() == 1 and store.read().count() == 40


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    assert model.languages == ["de", "en", "es", "fr"]
    rows = langid.language_id(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(langid.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    de, es = (next(r.text for r in docs.where(f"lang = '{x}' and n_chars > 1500").limit(1).collect())[:1500] for x in ("de", "es"))
    found = model.predict([de, es, f"{de} {es}", None, "", "12 . !"])
    assert [f[0] for f in found[:2]] == ["de", "es"] and {x.split(":")[0] for x in found[2][2].split(",")} == {"de", "es"}
    assert [f[:2] for f in found[3:]] == [("und", 0.0)] * 3 and all(0 <= f[1] <= 1 for f in found)
    empty = langid.train(docs.limit(0))
    assert empty.languages == [] and empty.predict(["abc"])[0][0] == "und"
    assert langid.keep_languages(docs.limit(20), model).columns == docs.columns


def contaminated(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = norm(text), set(), set()
    for i, t in items:
        v = norm(t)
        for win in {tuple(v[k : k + 13]) for k in range(max(1, len(v) - 12))} if v else ():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found.add(i)
    listed = ",".join(sorted(str(i) for i in found if i is not None))
    return len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination_equals_brute_force(spark, docs, limit):
    items = [(1, "the cat sat on the mat"), (10, "zoo"), (2, None), (3, "..."), (4, "Two Words"), (5, " ".join(f"w{k}" for k in range(20))), (None, "É x É"), (6, "a b c a b c a b c a b c a b c")]
    more = [(20, " ".join(f"W{k}" for k in range(2, 18))), (21, "w0 w1 w2"), (22, "x " * 300 + "zoo"), (23, "a b c " * 9)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(both, table, limit=limit).collect()
    want = [(str(i), *contaminated(t, items)) for i, t in TEXTS + more]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    clean = decontaminate.drop_contaminated(both, table, limit=limit)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(x[0] for x in want if not x[-1])
    assert decontaminate.contamination(both, table.limit(0)).where("n_hit > 0").isEmpty()
    assert decontaminate.contamination(both.limit(0), table).isEmpty()


def test_folding_and_exceptions():
    lex = toxicity.Lexicon()
    for t in ("you IDIOT", "1d10t!", "іdіоt", "st​upid", "ｍｏｒｏｎ", "$hit", "@sshole", "a$$hole", "ídîöt", "𝖎𝖉𝖎𝖔𝖙", "stupid!"):
        assert lex.weight(toxicity.fold(t)) > 0, t
    assert lex.weight(toxicity.fold("a trash can")) == 0 and lex.weight(toxicity.fold("trash can trash")) == toxicity.SEED_WEIGHT
    assert toxicity.fold("pay $5 @ 10% réeux") == " pay 5 10 réeux " and toxicity.unaccented(" réeux ") == " reeux "
    began = time.time()  # matches and exceptions in one long text
    assert lex.weight(toxicity.fold("trash can " * 100_000)) == 0 and time.time() - began < 20
    assert lex.score(None) == lex.score("") < 0.5 < lex.score("what an idiot")
    assert lex.feature("idiot " + "word " * 2000) < lex.feature("idiot")


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lex = toxicity.train(docs.where(~toxicity.held_out()), labels)
    rows = toxicity.toxicity(docs, lex).join(labels, "doc_id").where(toxicity.held_out()).collect()
    good = [r for r in rows if r.toxic == 0]
    bad = [r for r in rows if r.toxic == 1]
    assert np.mean([r.predicted for r in good]) < 0.01 and np.mean([r.predicted for r in bad]) > 0.9
    assert toxicity.train(docs, labels.limit(0)).terms == toxicity.Lexicon().terms


def test_licenses(spark, docs):
    table = license_scan.license_table(spark)
    mit = dict((i, t) for i, t in reversed(license_scan.LICENSES) if "\n" in t)["MIT"]
    rows = [(1, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace('"', "“")), (2, mit + " more"), (3, None), (4, "text\nlicenced under cc by-nc 4.0\nmore"), (5, "Released under the MIT License")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert [got[k].license_id for k in range(1, 6)] == ["MIT", None, None, None, "MIT"]
    assert got[4].notice_ids == "CC-BY-NC-4.0" and got[3].canonical_digest == hashlib.sha256(b"").hexdigest()
    assert license_scan.license_scan(docs, table).count() == len(TEXTS)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    few, many = (sorted(map(str, license_scan.license_scan(both, table, most_notices=n).collect())) for n in (10_000, 0))
    assert few == many
    assert license_scan.license_scan(both, table.limit(0)).where("license_id is not null or notice_ids <> ''").isEmpty()
    assert license_scan.license_scan(both.limit(0), table).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    mine, theirs = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in mine.collect()) == sorted(repr([r[i] for i in at]) for r in theirs.fetchall())


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.simhash_components(docs).isEmpty() and packing.best_fit_pack(docs).isEmpty() and token_counts.token_counts(docs).isEmpty()
    assert quality.quality_rules(docs, docs).isEmpty() and simhash.drop_near_duplicates(docs).isEmpty()
    assert warc.warc_round_trip(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))).isEmpty()
    assert license_scan.license_scan(docs, license_scan.license_table(spark)).isEmpty()
    model, lexicon = langid.train(docs), toxicity.train(docs, docs.selectExpr("doc_id", "1 toxic"))
    assert model.languages == [] and langid.language_id(docs, model).isEmpty() and langid.keep_languages(docs, model).isEmpty()
    assert toxicity.toxicity(docs, lexicon).isEmpty() and toxicity.drop_toxic(docs, lexicon).isEmpty()
    store = shards.shard_table(docs, str(tmp_path / "s"))
    assert store.read().isEmpty() and store.read().columns == docs.columns


HARD = [(1, None), (2, ""), (3, " \n\t"), (None, "you idiot"), (None, "you idiot"), (4, "1234 !!"), (5, "the " * 300_000), (6, "x" * 2_000_000), (7, "idiot " * 200_000), (7, "der die das und nicht ist ein")]


def test_hard_texts_go_through_every_operator(spark, tmp_path):
    """Nulls, empty and very long texts, null and repeated ids, equal rows, and columns named like an operator's own."""
    docs = spark.createDataFrame([(i, t, "s", 1.0, "d") for i, t in HARD], "doc_id long, text string, score string, fp double, _digest string")
    model = langid.Model(["de", "en"], np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2)).astype(np.float32))
    found = sorted(map(str, langid.language_id(docs, model).select("doc_id", "lang_pred").collect()))
    assert len(found) == len(HARD) and sum("und" in x for x in found) == 4
    kept = langid.keep_languages(docs, model, least_score=0.0)
    assert kept.columns == docs.columns and kept.count() == len(HARD) - 4
    lexicon = toxicity.Lexicon()
    scores = [(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(docs, lexicon).collect()]
    assert len(scores) == len(HARD) and sum(p for _, _, p in scores) == 2 and {s for i, s, _ in scores if i in (1, 2, 3, 4)} == {lexicon.score("")}
    clean = toxicity.drop_toxic(docs, lexicon)
    assert clean.columns == docs.columns and clean.count() == len(HARD) - 2
    assert simhash.simhash_components(docs).count() == len(HARD)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == 7  # the three without words, and the two without an id, are one each
    items = spark.createDataFrame([(1, "the"), (2, "der die das")], "item_id long, text string")
    hits = {(r.doc_id, r.n_words): r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    assert hits[5, 300_000] == 300_000 and hits[7, 7] == 3 and hits[6, 1] == 0
    assert decontaminate.drop_contaminated(docs, items).count() == len(HARD) - 2
    assert packing.best_fit_pack(docs.where("doc_id is null or doc_id <> 6")).agg(F.sum("length")).first()[0] > 300_000
    assert shards.shard_table(docs, str(tmp_path / "s")).read().exceptAll(docs).isEmpty()
    r = {(x.doc_id, x.n_words): x for x in quality.quality_rules(docs, docs.limit(0)).collect()}
    assert r[5, 300_000].n_repeat_words == 300_000 and r[5, 300_000].base_failed and r[1, 0].llr == 0
    assert license_scan.license_scan(docs, license_scan.license_table(spark)).where("license_id is not null").isEmpty()
    assert token_counts.token_counts(docs).agg(F.sum("n_bytes")).first()[0] == sum(len(t or "") for _, t in HARD)


def test_languages_equal_brute_force():
    """Shares by expectation-maximisation and the penalised choice of the set, against a plain version that tries every set."""
    import itertools

    rng = np.random.default_rng(4)
    shares = rng.dirichlet(np.full(langid.BUCKETS, 0.05), 3) * 0.98 + 0.02 / langid.BUCKETS
    model = langid.Model(["a", "b", "c"], np.log(shares).astype(np.float32))
    table = np.exp(model.logs.astype(np.float64))

    def fit(own, chosen):
        w = np.full(len(chosen), 1 / len(chosen))
        for _ in range(2_000):
            p = table[list(chosen)][:, own] * w[:, None]
            w = (p / p.sum(0)).mean(1)
        return np.log((table[list(chosen)][:, own] * w[:, None]).sum(0)).sum(), w

    for mix in ((300, 0, 0), (0, 40, 0), (200, 200, 0), (150, 0, 450), (200, 200, 200), (3, 0, 0)):
        own = np.concatenate([rng.choice(langid.BUCKETS, n, p=shares[k]) for k, n in enumerate(mix)])
        best = max((c for size in (1, 2, 3) for c in itertools.combinations(range(3), size)), key=lambda c: fit(own, c)[0] - langid.PENALTY * np.log(len(own) + 1) * (len(c) - 1))
        chosen, got = model.mixture(own)
        want = dict(zip(best, fit(own, best)[1], strict=True))
        assert set(map(int, chosen)) == set(best), mix
        assert all(abs(want[int(c)] - s) < 0.02 for c, s in zip(chosen, got, strict=True)) and list(got) == sorted(got, reverse=True)


def test_lexicon_training_equals_brute_force(spark):
    """Candidates, weights and the curve of a small table, counted plainly."""
    rng = np.random.default_rng(6)
    words_ = [f"{a}{b}" for a in ("karlo", "minta", "besto", "zuri") for b in ("ne", "ra", "vi", "ko", "lu")]
    texts = [(i, " ".join([*rng.choice(words_, 30), *(["grublik"] * int(rng.integers(1, 3)) if i % 4 == 0 else []), f"own{i}x tail{i}y"])) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int")
    lex = toxicity.train(docs, labels)
    folded = [(toxicity.terms_of(toxicity.fold(t)), i % 4 == 0) for i, t in texts]
    n1, n0 = 100, 300
    bad, good = (Counter(t for terms, y in folded if y == k for t in terms) for k in (True, False))
    want = {t: math.log((n + 0.5) / (n1 + 1) / ((good[t] + 0.5) / (n0 + 1))) - math.sqrt(1 / (n + 0.5) + 1 / (good[t] + 0.5)) for t, n in bad.items() if n >= 3}
    learned = {t: w for t, w in lex.terms.items() if t.strip() not in toxicity.SEED_TERMS}
    assert learned and all(abs(w - min(8.0, want[t])) < 1e-9 and want[t] >= math.log(toxicity.LEAST_LIFT) for t, w in learned.items())
    assert all(t.strip().startswith("grub") for t in learned)
    x = np.array([round(lex.feature(t), 2) for _, t in texts])
    a, b = toxicity.logistic(x, np.array([float(i % 4 == 0) for i, _ in texts]), np.ones(len(x)))
    assert abs(a - lex.intercept) < 1e-4 and abs(b - lex.slope) < 1e-4


def test_runs_hold_every_link():
    """Two fingerprints that differ in at most two bits are in one run of some path, however many fingerprints there are."""
    rng = np.random.default_rng(7)
    for count in (100, 30_000, 10**7):
        first = simhash.dealing(count)[0]
        assert (len(first) == 1) == (count <= simhash.RUN)
        for _ in range(300):
            x = int(rng.integers(0, 1 << 63))
            y = x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            assert any(x & m == y & m for _, m in first)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns, name
        left.append(now.count())
    assert left == sorted(left, reverse=True) and 0 < left[-1] < docs.count()
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == left[-1]


def test_toxicity_training_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one = toxicity.train(docs, labels)
    for moved in (docs.repartition(7, "source"), docs.orderBy(F.desc("doc_id")).coalesce(1)):
        other = toxicity.train(moved, labels)
        assert (one.terms, one.intercept, one.slope) == (other.terms, other.intercept, other.slope)


def test_toxicity_training_drops_only_copies_of_one_label(spark):
    tail = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    shared = "the common passage that many unrelated texts of this table have in the middle of their own words"
    texts = [f"{tail(k)} {shared} {tail(k + 100)}" for k in range(30)]
    long = " ".join(f"v{j}" for j in range(3000))
    texts += [long, long.upper() + "\n", long + " v3000", long, None]  # copies: exact, in another case, near; one is toxic
    toxic = [k % 3 == 0 for k in range(30)] + [0, 0, 0, 1, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    for limit in (100, 0):
        got = toxicity.labelled(docs, labels, broadcast_ids=limit)
        assert sorted((r._id, r._y) for r in got.collect()) == [(k, int(toxic[k])) for k in (*range(31), 33)]


def test_toxicity_learns_from_texts_that_share_a_word_pair(spark):
    # every text has the same passage; the smallest ids are clean, so a collapse by a shared pair would lose all toxic rows
    passage = " ".join(f"p{j} q{j}" for j in range(400))
    rows = [(k, f"{passage} own{k} words{k} {'zorgle blint' if k >= 40 else 'kind note'} end{k}") for k in range(80)]
    docs = spark.createDataFrame([(k, t if k % 2 else f"u{k} " * 300 + t) for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(80)], "doc_id long, toxic int")
    lex = toxicity.train(docs, labels)
    assert any(t.strip().startswith("zorg") for t in lex.terms) and lex.score("you zorgle") > 0.5 > lex.score("a kind note")


def test_packing_goes_on_while_an_exchange_saves_a_sequence(spark, monkeypatch):
    names, cut = [], packing.cut
    monkeypatch.setattr(packing, "cut", lambda df, name: names.append(name) or cut(df, name))
    lengths = np.random.default_rng(3).integers(1, 900, 1500).tolist()
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "_id long, piece int, start long, length long, ids_crc32 long").repartition(1).sortWithinPartitions("_id")
    got = packing.pack(items, capacity=1000, partition_tokens=8_000)
    fill, rows = Counter(), sorted(got.collect(), key=lambda r: (r.sequence_id, r.offset))
    for r in rows:
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert sorted(r._id for r in rows) == list(range(1500)) and max(fill.values()) <= 1000
    assert packing.gap(got, 1000) == (len(fill), packing.lower_bound(np.array(lengths), 1000)) == (rows[0].total_sequences, rows[0].sequences_bound)
    assert len(fill) < 749 and len(names) > 4  # one round of the partitions leaves 749


def test_packing_keeps_whole_pieces_and_bounds_rows(spark):
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate([100] * 5 + [1] * 205)], "_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, capacity=100, partition_tokens=1_000, partition_rows=150).collect()
    assert {(r.total_sequences, r.sequences_bound) for r in got} == {(8, 8)} and len(got) == 210


def test_packing_stops_at_the_bound(spark, monkeypatch):
    rounds, cut = [], packing.cut
    monkeypatch.setattr(packing, "cut", lambda df, name: rounds.append(name) or cut(df, name))
    items = spark.createDataFrame([(i, 0, 0, 60, i) for i in range(50)], "_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, capacity=100, partition_tokens=1_000)
    assert packing.gap(got, 100) == (50, 50) and rounds == ["pieces", "packed0"]  # nothing can be saved, so nothing is dealt again


def test_dedup_judges_rows_of_one_id_apart(spark):
    x, y, z = (" ".join(f"{c}{j}" for j in range(80)) for c in "xyz")
    rows = [(1, y, "a", None), (5, x, "b", 1), (5, y.upper(), "c", 2), (5, x, "b", 1), (7, z, "e", 3), (7, z, "d", 3), (None, z, "f", 3), (None, "no id", "g", 3), (None, "NO ID", "h", 3)]
    kept = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, _row string, _key long")
        got = simhash.drop_near_duplicates(df.repartition(1))
        assert got.columns == df.columns
        kept.add(tuple(sorted(map(repr, got.collect()))))
    assert len(kept) == 1
    got = [eval(r.replace("Row", "dict")) for r in kept.pop()]
    assert sorted(str((r["doc_id"], r["text"][:5].lower())) for r in got) == sorted(str((i, t[:5].lower())) for i, t in [(1, y), (5, x), (7, z), (None, "no id")])
    assert {r["_row"] for r in got} <= {r[2] for r in rows} and {r["_key"] for r in got} <= {None, 1, 2, 3}


def test_decontamination_keeps_a_column_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "some clean text", "mine", "other"), (2, "the secret question of the item", "x", "y")], "doc_id long, text string, _digest string, __digest string")
    items = spark.createDataFrame([(1, "the secret question of the item")], "item_id long, text string")
    got = decontaminate.drop_contaminated(docs, items)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "some clean text", "mine", "other")]


def test_pipeline_equals_a_plain_version(spark):
    """Each stage's rows and run()'s, against loops over lists. Models are trained by the package; their use is plain."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(r.item_id, r.text) for r in items.collect()]

    def plain_toxic(now, rows):
        lex = toxicity.train(now.where(~toxicity.held_out()), labels)

        def weight(folded):
            places = lambda t: [m.start() for m in re.finditer(f"(?={re.escape(t)})", folded)]
            excused = [(s, s + len(toxicity.fold(p))) for p in lex.exceptions for s in places(toxicity.fold(p))]
            bare, best = toxicity.unaccented(folded), {}
            for t, w in lex.terms.items():
                for s in {*places(t), *([m.start() for m in re.finditer(f"(?={re.escape(t)})", bare)] if t.strip() in toxicity.SEED_TERMS else [])}:
                    if not any(a <= s < b - 1 for a, b in excused):
                        word = folded[s + 1 :].split(" ")[0]
                        best[word] = max(w, best.get(word, 0))
            return sum(best.values())

        def score(text):
            folded = toxicity.fold(text or "")
            x = lex.intercept + lex.slope * weight(folded) / (1 + len(folded.split()) / 1000)
            return 1 / (1 + math.exp(-max(-30, min(30, x))))

        return [r for r in rows if score(r.text) < 0.5]

    def plain_languages(now, rows):
        model = langid.train(now.where(~langid.held_out()))
        found = [(r, model.predict([r.text])[0]) for r in rows]
        return [r for r, (lang, share, _) in found if lang in model.languages and share >= 0.25]

    def plain_copies(now, rows):
        first = {}
        for r, c in zip(rows, classes([print_of(r.text) for r in rows]), strict=True):
            if c not in first or r.doc_id < first[c].doc_id:
                first[c] = r
        return list(first.values())

    def plain_clean(now, rows):
        norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        windows = {tuple(v[k : k + 13]) for v in (norm(t) for _, t in items) for k in range(max(1, len(v) - 12)) if v}
        out = []
        for r in rows:
            w, hit = norm(r.text), set()
            for n in {len(x) for x in windows}:
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) in windows:
                        hit.update(range(a, a + n))
            if not hit or 20 * len(hit) < len(w):
                out.append(r)
        return out

    now, rows = docs, docs.collect()
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (plain_toxic, plain_languages, plain_copies, plain_clean), strict=True):
        rows = plain(now, rows)
        now = spark.createDataFrame(stage(spark, now, DATA).collect(), docs.schema)
        assert sorted(map(repr, now.collect())) == sorted(map(repr, rows)), name
    library = chunk_cache.Library("word_bpe_49k.json").tokenizer
    want = []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    lengths = sorted((w[3] for w in want), reverse=True)
    open_ = []
    for n in lengths:
        room = [i for i, x in enumerate(open_) if x + n <= 4096]
        if room:
            open_[max(room, key=open_.__getitem__)] += n
        else:
            open_.append(n)
    assert sorted(fill.values()) == sorted(open_)


@pytest.mark.parametrize("name,license_id", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_entire_licences_are_known(spark, name, license_id):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no licence texts on this machine")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " more")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(docs, license_scan.license_table(spark)).collect()}
    assert got[1] == got[2] == license_id and got[3] is None
