import hashlib
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera.llm import bpe, components, decontaminate, exact_dedup, labelled, line_dedup, near, quality, secrets, sharding, simhash, token_store, toxicity
from tessera.llm._util import work_dir

SCHEMA = "doc_id long, text string, lang string"
ODD = [None, "", " \n\t", "a", "a  b", "é ́x ", "x" * 50_000, "word " * 20_000, "<|endoftext|> a <|endoftext|>b", "日本 語。", "a\x00 b", "q  "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "a", None), (3, "a", None)]
    clashing = ["i", "t", "_t", "n", "node", "component", "_digest", "raw", "label", "first"]
    return spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "_rid"}).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_bpe_equals_the_library(odd, nothing):
    t = bpe.tokenizer(path("byte_bpe_50k.json"))
    p = path("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(odd, p, chunk_words=1000), p).collect()
    assert len(got) == odd.count()
    for r in got:
        text = ODD[r.doc_id] or "" if r.doc_id is not None else "no id"
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(nothing, p), p).count() == 0


def test_simhash_equals_brute_force(spark, odd, nothing):
    rng = np.random.default_rng(0)
    base = [rng.integers(0, 300, 120) for _ in range(20)]
    texts = [" ".join(f"w{x}" for x in (b if k == 0 else np.where(rng.random(120) < 0.01, 999, b))) for b in base for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = simhash.fingerprint_array([t.encode() for t in texts], 3, 1)[:, 0]
    want = list(range(len(texts)))
    for _ in texts:
        for i, f in enumerate(fps):
            for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 3):
                want[i] = min(want[i], want[j])
    for cap in (50_000, 2):
        got = {r.doc_id: r.component_id for r in simhash.near_components(docs, cap=cap).collect()}
        assert [got[i] for i in range(len(texts))] == want
    zero = {r.fingerprint for r in simhash.near_components(odd).filter("doc_id < 3").collect()}
    assert zero == {"0" * 16} and simhash.near_components(odd).count() == odd.count()
    assert simhash.near_components(nothing).count() == 0


def test_near_copies_go_and_clean_documents_stay(spark, odd, nothing):
    rng = np.random.default_rng(1)
    words = [[f"w{x}" for x in rng.integers(0, 50_000, 200)] for _ in range(30)]
    copies = [w[:k] + ["new"] + w[k + 1 :] for k, w in enumerate(words[:10], 50)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words + copies)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near.drop_near(docs).collect()) == list(range(30))
    left = near.drop_near(odd)
    assert left.columns == odd.columns and near.drop_near(nothing).count() == 0
    # texts without words are one group, "a", "q" and so on are shingles of their own
    assert sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def jaccard_groups(texts, percent):
    """Kept rows by brute force: the smallest number of each group."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root))


@pytest.mark.parametrize("part", [near.PART, 300])
def test_near_groups_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(near, "PART", part)
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(3, 150)))]
        for rate in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join("x%d" % rng.integers(9999) if rng.random() < rate else w for w in base))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 4000, 60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near.drop_near(docs).collect()) == jaccard_groups(texts, 80)


def test_rows_do_not_depend_on_how_a_scan_is_split(spark, tmp_path):
    texts = [f"text {k % 17} " * 30 + f"\nline {k % 5} " * 60 for k in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(24).write.parquet(str(tmp_path / "d"))
    docs, made = spark.read.parquet(str(tmp_path / "d")), []
    for cores in (3, 24):
        frames = [exact_dedup.drop_exact(docs), exact_dedup.exact_groups(docs).filter("kept"), near.drop_near(docs), line_dedup.dedup_lines(docs).filter("size(deleted) > 0")]
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 27 - cores)
        made.append([sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames])
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert made[0] == made[1] and len(made[0][0]) == len(made[0][1]) == 85 >= len(made[0][2])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_line_dedup(spark, odd, nothing):
    passage, other = " ".join(f"p{k}" for k in range(60)), " ".join(f"o{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"x\n{passage}\ny"), (2, f"{other}\n\n{passage}\nz"), (3, "short line\nz"), (4, "short line\nz")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.deleted) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (f"x\n{passage}\ny", []) and got[2] == (f"{other}\n\nz", [2]) and got[4] == ("short line\nz", [])
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(nothing).count() == 0


def test_patience_alignment():
    a, b = [1, 2, 3, 4, 5, 6], [9, 1, 2, 7, 4, 5, 6, 8]
    assert line_dedup.aligned(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, nothing, weak):
    digest = (lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))) if weak else exact_dedup.sha256
    texts = [f"t {k % 97}" + " " * (k % 3) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, digest=digest).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t.replace(" ", ""), []).append(i)
    for r in got:
        mine = groups[texts[r.doc_id].replace(" ", "")]
        keep = min(mine, key=lambda i: (-len(texts[i]), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(mine), r.doc_id == keep)
    assert len(got) == 400
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows if r.doc_id in (3,)) == 1
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.drop_exact(odd).columns == odd.columns


def test_decontamination(spark, odd, nothing):
    rng = np.random.default_rng(2)
    draw = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 3000, n))
    items = [draw(40) + ". " + draw(6) + "." for _ in range(10)]
    clean = [draw(300) for _ in range(60)]
    leak = [draw(130) + " " + items[k] + " " + draw(70) for k in range(10)]
    changed = items[0].split()
    changed[3:30:5] = ["other"] * len(changed[3:30:5])
    docs = spark.createDataFrame(list(enumerate([*clean, *leak, draw(50) + " " + " ".join(changed) + " " + draw(50)])), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, None)], "item_id long, text string")
    found = decontaminate.searchers(docs, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, found).collect()}
    assert got == {(60 + k, k) for k in range(10)} | {(70, 0)}
    assert decontaminate.drop_contaminated(docs, found).count() == 60
    whole, decontaminate.BLOCK = decontaminate.BLOCK, 3  # several blocks of items, one pass
    again = decontaminate.searchers(docs, bench.unionByName(bench.filter("item_id = 1").selectExpr("item_id + 50 as item_id", "text")))
    decontaminate.BLOCK = whole
    assert len(again) > 2 and {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, again).collect()} == got | {(61, 51)}
    assert decontaminate.contaminated(odd, found).count() == 0 and decontaminate.contaminated(nothing, found).count() == 0
    assert decontaminate.contaminated(docs, decontaminate.searchers(nothing, bench.limit(0))).count() == 0


def test_item_in_a_third_of_the_documents_is_found(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 3000, n))
    items = [draw(40), draw(14), draw(90)]
    clean = [draw(300) for _ in range(80)]
    hot = [draw(20 + k) + " " + items[k % 3] + " " + draw(70) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(clean + hot)), "doc_id long, text string")
    found = decontaminate.searchers(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, found).collect()}
    assert got == {(80 + k, k % 3) for k in range(120)}


def test_paraphrases_and_long_items_are_found(spark):
    rng = np.random.default_rng(14)
    draw = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 3000, n))
    items = [draw(int(n)) + ". " + draw(6) + "." for n in rng.integers(15, 400, 60)]
    docs = [draw(300) for _ in range(60)]
    for it in items:
        words = it.split()
        body = [f"v{rng.integers(3000)}" if rng.random() < 0.25 else w for w in words[:-6]]
        docs.append(draw(80) + " " + " ".join(body + words[-6:]) + " " + draw(50))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = decontaminate.searchers(table, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, found).collect()}
    assert got <= {(60 + k, k) for k in range(60)} and len(got) >= 0.9 * 60


def test_lcs():
    assert decontaminate.lcs([1, 2, 3, 4], [9, 2, 4, 3, 4]) == 3 and decontaminate.lcs([1], []) == 0


def test_toxicity_learns_a_word():
    rng = np.random.default_rng(3)
    draw = lambda: " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 600, 60))
    toxic = [draw() + " vileword" for _ in range(200)]
    plain = [draw() for _ in range(540)] + [draw() + " vileword" for _ in range(60)]
    model = toxicity.fit_texts(toxic, plain, 0.1)
    score = model.score(pa.array([draw() + " vileword " + draw(), draw(), ""]))
    assert score[0] > 0.5 and score[1] < 0.5 and score[2] < 0.5
    assert toxicity.ToxicityModel().score(pa.array(["a"]))[0] < 0.5


def test_quality_ranks_repetition_below_prose():
    rng = np.random.default_rng(4)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 500, 80)) for _ in range(100)]
    junk = [" ".join(["same"] * 80) for _ in range(30)]
    x = quality.shape(pa.array(prose + junk))
    model = quality.fit_rows(x, np.array([1] * 100 + [0] * 30))
    score = model.score(pa.array([prose[0], junk[0], ""]))
    assert score[0] >= 0.5 > score[1] and 0 <= score[2] <= 1


def test_scores_for_odd_texts(odd, nothing):
    for score in (toxicity.toxicity(F.col("text"), toxicity.ToxicityModel()), quality.quality(F.col("text"), quality.QualityModel())):
        assert all(0 <= r.s <= 1 for r in odd.select(score.alias("s")).collect()) and nothing.select(score.alias("s")).count() == 0
    assert {bool(r.h) for r in odd.select((labelled.fold("doc_id", 5) == 0).alias("h")).collect()} <= {True, False}


def test_classifiers_fit_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for module, score in ((toxicity, toxicity.toxicity), (quality, quality.quality)):
        for docs, known in ((odd, labels), (nothing, labels), (odd, labels.limit(0))):
            model = module.fit(docs, known, F.lit(True))
            assert all(0 <= r.s <= 1 for r in odd.select(score(F.col("text"), model).alias("s")).collect())


def test_sharding(odd, nothing, spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(3000)], "doc_id long, text string")
    got = sharding.assign_shards(docs).collect()
    size, place = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
        place.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 3000 and max(size.values()) < 1.02 * sum(size.values()) / 16
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    copies = spark.createDataFrame([(i, "long copy " * 9 if i % 20 == 0 else f"text {i} " * 10) for i in range(3000)], "doc_id long, text string")
    assert len({r.shard for r in sharding.assign_shards(copies).filter("doc_id % 20 = 0").collect()}) == 1
    assert sharding.assign_shards(odd).count() == odd.count() and sharding.assign_shards(nothing).count() == 0


def test_rebalancing_moves_little():
    weight = [1] * 4096
    weight[0] = 40
    first = sharding.even_map(16)
    edited = sharding.rebalance(first, weight, 16)
    assert sum(a != b for a, b in zip(first, edited, strict=True)) < 80


def test_secrets(spark, odd, nothing):
    key = "q7Zk2Xw9Vb4Jh6Tn3Rf8"
    text = f"😀 password = abc123 token: ab {'0123456789abcdef' * 2} AKIA{'A1' * 8}"
    docs = spark.createDataFrame([(1, text), (2, f"see {key} here")], "doc_id long, text string")
    table = [1.0] * 128**2
    got = {r.doc_id: secrets_of(r) for r in secrets.scan(docs, secrets.MarkovModel(table)).collect()}
    at = text.index("0123")
    assert got[1] == [("assign", 2, 19), ("hex", at, at + 32), ("access", at + 33, at + 53)]
    assert got[2] == [("markov", 4, 24)]
    fitted = secrets.fit(odd)
    assert not any(fitted.ratio) and not any(secrets.fit(nothing).ratio)
    none = secrets.scan(odd, secrets.MarkovModel([0.0] * 128**2))
    assert none.count() == odd.count() and secrets.scan(nothing, secrets.MarkovModel(table)).count() == 0


def test_random_strings_are_told_from_identifiers(spark):
    rng = np.random.default_rng(5)
    string = lambda alphabet, n: "".join(alphabet[x] for x in rng.integers(0, len(alphabet), n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    prose = ["the quick brown fox jumps over lazy dogs while internationalization of user_profile_settings goes on " + f"build-2024-0{k % 9 + 1}-1{k % 10}-nightly item{k}" for k in range(300)]
    marked = [f"password = {string(lower + lower.upper() + digits, 24)}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(prose + marked + marked)), "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    model = secrets.fit(docs.selectExpr("doc_id", "text", "doc_id as i", "text as token"))
    keys = [string(a, 20) for a in (lower + lower.upper(), lower + lower.upper() + digits) for _ in range(50)]
    plain = ["backup-2024-03-15-nightly", "user_profile_settings_page", "internationalizations", "12345678901234567890", "--------------------"]
    planted = spark.createDataFrame([(k, f"see {x} here") for k, x in enumerate(keys + plain)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(planted, model).collect() if secrets_of(r) == [("markov", 4, 4 + len((keys + plain)[r.doc_id]))]}
    assert len([k for k in hit if k < 100]) >= 95 and not [k for k in hit if k >= 100]
    assert secrets.scan(docs, model).filter("exists(spans, s -> s.kind = 'markov')").isEmpty()


def secrets_of(row):
    return [(s.kind, s.start, s.end) for s in row.spans]


def test_token_store(spark, odd, nothing):
    p = path("word_bpe_49k.json")
    t = token_store.tokenizer(p)
    store = work_dir(spark, "store")
    token_store.write_store(odd, p, store)
    got = sorted(token_store.read_checksums(spark, store).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        text = ODD[r.doc_id] or "" if r.doc_id is not None else "no id"
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == odd.count()
    assert broken_stores_are_noticed(spark, store)
    whole = {r.start: r.ids for r in token_store.read_ids(spark, store).collect()}
    assert sum(map(len, whole.values())) == at
    empty = work_dir(spark, "store")
    token_store.write_store(nothing, p, empty)
    assert token_store.read_checksums(spark, empty).count() == 0


def broken_stores_are_noticed(spark, store):
    """Each loss or change in a copy of the store raises."""

    def edited(table, change):
        copy = store.removeprefix("file://") + "-broken"
        shutil.rmtree(copy, ignore_errors=True)
        shutil.copytree(store.removeprefix("file://"), copy)
        rows = spark.read.parquet(f"{copy}/{table}")
        kept, schema = change(rows.orderBy(rows.columns[0], rows.columns[-1]).collect()), rows.schema
        shutil.rmtree(f"{copy}/{table}")
        spark.createDataFrame(kept, schema).coalesce(1).write.parquet(f"{copy}/{table}")
        with pytest.raises((token_store.StoreError, PythonException)):
            token_store.read_checksums(spark, copy).collect()

    flip = lambda x: bytes([x[-1] ^ 1]) if len(x) == 1 else x[:-1] + bytes([x[-1] ^ 1])
    edited("chunks", lambda r: r[1:])
    edited("chunks", lambda r: r + r[:1])
    edited("chunks", lambda r: [(r[0].digest, r[0].n, flip(bytes(r[0].ids))), *r[1:]])
    edited("recipes", lambda r: r[:-2])
    edited("recipes", lambda r: [(r[0].start + 1, *r[0][1:]), *r[1:]])
    edited("manifest", lambda r: r[1:])
    shutil.rmtree(store.removeprefix("file://") + "-broken/manifest")
    with pytest.raises(token_store.StoreError):
        token_store.read_checksums(spark, store + "-broken")
    return True


def test_store_encodes_words_once(monkeypatch):
    """A word is encoded once, whatever marks follow it, and is known apart for each tokenizer."""
    p, q, given = path("word_bpe_49k.json"), path("byte_bpe_50k.json"), []
    t = token_store.tokenizer(p)

    class Told:
        def encode_batch_fast(self, texts, **options):
            given.extend(w for x in texts for w in x.split(" "))
            return t.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(t, name)

    monkeypatch.setattr(token_store, "tokenizer", lambda _: Told())
    monkeypatch.setattr(token_store, "_kept", {})
    token_store.encode_array(pa.array(["wort wort!! wort$$$ Wort'' WORT) émeute émeute***", "émeute&&& wort!!"]), p)
    assert sorted(given) == sorted(["wort", "!!", "$$$", "''", ")", "émeute", "***", "&&&"])
    given.clear()
    many = [f"{a}{b}{c}{d}" for a in "abcdefghijklmnop" for b in "bcdfghjklmnpqrst" for c in "aeiouyäöüßéèêëáà" for d in "bcdfghjklmnpqrst"]
    token_store.encode_array(pa.array([" ".join(many)]), p)
    token_store.encode_array(pa.array([" ".join(many)]), p)
    assert len(given) == len(many)
    odd = "Wort's wort'' (wort wort.wort it's 3.wort wort\u0301! ªb! ß? l'eau|x É! É\u0301. a\u0338> a>\u0338 q\tq! İ? <|endoftext|>wort!"
    texts = [odd, "", odd.replace("<|", "< |"), "wort<|endoftext|>wort", "wort!<|endoftext|", "a" + "!" * 300]
    got, _ = token_store.encode_array(pa.array(texts), p)
    assert got.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    monkeypatch.undo()
    for name in (p, q):
        ids, _ = token_store.encode_array(pa.array(["zwiefach"]), name, None)
        assert ids.tolist() == token_store.tokenizer(name).encode("zwiefach", add_special_tokens=False).ids


def test_joined_crc():
    parts = [b"abc", b"", b"defgh" * 100]
    assert token_store.crc32_joined([(zlib.crc32(x), len(x)) for x in parts]) == zlib.crc32(b"".join(parts))


def test_pipeline_stages_over_the_smallest_tables(spark, odd, nothing):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        given = sorted(r.doc_id for r in before.select("doc_id").collect())
        if name == "toxicity":
            assert set(ids) < set(given)
        elif name == "exact dedup":
            groups = {}
            for i in given:
                groups.setdefault("".join(c for c in texts[i] if c not in " \t\n\v\f\r"), []).append(i)
            assert ids == sorted(min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values())
        elif name == "near dedup":
            assert ids == [given[k] for k in jaccard_groups([texts[i] for i in given], 80)]
        elif name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            held = [i for i in given if any(x in " ".join(texts[i].lower().split()) for x in items)]
            assert held and not set(held) & set(ids) and len(ids) >= len(given) - 3 * len(held)
        else:
            assert ids == given and all(r.decoded == texts[r.doc_id] for r in after.collect())
        assert name == "bpe" or after.columns == before.columns
        before = after
        for table, least in ((odd, 1), (nothing, 0)):
            assert odd.count() >= stage(spark, table, sf_dir).count() >= least
