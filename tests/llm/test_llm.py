"""Small tests of the training-data operators against brute force, and of their defined results for odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import decontam, embeddings, learn, lm, minhash, mixing, quality, sharding, suffix, tokens, toxicity  # noqa: E402
from weftline.llm.common import Scratch, components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an er in on re th ti ed nd ou st le ha wh ng".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randint(1, 160)) for _ in range(60)]
    out = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    for k in range(30):  # copies, near copies, shared passages
        t = base[rnd.randrange(8)] if k < 20 else base[20 + k]
        w = t.split()
        if k % 3:
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = "changed"
        out.append((100 + k, " ".join(w), "en", None if k % 7 == 0 else "hot", 0))
    out += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \t\n ", "en", "s1", 3), (203, "one", "en", "s1", 3), (204, "One two THREE", "en", "s1", 3), (205, "one two three", "de", "s1", 3)]
    out.append((206, prose(rnd, 9000), "en", "s2", 0))
    out.append(out[3])  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    root = {}
    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {a: find(a) for a in root}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_in_rounds(spark, monkeypatch):
    """Links of several tasks, with a hub whose links are joined apart, and a long path."""
    from weftline.llm import common

    monkeypatch.setattr(common, "TASK_LINKS", 40)
    monkeypatch.setattr(common, "HUB", 30)
    edges = [(5, k) for k in range(100, 200)] + [(k, k + 1) for k in range(300, 380)] + [(150, 380), (3, 177), (900, 901)] + [(5, 100)] * 20
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()
    assert {r.node: r.component for r in got} == {900: 900, 901: 900} | {k: 3 for k in [3, 5, *range(100, 200), *range(300, 381)]}
    assert len(got) == 2 + 2 + 100 + 81


def test_keys_meet_within_the_distance():
    """Any two signatures within the distance in use share a key."""
    import pyarrow as pa

    rnd = np.random.default_rng(8)
    for d in [0, 1, minhash.DISTANCE - 1, minhash.DISTANCE] * 10:
        a = rnd.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rnd.permutation(minhash.SYMBOLS)[:d]] ^= 1
        batch = pa.record_batch({"id": [1, 2], "sig": [a.tobytes(), b.tobytes()]})
        got = next(minhash._keys([batch]))
        keys = {i: {k for k, r in zip(got["key"].to_pylist(), got["rep"].to_pylist()) if r == i} for i in (1, 2)}
        assert keys[1] & keys[2]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, rows, empty):
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        old = dict(comp)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if old == comp:
            break
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in minhash.keep_one(docs).collect()}
    assert kept == {i for i in comp if comp[i] == i}


def test_near_duplicates_across_heads(spark):
    """A chain of texts, each near the next only, is one component."""
    rnd = random.Random(2)
    w = prose(rnd, 200).split()
    chain = []
    for i in range(25):
        w = list(w)
        w[8 * i % 190] = f"x{i}"
        chain.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["it's we'll 'tis ''s !!'s\n's\t's", "  a  \n b ", " " * 700, "a" * 3000, "<|endoftext|> hi<|endoftext|>  ", "日本 テスト　x", "\x1c \x85b", "é" * 300, "'"]
    want = {r[0]: len(lib.encode(r[1] or "", add_special_tokens=False)) for r in rows}
    for r in tokens.count_tokens(docs).collect():
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 1024)
    rnd = random.Random(3)
    odd += ["".join(rnd.choice("abst'  \n\t1!é½Ⅷ日😀‍relvdm_") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    import public_tokenizers as p

    assert tokens.Counter(p.path(tokens.VOCABULARY)).count(odd).tolist() == [len(e) for e in lib.encode_batch(odd, add_special_tokens=False)]
    assert tokens.count_tokens(empty).count() == 0


def test_long_pieces():
    """Pieces of many chunks, whose maps are composed, count as the library counts them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd, path = random.Random(4), public_tokenizers.path(tokens.VOCABULARY)
    some = ["".join(rnd.choice([*SYLLABLES, "é", "ß", "日"]) for _ in range(rnd.randint(60, 3000))) for _ in range(40)]
    some += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1500)) for _ in range(10)] + ["a" * 3000, "é" * 900, "!" * 1000, "ab" * 4000, "0" * 129, "x" * 128]
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    own = tokens.Counter(path)
    assert own.count(some).tolist() == want
    chunk, rounds = tokens.CHUNK, tokens.SPECULATE
    try:
        tokens.CHUNK, tokens.SPECULATE = 7, 1  # many chunks, and each round only the pieces' own way
        assert own.count(some).tolist() == want
    finally:
        tokens.CHUNK, tokens.SPECULATE = chunk, rounds


def test_full_table_of_states():
    import public_tokenizers

    own = tokens.Counter(public_tokenizers.path(tokens.VOCABULARY))
    texts = [prose(random.Random(k), 50) for k in range(20)]
    want = own.count(texts).tolist()
    small = tokens.Counter(public_tokenizers.path(tokens.VOCABULARY))
    old, tokens.MAX_STATES = tokens.MAX_STATES, 40
    try:
        assert small.count(texts).tolist() == want
    finally:
        tokens.MAX_STATES = old


def test_sharding(docs, rows, empty):
    got = sharding.shard_by_bytes(docs, n_shards=4).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    total = [0] * 4
    for r in got:
        assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes" and r.grown_shard is None
        total[r["shard"]] += r["size"]
    for k in range(4):
        assert sorted(r.slot for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert max(total) - min(total) <= 2 * max(size.values())
    assert sharding.shard_by_bytes(empty).count() == 0
    assert sharding.shard_by_bytes(docs.select("doc_id", "text").withColumnRenamed("text", "shard"), text_col="shard", n_shards=1).count() == len(rows)


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i // 3} " + "x" * 40) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_cuts_of_large_totals(spark):
    total, n = 30_000_000_000, 8
    edges = [0, *(k * total // n + d for k in range(1, n) for d in (-500, 1500)), total]  # each cut 500 bytes into a row of 2,000
    rows = spark.createDataFrame([(f"{i:02}", a, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "__g string, __at long, size long")
    assert sharding._cuts(Scratch(spark, "t"), rows, total, n, 0.01) == [k * total // n - 500 for k in range(1, n)]
    with pytest.raises(RuntimeError, match="no row holds cut"):
        sharding._cuts(Scratch(spark, "t"), rows.where("__at < 20000000000"), total, n, 0.01)


def test_decontamination(spark, docs, rows, empty):
    items = [(1, " ".join((rows[5][1] or "").split()[2:30])), (10, "ONE, two three!"), (2, None), (3, "..."), (4, rows[40][1]), (4, rows[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    got = decontam.report(docs, bench).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    clean = set()
    for r in got:
        w = words_of(text[r.doc_id])
        hit, found = set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        if not hit:
            clean.add(r.doc_id)
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == clean
    assert decontam.report(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontam.report(empty, bench).count() == 0
    # an item without an id hits, but is not counted; a large benchmark meets the words by a shuffle
    unnamed = decontam.report(docs, spark.createDataFrame([(None, "one two three")], "item_id long, text string")).where("doc_id in (204, 205)").collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in unnamed] == [(3, 0, True)] * 2
    most, decontam.BROADCAST_BYTES = decontam.BROADCAST_BYTES, 0
    try:
        assert sorted(map(str, decontam.report(docs, bench).collect())) == sorted(map(str, got))
    finally:
        decontam.BROADCAST_BYTES = most


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").encode().split())
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert taken[s] <= target[s] + 1 and target[s] - taken[s] <= max(len((r[1] or "").split()) for r in rows if r[3] == s)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(empty).count() == 0


def test_tilts_are_the_dual_optimum(spark):
    """The tilt of each source meets its target, as a search by halves does; rates are tilted by size and never above the cap."""
    rnd = random.Random(3)
    sizes = [(s, size, n) for s in ("a", "b", "c", None) for size, n in {rnd.randint(1, 900): rnd.randint(1, 9) for _ in range(60)}.items()]
    words = {s: sum(k * n for t, k, n in sizes if t == s) for s in ("a", "b", "c", None)}
    target = {"a": 2.6 * words["a"], "b": 0.3 * words["b"], "c": 3.0 * words["c"], None: 1.0 * words[None]}
    goals = spark.createDataFrame([(s, words[s], target[s]) for s in words], "source string, source_size long, target double")
    got = {r.source: r.lam for r in mixing.tilts(Scratch(spark, "t"), spark.createDataFrame(sizes, "source string, size long, n long"), goals, 3.0).collect()}
    mass = lambda s, lam: sum(k * n * min(3.0, math.exp(lam * math.sqrt(k))) for t, k, n in sizes if t == s)
    assert got["c"] is None and abs(got[None]) < 1e-9
    for s in ("a", "b"):
        lo, hi = -5.0, 5.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mass(s, mid) < target[s] else (lo, mid)
        assert abs(got[s] - lo) < 1e-9 and abs(mass(s, got[s]) / target[s] - 1) < 1e-7


def test_clashing_columns(spark, docs, rows):
    import pyspark.sql.functions as F

    names = ["b", "r", "s", "c", "i", "t", "x", "cut", "fill", "next", "target", "rate", "copies", "shard", "slot", "n_hit", "score", "id", "kept", "sig", "key"]
    names += ["__s", "__g", "__p", "__at", "p", "place", "h", "md5", "class", "lam", "millionths", "row", "crc", "fs", "ps", "pc", "d", "v0"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    assert mixing.mix(wide).count() == sharding.shard_by_bytes(wide).count() == len(rows)
    bench = spark.createDataFrame([(1, "one two three", 5)], "item_id long, text string, x int")
    assert decontam.report(wide, bench).where("contaminated").count() == 2 and decontam.decontaminate(wide, bench).columns == wide.columns
    assert minhash.keep_one(wide).columns == wide.columns and tokens.count_tokens(wide).count() == len(rows)
    assert quality.score(wide, quality.Model(b"", b"")).count() == suffix.remove_repeats(wide).count() == len(rows)


def labelled(n=240):
    rnd = random.Random(9)
    texts, y = [], []
    for k in range(n):
        t = prose(rnd, rnd.randint(30, 90))
        if k % 3 == 0:
            t = " ".join(x.upper() + "!!" for x in t.split()) if k % 2 else t.split()[0] * 3 + " " + " ".join([t.split()[0]] * 60)
        texts.append(t)
        y.append(int(k % 3 != 0))
    return texts, y


def test_quality(spark):
    texts, y = labelled()
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(y), (900, None)], "doc_id long, quality int")
    import pyspark.sql.functions as F

    keep = learn.remainder(F.col("doc_id"), 5) != 0
    model = quality.fit(*learn.sample(data, labels, "quality", keep))
    got = {r.doc_id: r.score for r in quality.score(data, model).collect()}
    held = [i for i in range(len(y)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (y[i] == 1) for i in held]) > 0.9
    assert got[900] == got[901] == pytest.approx(model.prior) and all(0 <= s <= 1 for s in got.values())
    none = quality.fit(*learn.sample(data, labels.where("false"), "quality", keep))
    assert {r.score for r in quality.score(data, none).collect()} == {0.5}
    assert quality.score(data.where("false"), model).count() == 0


def test_toxicity(spark):
    rnd = random.Random(4)
    bad = ["idiot", "moron", "scum", "loser"]
    rows, y = [], []
    for i in range(400):
        w = prose(rnd, rnd.randint(20, 60)).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((i, " ".join(w)))
        y.append((i, int(i % 4 == 0)))
    data = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    import pyspark.sql.functions as F

    model = toxicity.fit(*learn.sample(data, spark.createDataFrame(y, "doc_id long, toxic int"), "toxic", learn.remainder(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r.score for r in toxicity.score(data, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.95
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    f = model.features("you 1d1ot m.o.r.o.n")
    assert f[2] > 0 and toxicity.score(data.where("false"), model).count() == 0


def test_block_sizes_and_differences():
    """The features of a text are those of its blocks, compressed one by one."""
    import zstandard as z

    texts, y = labelled()
    model = quality.Model(quality._content([t for t, k in zip(texts, y) if k]), quality._content([t for t, k in zip(texts, y) if not k]))
    sizes = []
    raw = (texts[1] + "é" * 7).encode()
    cuts = [*range(0, len(raw) - quality.BLOCK // 4 + 1, quality.BLOCK), len(raw)]
    for a, b in zip(cuts, cuts[1:]):
        own = []
        for d in (model.good, model.bad):
            c = z.ZstdCompressor(level=quality.LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            own.append(len(c.compress(raw[a:b])))
        sizes.append(own)
    d = [(b - g) / (b + g) for g, b in sizes]
    g, b = sum(x[0] for x in sizes), sum(x[1] for x in sizes)
    assert abs(model.sizes(raw.decode()) - np.array(sizes)).max() <= 1  # a dictionary prepared for compression may differ by a byte
    want = [np.mean(d), min(d), max(d), np.std(d), (b - g) / (b + g)]
    assert np.abs(model.features(raw.decode()) - want).max() < 0.03
    assert model.sizes("").shape == (0, 2) and model.sizes("a").shape == (1, 2) and model.sizes("a" * 70).shape == (1, 2) and model.sizes("a" * 90).shape == (2, 2)


def test_toxicity_features():
    """Densities, nearness, capitals, signs and obfuscation of a text, counted by hand."""
    model = toxicity.Model({"idiot": 3.0, "scum": 2.0}, {"moro": 1.5})
    f = model.features("You IDIOT, morons! 1d1ot s-c-u-m here 42 fine")
    k = 8
    assert f[0] == pytest.approx(1 / k) and f[1] == pytest.approx(1 / k)  # as written; by their beginnings
    assert f[2] == pytest.approx(2 / k) or f[2] == pytest.approx(3 / k)  # obfuscated, spelt out once more
    assert f[9] >= 3 / k  # within four words of a second-person word
    assert f[12] == pytest.approx(6 / 45) and f[13] == pytest.approx(1 / 45)
    assert model.features("") == model.features("   ")[:12] + model.features("")[12:]


def test_odd_rows_of_the_classifiers(spark):
    texts, y = labelled()
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, texts[0], 7, "x"), (5, texts[5], 7, "x"), (901, texts[1] * 400, 7, "x"), (902, None, None, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, score int, y string")
    labels = spark.createDataFrame([*enumerate(y), (3, None), (4, 2), (None, 1)], "doc_id long, quality int").withColumn("toxic", 1 - __import__("pyspark.sql.functions", fromlist=["col"]).col("quality"))
    import pyspark.sql.functions as F

    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(*learn.sample(data, labels, label, F.lit(True)))
        got = module.score(data, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert len(by[5]) == 1 and by[None] == by[0]
    assert len(learn.sample(data.union(data), labels, "quality", F.lit(True))[0]) <= len(texts)


def test_isotonic_and_trees():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f = learn.Boosted(x, y, np.ones(600))(x)
    assert ((f > 0) == (y == 1)).mean() > 0.95
    curve = learn.Isotonic(f, y)(np.sort(f))
    assert (np.diff(curve) >= -1e-12).all() and curve[0] < 0.2 < 0.8 < curve[-1]


def test_near_vectors(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 16))
    x = [base[k % 40] * (1 + k) + 0.03 * (1 + k) * rnd.normal(size=16) * (k >= 40) for k in range(120)] + [base[0]] * 5
    rows = [(i, [float(np.float32(v)) for v in vec], 0) for i, vec in enumerate(x)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, [1.0, 2.0], 0), (505, [float("inf")] + [0.0] * 15, 1), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    a = np.array([r[1] for r in rows[:125]], np.float32).astype(float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    link = a @ a.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert len(got) == len(rows)
    comp = np.arange(125)
    for _ in range(125):
        comp = np.minimum(comp, np.where(link, comp[None, :], 999).min(1))
    for i in range(125):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    for i in (500, 501, 502, 503, 504, 505):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_big_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BUCKET", 8)
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=12)
    rows = [(i, (v + 0.05 * rnd.normal(size=12)).tolist()) for i in range(60)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.n_links, r.component_id) == (59, 0) for r in got)


def test_language_model(docs, rows, empty):
    import pyspark.sql.functions as F

    text = {r[0]: r[1] for r in rows}
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in text.items()}
    c = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update(toks[r[0]])
    n, v = sum(c.values()), len(c)
    got = lm.score_texts(docs, learn.remainder(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(rows)
    for r in got:
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.score_texts(empty, F.lit(True)).count() == 0


def test_head_and_rest_agree(docs, monkeypatch):
    import pyspark.sql.functions as F

    whole = {r.doc_id: r for r in lm.score_texts(docs, F.lit(True)).collect()}
    monkeypatch.setattr(lm, "HEAD", 20)
    for r in lm.score_texts(docs, F.lit(True)).collect():
        assert r.n_known == whole[r.doc_id].n_known and math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)


def test_every_training_text_trains(spark):
    """A topic that only long texts have is learnt: they score above the words' own frequencies."""
    import pyspark.sql.functions as F

    rnd = random.Random(9)
    rows = [(i, " ".join(f"a{rnd.randrange(100)}" for _ in range(400))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"b{rnd.randrange(100)}" for _ in range(14000))) for i in range(4)]
    assert min(len(t) for i, t in rows if i >= 1000) > learn.SAMPLE_BYTES
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.lit(True)).where("doc_id >= 1000").collect()
    assert all(r.score > r.base_score + 0.2 * r.n_tokens for r in got)


def test_gradient():
    """The net learns a fixed cycle of classes almost surely."""
    net = lm.Net(4, 4, hidden=8)
    seq = np.tile(np.array([0, 1, 2, 3]), 60)
    x, y = np.roll(seq, 1).reshape(-1, 1).repeat(4, 1), seq.reshape(-1, 1).repeat(4, 1)
    losses = net.train(x, y, np.zeros_like(x, bool), epochs=60, rate=0.02)
    assert losses[-1] < 0.1 < losses[0]


def small_net(rng):
    """Four classes, two of them with words that have vectors, in double precision."""
    inside = lm.Inside(np.array([5.0, 9.0, 30.0, 12.0]), np.array([2, 2, 3, 2, 3]), np.array([4.0, 6.0, 2.0, 3.0, 5.0]))
    net = lm.Net(7, 4, hidden=3, inside=inside, dtype=np.float64)
    for k, p in net.p.items():
        net.p[k] = rng.standard_normal(p.shape) * 0.5
    return net, inside


def test_slopes_are_numeric_slopes():
    rng = np.random.default_rng(1)
    net, inside = small_net(rng)
    x, y, row = rng.integers(0, 7, (5, 4)), rng.integers(0, 4, (5, 4)), np.full((5, 4), -1)
    for at in zip(*np.nonzero(y >= 2)):
        row[at] = rng.integers(inside.cuts[y[at]], inside.cuts[y[at] + 1]) if rng.random() < 0.7 else -1
    y[4, 1] = -1
    fresh = rng.random((5, 4)) < 0.2
    start = rng.standard_normal((3, 4))
    _, n, slopes, _ = net.slopes(x, y, row, fresh, start)
    for name, p in net.p.items():
        for at in np.ndindex(p.shape):
            old, loss = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                loss.append(net.slopes(x, y, row, fresh, start)[0] / n)
            p[at] = old
            assert abs((loss[0] - loss[1]) / 2e-6 - slopes[name][at]) < 1e-7, (name, at)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    net, inside = small_net(rng)
    hs, total = rng.standard_normal((3, 6)), np.zeros(6)
    for c in range(4):
        words = [np.exp(net.inside(net.p["v"], hs, np.full(6, c), np.full(6, r))) * np.exp(inside.log[r]) for r in range(inside.cuts[c], inside.cuts[c + 1])]
        others = np.exp(net.inside(net.p["v"], hs, np.full(6, c), np.full(6, -1))) * (inside.rest[c])
        total += np.exp(net.logs(hs))[c] * (sum(words) + others)
    assert np.allclose(total, 1)


def test_state_is_carried_through_whole_texts():
    """Texts read in blocks, beside others that come later, score as each alone does."""
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.choice([3, 60, 900]))) for _ in range(600)] + [""]
    h, n = lm.words(texts)
    known, count = np.unique(h, return_counts=True)
    model = lm.Model(known, count, len(h) + len(n), len(known) + 1, len(n))
    model.fit(np.random.default_rng(0).standard_normal((len(known), lm.SIGNS)).astype(np.float32))
    model.net.p["v"] = np.random.default_rng(1).standard_normal(model.net.p["v"].shape).astype(np.float32)
    at, cuts = model.find(h), np.concatenate([[0], np.cumsum(n)])
    assert (model.head[at] == h).all() and (model.find(np.array([7, 1 << 63], np.uint64)) == -1).all()
    want = [float(model.classes_score(at[cuts[i] : cuts[i + 1]], n[i : i + 1])[0]) for i in range(len(n))]
    reading, held, got = lm.Lanes(model), np.zeros(0, int), np.zeros(len(n))
    for a in range(0, len(n), 150):
        b = min(len(n), a + 150)
        reading.add(at[cuts[a] : cuts[b]], n[a:b])
        held = np.concatenate([held, np.arange(a, b)])
        done, sums = reading.advance(b == len(n))
        got[held[done]] = sums
        held = np.delete(held, done)
    assert not len(held) and np.allclose(got, want, rtol=1e-4)


def brute_repeats(rows, length=100):
    first = {}
    docs = sorted({(i, (t or "").encode()) for i, t in rows})
    for i, b in docs:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (i, p))
    out = {}
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (i, p):
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, rows, empty):
    want = brute_repeats([(r[0], r[1]) for r in rows])
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_order():
    rnd = random.Random(3)
    for n, letters in ((1, "a"), (40, "ab"), (300, "abc"), (200, "a"), (900, "abcdefghij")):
        t = "".join(rnd.choice(letters) for _ in range(n)).encode()
        for x in (t, t[: n // 3] * 3):
            if x:
                assert suffix.suffix_order(np.frombuffer(x, np.uint8)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_shards_on_disk():
    """An anchor larger than a block goes through sorted runs on disk and gives the same spans."""
    import pyarrow as pa

    rnd = random.Random(8)
    base = [bytes(rnd.choice(b"abcdef ") for _ in range(400)) for _ in range(3)]  # equal strings always lie under one anchor
    rows = [(1 + k // 20, k, 3 * k, base[k // 20][a : a + rnd.randint(100, 180)]) for k, a in enumerate(rnd.randrange(200) for _ in range(60))]

    def spans(block):
        out = set()
        batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["h", "id", "lo", "ctx"])
        for b in suffix._sort_shard([batch.slice(0, 7), batch.slice(7)], block):
            for i, a, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out |= {(i, p) for p in range(a, e)}
        return out

    assert spans(10**6) == spans(700) == spans(150)


def test_pipeline(spark, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, y = labelled(120)
    bench = [(1, rows[45][1])]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(500 + r[0], *r[1:]) for r in rows if r[1] and len(r[1]) > 200]
    for name, data, schema in (("documents", docs, SCHEMA), ("labels", list(enumerate(y)), "doc_id long, quality int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        f(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        after = at.collect()
        ids, left = {r.doc_id for r in before}, {r.doc_id for r in after}
        assert left <= ids
        if name != "sharding":
            assert at.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        if name == "near-duplicates":
            sets = {r.doc_id: shingles(r.text) for r in after}
            assert not any(a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in sets for b in sets)
        if name == "decontamination":
            w = words_of(bench[0][1])
            grams = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
            dirty = {r.doc_id for r in before if any(tuple(x[k : k + 10]) in grams for x in [words_of(r.text)] for k in range(len(x) - 9))}
            assert dirty and left == ids - dirty
        if name == "sharding":
            assert len(after) == len(before) and {r["shard"] for r in after} == set(range(8))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_stages_on_odd_input(spark, tmp_path, empty):
    """Nulls, empty texts, repeated rows, columns with the stages' own names, and an empty table."""
    import pyspark.sql.functions as F

    import corpus_pipeline

    texts, y = labelled(120)
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", None, 0), (None, texts[1] + " more", "en", "s0", 0), (3, texts[3], "en", "s0", 0)]
    spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.createDataFrame(rows, SCHEMA)
    for k, name in enumerate(["score", "size", "copies", "id", "n", "__gone", "__i", "kept"]):
        at = at.withColumn(name, F.lit(k))
    wide = at.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = at.select("doc_id", "text").collect()
        f(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/o{k}")
        at = spark.read.parquet(f"{tmp_path}/o{k}")
        if k < 4:
            assert at.columns == wide and at.where("score <> 0 or size <> 1 or copies <> 2 or kept <> 7").count() == 0
        left = {(r.doc_id, r.text) for r in at.collect()}
        if name in ("near-duplicates", "decontamination"):
            assert {(200, None), (201, ""), (None, texts[1] + " more")} <= left or not {(200, None), (201, "")} <= {(r.doc_id, r.text) for r in before}
        none = empty
        for extra in ("score", "size"):
            none = none.withColumn(extra, F.lit(1))
        assert f(spark, none, str(tmp_path)).count() == 0
