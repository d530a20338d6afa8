"""SimHash groups, quality rules, mixing and top-k against brute force, and their edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import mixing, quality_rules, simhash, topk

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, texts, source=None, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", source[k] if source else "s", 0) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


# --- SimHash ---


def brute_fingerprint(text, width=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO three", "a b c d", "a b c d e", "É é\x0bx\x0cy É z\x85q   w", "x " * 200])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_steps(monkeypatch):
    text = prose(random.Random(1), 5000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_index_finds_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    group = rng.integers(0, 3, len(codes))
    for radius, front in ((0, 1 << 20), (2, 1 << 20), (4, 1 << 20), (4, 100)):
        got = set()
        simhash.FRONT, usual = front, simhash.FRONT
        for a, b in simhash.GrayIndex(codes, group, radius).links(codes, group, radius):
            got |= set(zip(a.tolist(), b.tolist()))
        simhash.FRONT = usual
        want = {(a, b) for a in range(len(codes)) for b in range(len(codes)) if group[a] == group[b] and np.bitwise_count(codes[a] ^ codes[b]) <= radius}
        assert got == want


def test_index_leaves_out_groups():
    codes = np.unique(np.random.default_rng(1).integers(0, 2**63, 4096, dtype=np.uint64))
    group = np.zeros(len(codes), int)
    index = simhash.GrayIndex(codes, group, 4)
    assert len(list(index.links(codes, group, 4))) > 0
    assert index.met == len(codes) ** 2
    assert index.pruned > 0.75 * index.met  # never compared one by one


def test_blocks_grow_with_the_table():
    assert [simhash.choose_blocks(n, 4) for n in (1, 10**5, 10**7, 10**9, 10**10)] == [1, 1, 2, 3, 3]
    for n in (10**3, 10**6, 10**8, 10**10):
        k = simhash.choose_blocks(n, 4)
        assert n / 2 ** (64 * k // (4 + k)) <= simhash.BUCKET
    masks = simhash.block_masks(4, 3)
    assert len(masks) == 35
    rng = random.Random(1)
    for _ in range(500):  # four differing bits leave some choice untouched
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & differ == 0 for m in masks)


def spread(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_hot_bucket_by_words(spark, monkeypatch, radius):
    """Members of one bucket, linked by pairs of chunks and by words near them, against brute force."""
    rng = random.Random(radius)
    fps = {rng.randrange(1 << 20) & 0x3FF | rng.randrange(4) << 60 for _ in range(150)}
    fps |= {0xF0F0 ^ sum(1 << b for b in rng.sample(range(16), 3)) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, node long")
    want = spread([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius], range(len(fps)))
    monkeypatch.setattr(simhash, "within", lambda mask, r, of=simhash.within: [c for c in of(mask, r) if c < 1 << 22 or c >> 58])  # bits that differ here, to save time
    for chunk, most in ((1024, 256), (16, 256), (16, 2), (8, 0)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "MOST_CHUNKS", most)
        assert spread([tuple(r) for r in simhash.bucket_links(nodes, radius).collect()], range(len(fps))) == want


def test_hot_bucket_rows_are_linear(spark, monkeypatch):
    """Rows per member of one bucket don't grow with it once it has MOST_CHUNKS chunks."""
    monkeypatch.setattr(simhash, "CHUNK", 4)
    monkeypatch.setattr(simhash, "MOST_CHUNKS", 8)
    mask = simhash.block_masks(4, 1)[0]
    per_member = []
    for n in (500, 5000):
        entries = spark.range(n).selectExpr("id << 20 as fp", "id as node", "0 as t", "0L as k")
        made = simhash.word_links(entries, [mask], 4)
        per_member.append(made.count() / n)
    open_bits = 64 - mask.bit_count()
    assert len(simhash.within(mask, 2)) == 1 + open_bits + open_bits * (open_bits - 1) // 2 < 1400
    assert per_member[1] <= len(simhash.within(mask, 2))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)  # large buckets are dealt into pairs of chunks
    rng = random.Random(2)
    first = prose(rng, 300).split()
    texts = [prose(rng, 60) for _ in range(20)] + ["", None, "  ", "same text here", "same text here"]
    for k in range(40):
        near = list(first)
        near[k] = "changed"
        texts.append(" ".join(near))
    ids = random.Random(4).sample(range(1000), len(texts))
    df = docs(spark, texts, ids=ids).withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("component_id", F.lit(0))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_groups(ids, fps, 4)
    assert len(got) == len(texts)
    for i, fp in zip(ids, fps):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == want[i]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_ids(spark):
    df = docs(spark, ["a b c d e", "a b c d e", "q r s t u v", "zz yy xx ww", "q r s t u v", None], ids=[5, None, 7, 5, 7, None])
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert len(got) == 6
    assert {c for i, _, c in got if i == 5} == {5} and {c for i, _, c in got if i == 7} == {7}
    assert {c for i, _, c in got if i is None} == {None}
    assert sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=str) == [5, 7, None, None]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def brute_signature(text, width=5):
    words = (text or "").lower().split()
    shingles = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    def hashes(items, i):
        for s in items:
            x = int.from_bytes(xxhash.xxh64_digest(s.encode()), "little") + (i + 1) * 0x9E3779B97F4A7C15
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x &= (1 << 64) - 1
                x = (x ^ x >> shift) * by
            x &= (1 << 64) - 1
            yield (x ^ x >> 31).to_bytes(8, "little")

    def majority(items, i):
        found = [int.from_bytes(h, "big") for h in hashes(items, i)]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in found) > len(found))
        return int.from_bytes(bits.to_bytes(8, "big"), "little", signed=True)

    return [majority(set(words), i) for i in range(simhash.TABLES)] + [majority(shingles, i) for i in range(simhash.SKETCH)]


def test_signature(monkeypatch):
    rng = random.Random(8)
    texts = ["", None, " \t", "One", "a b c d", "a b c d e", "a b c d e f", "x " * 50, prose(rng, 400)]
    want = [brute_signature(t) for t in texts]
    assert [simhash.signature(t) for t in texts] == want and want[0] == [0] * 8
    monkeypatch.setattr(simhash, "STEP", 7)  # long texts are hashed and counted in steps
    assert [simhash.signature(t) for t in texts] == want


def test_similar(spark, monkeypatch):
    """Groups equal those of all pairs, also where every bucket is dealt out; near copies meet, texts alike in words only don't."""
    rng = random.Random(12)
    texts = [prose(rng, 80) for _ in range(20)] + ["", None, "  ", "same text here", "same text here"]
    first = prose(rng, 300).split()
    for k in range(40):
        near = list(first)
        for place in rng.sample(range(300), 1 + k % 3):  # at most six changes apart: 0.8 and more
            near[place] = f"changed{rng.randrange(99)}"
        texts.append(" ".join(near))
    texts.append(" ".join(sorted(first)))  # the same words in another order
    ids = rng.sample(range(1000), len(texts))
    df = docs(spark, texts, ids=ids).withColumn("f0", F.lit("clash")).withColumn("s0", F.lit(1)).withColumn("node", F.lit(1))
    codes = np.array([brute_signature(t) for t in texts], np.int64).view(np.uint64)
    limit = simhash.sketch_limit(0.8)
    near = []
    for a in range(len(texts)):
        for b in range(a):
            apart = np.bitwise_count(codes[a] ^ codes[b]).astype(int)
            if apart[: simhash.TABLES].min() <= 4 and apart[simhash.TABLES :].sum() <= limit:
                near.append((ids[a], ids[b]))
    want = spread(near, ids)
    for chunk in (1024, 4):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == want
    assert len({want[i] for i in ids[25:-1]}) == 1 and want[ids[-1]] == ids[-1]
    kept = simhash.keep_one(df, width=5, similarity=0.8)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.similar(df.limit(0)).count() == 0


def test_similar_ids(spark):
    """A doc_id with several texts ties their groups; a null doc_id is in no group."""
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = docs(spark, [a, a, b, b, None, ""], ids=[5, None, 7, 5, None, 9])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar(df).collect()), key=str)
    assert got == sorted([(5, 5), (None, None), (7, 5), (5, 5), (None, None), (9, 9)], key=str)
    assert sorted((r.doc_id for r in simhash.keep_one(df, width=5, similarity=0.8).collect()), key=str) == [5, 9, None, None]


def test_sketch_limit():
    assert simhash.sketch_limit(1.0) == 0 and 38 < simhash.sketch_limit(0.8) < 60 < simhash.sketch_limit(0.5)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(201)}


# --- quality rules ---


def brute_rules(texts, hosts, limit_docs=10, depleted=0.7):
    def words(s):
        return [w for w in s.translate({k: " " for k in range(9, 14)}).split(" ") if w]

    lines = [[x for x in (t or "").split("\n") if words(x)] for t in texts]
    norm = [[" ".join(words(x)).lower() for x in part] for part in lines]
    seen = Counter()
    for h, part in zip(hosts, norm):
        seen.update((h, x) for x in set(part))
    out = []
    for t, h, part, raw in zip(texts, hosts, norm, lines):
        w = words(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        repeat = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
        lost = sum(len(x.split(" ")) for x in part if seen[h, x] > limit_docs)
        base = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        out.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(raw) - len(set(raw)), len(repeat), base, not base and lost <= len(w) * depleted))
    return out


def test_quality_rules(spark):
    rng = random.Random(5)
    texts, hosts = [], []
    for k in range(60):
        body = "\n".join(prose(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6)))
        if k % 3 == 0:
            body += "\nA Common  line\tof the host # & <b>\n\nA Common  line\tof the host # & <b>"
        texts.append(body)
        hosts.append("h1" if k < 40 else None)
    shared = "\n".join(prose(rng, 20) for _ in range(5))
    texts += [shared] * 15 + ["", None, " \n\t", "x y z " * 40, "ü " * 60, "one two", prose(rng, 5000)]
    hosts += ["h1"] * 15 + ["h2", None, "h1", "h2", "h2", None, "h1"]
    df = docs(spark, texts, hosts).withColumn("row", F.lit(1)).withColumn("lines", F.lit("clash")).withColumn("host", F.lit(0))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.quality(df).collect()}
    want = brute_rules(texts, hosts)
    assert got == dict(enumerate(want))
    assert not any(got[k][-1] for k in range(60, 75))  # depleted copies
    assert any(got[k][-1] for k in range(60))
    cleaned = quality_rules.clean(df)
    assert cleaned.columns == df.columns
    cleaned = {r.doc_id: r.text for r in cleaned.collect()}
    assert set(cleaned) == {k for k, v in got.items() if v[-1]}
    for k in (k for k in cleaned if k < 60):
        common = hosts[k] == "h1" and k % 3 == 0 or hosts[k] is None and k % 3 == 0 and sum(h is None and j % 3 == 0 for j, h in enumerate(hosts[:60])) > 10
        assert cleaned[k] == ("\n".join(x for x in texts[k].split("\n") if not x.startswith("A Common")) if common else texts[k])
    twice = df.where("doc_id < 5").unionAll(df.where("doc_id < 5"))
    assert quality_rules.quality(twice).count() == 10
    assert quality_rules.quality(df.limit(0)).count() == 0


def test_line_limit_does_not_loosen_in_a_large_host(spark):
    """The same line in the same documents of a host with 10 and with 12,000 more documents."""
    body = [f"Shared line number {k} of this host, which says the same in all of these documents." for k in range(5)]
    rows = [(k, "\n".join(body), "en", "h", 0) for k in range(12)] + [(100 + k, f"own words {k} " * 40, "en", "h", 0) for k in range(10)]
    small = spark.createDataFrame(rows, DOCS)
    more = spark.range(1000, 13000).selectExpr("id AS doc_id", "repeat(concat('line ', id, ' '), 30) AS text", "'en' AS lang", "'h' AS source", "0L AS n_chars")
    for df in (small, small.unionAll(more)):
        kept = {r.doc_id for r in quality_rules.quality(df).where("kept").collect()}
        assert not kept & set(range(12))


def test_quality_rules_are_native(spark):
    plan = quality_rules.quality(docs(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- mixing ---


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (whole - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    sources = ["b", "a", None, "Z", "é", "ab", "zero"]
    rows = [(i, rng.choice(sources[:6])) for i in range(2000)]
    texts = [prose(rng, rng.randrange(0, 12)) if i % 50 else None for i, _ in rows] + ["", " "]
    hosts = [s for _, s in rows] + ["zero", "zero"]
    df = docs(spark, texts, hosts).withColumn("size", F.lit("x")).withColumn("target", F.lit("x")).withColumn("level", F.lit(0)).withColumn("rate", F.lit(0))
    found = mixing.mix(df).collect()
    size = Counter()
    for t, h in zip(texts, hosts):
        size[h] += len((t or "").split())
    want = brute_targets(dict(size))
    taken = Counter()
    for r in found:
        assert r["size"] == len((texts[r.doc_id] or "").split())
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (math.floor(r.copies) * r["size"],) and r.copies <= 2
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 1
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in found}
    out = mixing.emit(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in found if r.copies})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.emit(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""], [None, "q"])).collect()] == [0, 0]
    assert mixing.mix(docs(spark, ["a b"], ids=[None])).count() == 1


# --- top-k ---


def brute_top(vectors, asked, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in sorted((i, v) for i, v in fine if i in asked):
        best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 50)
    rng = np.random.default_rng(7)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(400)]
    vectors += [(i, vectors[3][1]) for i in range(1000, 1100)]  # many ties
    vectors += [(2000, None), (2001, [1.0, None] * 4), (2100, [math.nan] * 8), (2200, [math.inf] * 8), (None, [1.0] * 8), (2300, [])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("x_block", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect())
    assert got == brute_top(vectors, {i for i, _ in vectors if i is not None and i % 100 == 0}, 10)
    # repeated queries ask once, repeated rows of another id are answers each
    twice = df.where("vec_id in (100, 101, 7)")
    got = sorted(tuple(r) for r in topk.top_k(twice.unionAll(twice).unionAll(twice), twice.unionAll(twice).where("vec_id = 100"), 10).collect())
    assert got == sorted(set(brute_top([v for v in vectors if v[0] in (100, 101, 7)] * 3, {100}, 10))) and len(got) == 6
    few = df.where("vec_id < 4")
    assert topk.top_k(few, few.where("vec_id = 0"), 10).count() == 3
    assert topk.top_k(df, df.limit(0), 10).count() == 0


def test_top_k_large_numbers(spark):
    vectors = [(i, [1e18 * (i + 1), 3.0]) for i in range(5)]
    small = [(i, [2.0**22 * (i + 1) + 0.5, -(2.0**21) * i]) for i in range(5)]
    got, _ = topk.search_block(np.array([small[0][1]]), np.array([0]), np.array([v for _, v in small]), np.arange(5), 3)
    want = sorted(((-int(v[0] // 1) * int(small[0][1][0]) + 0, i) for i, v in small if i))[:3]
    assert [i for _, i, _ in got] == [i for _, i in want]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    rows = topk.top_k(df, df.where("vec_id = 0"), 2).collect()
    assert [r.score for r in rows] == [2**63 - 1] * 2 and [r.vec_id for r in rows] == [1, 2]


def test_pivots_eliminate():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64)) * 900
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 64)) * 60)
    q, ids = x[::40], np.arange(4000)
    scores = q @ x.T
    scores[np.arange(len(q)), ids[::40]] = -np.inf
    want = [(i, j, int(scores[r, j])) for r, i in enumerate(ids[::40]) for j in np.lexsort((ids, -scores[r]))[:10]]
    for pivots, most in ((48, 0.15), (24, 0.25), (2, 1)):
        found, evaluated = topk.search_block(q, ids[::40], x, ids, 10, pivots)
        assert found == want
        assert evaluated < most * len(q) * len(x)
    floor = np.array([float(np.sort(scores[r])[-10]) for r in range(len(q))])
    found, fewer = topk.search_block(q, ids[::40], x, ids, 10, 24, floor)
    assert found == want and fewer <= topk.search_block(q, ids[::40], x, ids, 10, 24)[1]
    # bounds hold for parallel, zero and equal vectors
    odd = np.array([[3.0, 4, 0], [6, 8, 0], [0, 0, 0], [3, 4, 0], [-3, -4, 1], [0, 0, 5]])
    assert (topk.PivotTable(odd, 2).bounds(odd) >= odd @ odd.T).all()


def test_cuts_are_released(spark):
    import os

    from sluice.llm import common

    df = common.cut(spark.range(5), "test")
    other = common.cut(spark.range(3), "other")
    folder = next(p for p in common._CUTS if "/sluice-test-" in p)
    assert df.count() == 5 and os.path.isdir(folder.removeprefix("file:"))
    common.drop_cut(df)
    assert not os.path.isdir(folder.removeprefix("file:")) and other.count() == 3
    common.release(spark)
    assert not common._CUTS
