"""SimHash groups and the hash-prefix forest against brute force, and what they make of odd rows."""

import random

import numpy as np
import pytest
import xxhash

from labelforge.llm import forest, simhash

WORDS = [f"w{i}" for i in range(300)]


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius):
    parent = {i: i for i in range(len(fps))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def near_texts(seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = rng.choices(WORDS, k=rng.choice([3, 40, 300]))
        for _ in range(6):
            mine = list(words)
            for _ in range(rng.choice([0, 0, 1, 3])):
                mine[rng.randrange(len(mine))] = rng.choice(WORDS)
            texts.append(" ".join(mine))
    return [*texts, "", None, "  \n", "One", "one", "a b c d", "A  b\tc\nd", "É x " * 5000]


def test_groups_are_those_of_all_pairs(spark):
    texts = near_texts()
    ids = [1000 - 7 * i for i in range(len(texts))]
    got = simhash.groups(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == dict(zip(ids, fps))
    assert {r.doc_id: r.component_id for r in got} == dict(zip(ids, brute_components(fps, ids, 4)))


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_miss_no_pair(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & x == 0 for m in masks)
    for m in masks[:3]:
        parts = simhash._split(m, radius)
        assert all(any(p & x == m & x for p in parts) for x in [sum(1 << b for b in rng.sample(range(64), radius)) for _ in range(200)])


def test_large_buckets_are_split_and_lose_no_pair(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:  # one dense group, far more than a bucket holds
        x = rng.choice(sorted(fps)[:50])
        for b in rng.sample(range(64), rng.choice([2, 3, 5])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(50)})
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for splits in (0, 2):
        links = simhash.links(nodes, 4, bucket=16, splits=splits)
        roots = {r.node: r.root for r in simhash.components(links).collect()}
        signed = [simhash._signed(f) for f in fps]
        assert [roots.get(s, s) for s in signed] == brute_components(fps, signed, 4)
        assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links.collect())


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_one_of_each_group_stays(spark):
    text = " ".join(WORDS[:50])
    rows = [(5, text, "a", 1), (2, text, "b", 2), (2, text, "b", 2), (None, text, "c", 3), (9, " ".join(WORDS[60:120]), None, None), (None, " ".join(WORDS[150:250]), "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.groups(docs.limit(0)).count() == 0


def brute_neighbours(vectors, asked, k):
    out = {}
    for q in asked:
        far = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = far[:k]
    return out


def test_forest_finds_the_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] + 0.3 * rng.normal(size=16)).astype(np.float32).astype(float) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = forest.search(df, df.filter("vec_id % 50 = 0"), trees=8, enough=200, piece=100)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours(vectors, range(0, 1500, 50), 10)
    assert rows.keys() == want.keys()
    hits = sum(len({v for _, v, _ in rows[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    for q, found in rows.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        for _, v, s in found:
            assert abs(s - np.sqrt(((vectors[q] - vectors[v]) ** 2).sum())) < 1e-9


@pytest.mark.parametrize(("trees", "probes"), [(20, 3), (1, 1)])
def test_forest_compares_a_share_of_many_vectors(spark, trees, probes):
    # with enough = 100 alone the first would be cut at two symbols, and the second would stop with too few matches
    rng = np.random.default_rng(5)
    vectors = {i: v.astype(np.float32).astype(float) for i, v in enumerate(rng.normal(size=(3000, 16)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    rows = {}
    for r in forest.search(df, df.filter("vec_id % 100 = 0"), trees=trees, probes=probes, enough=100, piece=1000).collect():
        rows.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_neighbours(vectors, range(0, 3000, 100), 10)
    assert sum(len(rows[q] & {v for _, v in want[q]}) for q in want) / (10 * len(want)) >= 0.9


def test_forest_with_odd_vectors(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]),
            (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (200, None), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in forest.search(df, df.filter("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 3, pytest.approx(0.5**0.5))]
    few = forest.search(df.filter("vec_id in (1, 3)"), df.filter("vec_id = 1"), k=10).collect()
    assert [(r.vec_id, r["rank"]) for r in few] == [(3, 1)]
    assert forest.search(df.limit(0), df).count() == 0


def test_forest_with_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0, -1.0, 2.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.search(df, df.filter("vec_id = 200"), k=5, trees=4, enough=50, piece=40).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(5)]
