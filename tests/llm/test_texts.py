"""Decontamination, personal data, mixing, and the two classifiers against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import decontaminate, mixing, pii, quality, toxicity

DOC = "doc_id long, text string"


def brute_marks(text, items, size):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, body in items:
        other = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in body or ""))
        for i in range(max(1, len(other) - size + 1) if other and item is not None else 0):
            window = other[i : i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item))
    ids = sorted(found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 40])
def test_marks_are_those_of_brute_force(spark, pass_bytes):
    rng = random.Random(2)
    words = ["aa", "b", "cc", "dé", "7", "x9"]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 3, 5, 6, 9, 12, 20])] + [(20, None), (21, " ., "), (None, "aa b"), (10, "zz-Top! 1"), (11, "zz top 1")]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 60])))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "see ZZ-top,1 now"), (52, "see ZZ-top,1 now"), (None, items[7][1].upper()), (53, "b " * 30_000 + items[7][1])]
    got = decontaminate.mark(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"), size=5, pass_bytes=pass_bytes)
    made = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())
    short = [(i, t) for i, t in docs if i != 53]
    want = [(str(i), *brute_marks(t, items, 5)) for i, t in short]
    assert [m for m in made if m[0] != "53"] == sorted(want)
    assert [m for m in made if m[0] == "53"][0][1] == 30_020


def test_decontamination_keeps_clean_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", 4, True), (2, "clean text", None, None), (3, None, 5, False)], "doc_id long, text string, n_hit int, contaminated boolean")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "clean text", None, None), (3, None, 5, False)]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 3
    assert decontaminate.mark(docs.limit(0), bench).count() == 0
    assert decontaminate.mark(docs, bench).filter("contaminated").count() == 1


def luhn_card(rng, n):
    while True:
        digits = [rng.randrange(10) for _ in range(n)]
        if sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits))) % 10 == 0:
            return "".join(map(str, digits))


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), k, m.end()) for k, p in enumerate(PLAIN.values()) for m in re.finditer(p, text or "") if good(list(PLAIN)[k], m.group())]
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(4)
    card = luhn_card(rng, 16)
    parts = ["a.b@c.de", "x@y", "é@ü.de", "a@b.c@d.e_f@g.h", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.1.1.1", "+1 (555) 123-4567", "+12 3", "+123456789012345678", card,
             " ".join(card[i : i + 4] for i in range(0, 16, 4)), "1  2", "4-4-4", "😀", "ß", "12 345-678", "a", "..", "@", "+", "\n"]
    texts = [rng.choice(["", " ", "-"]).join(rng.choices(parts, k=rng.choice([1, 3, 12]))) for _ in range(300)]
    texts += [None, "", "5" * 50_000, "1 " * 20_000, "1." * 20_000, "a" * 50_000, "+1" + "-2" * 9000, "mail a@b.cc " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.joined("base").alias("base"), pii.joined("spans").alias("spans")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base == brute_spans(t), t and t[:200]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_added_spans_and_masking(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    rows = [(i, f'the éa token = "{h}" is here') for i, h in enumerate(hexes)]
    rows += [(100, "words " * 30), (101, "ssn 123-45-6789 of him"), (102, "write to jane.doe [at] example [dot] com"), (103, "a@b.cc"), (None, None)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.joined("spans").alias("s")).collect()}
    assert all(got[i] == f"secret:{(a := t.index(hexes[i]))}:{a + 40}" for i, t in rows[:60])
    assert got[100] == "" and got[None] == "" and got[103] == "email:0:6"
    assert got[101] == "national_id:4:15" and got[102].startswith("spelled_email:9:")
    clean = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert clean[0] == 'the éa token = "<secret>" is here' and clean[103] == "<email>" and clean[None] == ""
    assert pii.find(docs.limit(0)).count() == 0


def test_native_plan_of_personal_data(spark):
    docs = spark.createDataFrame([(1, "a@b.cc")], DOC)
    plan = pii.find(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_water_filling_and_tree():
    sizes = np.array([100, 10, 50, 0, 40])
    weights = np.array([5.0, 2, 1, 5, 2])
    target = mixing.water_fill(sizes, weights)
    assert target.sum() == pytest.approx(200) and (target <= 3 * sizes + 1e-9).all() and target[1] == 30 and target[3] == 0
    free = [0, 2, 4]
    assert np.ptp((target / weights)[free]) < 1e-9 or (target[4] == 120)
    table = mixing.split_tree(np.array([17, 0, 1000, 3]), 7, np.random.default_rng(1))
    assert table.shape == (4, 7) and (table >= 0).all() and table.sum(1).tolist() == [17, 0, 1000, 3] and np.ptp(table.sum(0)) <= 3


def mixed_docs():
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([1, 5, 30]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    return rows + [(None, "x y", "a"), (2000, None, "b"), (2001, "", "zero"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]


def test_mix_meets_its_targets(spark):
    rows = mixed_docs()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, shards int")
    got = mixing.draws(docs, shard_words=2000).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r["size"] * len(r.shards)
        assert len(r.shards) <= 3
    for size, taken, target, said in by.values():
        assert size == said and abs(taken - target) <= 30
    assert sum(t for _, _, t, _ in by.values()) == pytest.approx(sum(s for s, _, _, _ in by.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.draws(docs.repartition(7), shard_words=2000).collect()))
    out = mixing.mix(docs, shard_words=2000)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r.shards] = times.get(r.shards, 0) + 1
    want = {}
    for r in got:
        want.setdefault((r.doc_id, r.source, r["size"]), len(r.shards))
    for i, (d, t, s) in enumerate(rows):
        assert times.get(i, 0) == want[(d, s, len((t or "").split()))]
    assert mixing.draws(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def labelled(n=400, seed=9):
    rng = random.Random(seed)
    words = ["plain", "words", "house", "river", "green", "stone", "walks", "talks"]
    docs, labels = [], []
    for i in range(n):
        text, toxic, good = rng.choices(words, k=60), int(i % 5 == 0), int(i % 3 > 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = "blorg" + rng.choice(["ing", "ed", "er", "s", "ly"])
        lines = [" ".join(text[k : k + 20]) for k in (0, 20, 40)]
        if not good:
            lines[rng.randrange(3)] = " ".join(f"{w.upper()}!!" for w in text[:15])
        docs.append((i, "\n".join(lines)))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_classifiers_tell_held_out_documents_apart(spark, which):
    docs, labels = labelled()
    odd = [(1000, None), (1001, ""), (1002, "plain words " * 40_000), (0, docs[0][1]), (None, "plain")]
    table = spark.createDataFrame([(i, t, 0.5) for i, t in docs + odd], f"doc_id long, text string, {which}_score double")
    marks = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    if which == "toxic":
        model = toxicity.trained_on(table, marks, "doc_id % 3 <> 1")
        got = toxicity.score(table, model)
        cut, truth = 0.7, {i: t for i, _, t in labels}
    else:
        model = quality.trained_on(table, marks, "doc_id % 3 <> 1")
        got = quality.score(table, model)
        cut, truth = 0.3, {i: q for i, q, _ in labels}
    rows = got.collect()
    assert len(rows) == len(docs) + len(odd) and got.columns == table.columns
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 3 == 1]
    assert sum((r[2] >= cut) == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r[2] <= 1 for r in rows)
    twice = [r[2] for r in rows if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])
    module = toxicity if which == "toxic" else quality
    assert module.score(table.limit(0), model).count() == 0
    bare = module.trained_on(table, marks.limit(0))
    assert all(0 <= r[2] <= 1 for r in module.score(table.limit(3), bare).collect())


def test_toxic_documents_go_and_columns_stay(spark):
    docs, labels = labelled()
    table = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string")
    kept = toxicity.drop_toxic(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == table.columns
    ids, clean = {r.doc_id for r in kept.collect()}, {i for i, _, t in labels if not t}
    assert clean <= ids and len(ids - clean) <= 4


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    x, owner = rng.normal(size=(9, quality.FEATURES)), np.array([0, 0, 1, 2, 2, 2, 2, 3, 3])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.4, 0.1])
    net = quality.Network.fresh(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))

    def loss():
        z = net.forward(x, owner, 4)["logit"]
        return (weight * (np.logaddexp(0, z) - y * z)).sum()

    grads = net.gradients(net.forward(x, owner, 4), owner, y, weight)
    for name, g in grads.items():
        value = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-6)


def test_a_long_document_shuts_no_other_out_of_the_sample(spark, monkeypatch):
    assert quality.share_of([3, 5], 8) is None
    assert quality.share_of([10, 5000, 10_000], 8010) == 4000
    long = b"".join(bytes([97 + k % 26]) * 1000 for k in range(100))
    parts = quality.spread(long, 10_000)
    assert len(parts) <= 10_000 and parts[0] == long[0] and parts[-1] == long[-1] and len(set(parts)) > 10
    assert quality.spread(None, 5) is None and quality.spread(b"ab", 5) == b"ab"
    rows = [(i, ("A plain sentence about rivers.\n" if i % 2 else "BUY!!! $$$ ### |||\n") * (20_000 if i < 2 else 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 60_000)
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, y, prior, f=quality.train: seen.append((len(bags), y.sum())) or f(bags, y, prior))
    net = quality.trained_on(docs, labels)
    assert seen == [(60, 30)]
    scores = net.score([t.encode() for _, t in rows[2:]])
    assert all((s > 0.5) == (i % 2 == 1) for s, (i, _) in zip(scores, rows[2:], strict=True))


def test_pii_very_long_texts(spark):
    """Hundreds of thousands of figures, and tens of thousands of spans, in one text."""
    figures = "7, " * 300_000 + "4111 1111 1111 1111"
    mails = "a@b.co " * 20_000
    secrets = "é key=abc123abc123abc123 " * 5_000
    docs = spark.createDataFrame([(1, figures), (2, mails), (3, secrets)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.base, r.spans) for r in pii.find(docs).collect()}
    assert [tuple(x) for x in got[1][0]] == [(len(figures) - 19, 2, len(figures))] and got[1][0] == got[1][1]
    assert [tuple(x) for x in got[2][0]] == [(7 * i, 0, 7 * i + 6) for i in range(20_000)] and got[2][0] == got[2][1]
    k = pii.KINDS.index("secret")
    assert got[3][0] == [] and [tuple(x) for x in got[3][1]] == [(25 * i + 6, k, 25 * i + 24) for i in range(5_000)]


def test_pii_overlaps_by_brute_force(spark):
    """Spans that overlap a base span go, then those that overlap one of an earlier kind, at every length of the list."""
    rng = random.Random(4)
    data = []
    for i in range(60):
        spans = []
        for kind in range(len(pii.KINDS)):  # spans of one kind never overlap
            at = rng.randrange(20)
            for _ in range(rng.choice([0, 1, 5, 90])):
                end = at + rng.randrange(1, 12)
                spans.append((at, kind, end))
                at = end + rng.randrange(0, 200)
        rng.shuffle(spans)
        data.append((i, spans))
    df = spark.createDataFrame(data, f"id int, s array<{pii.SPAN}>")
    base = len(pii.BASE)
    first = pii._clear(F.col("s"), lambda kind: F.when(kind < base, 0).otherwise(base))
    both = pii._clear(first, lambda kind: F.when(kind < base, 0).otherwise(kind))
    got = {r.id: ([tuple(x) for x in r.a], [tuple(x) for x in r.b]) for r in df.select("id", F.array_sort(first).alias("a"), F.array_sort(both).alias("b")).collect()}
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
    for i, spans in data:
        kept = [x for x in spans if x[1] < base or not any(y[1] < base and meets(x, y) for y in spans)]
        alone = [x for x in kept if x[1] < base or not any(y[1] < x[1] and meets(x, y) for y in kept)]
        assert got[i] == (sorted(kept), sorted(alone))
