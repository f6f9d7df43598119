"""Prefix hashes against plain comparisons, fingerprints against exact likeness, and the query against a loop."""

import hashlib
import random

import numpy as np
import pytest

from labelforge.llm import fingerprints, queries

SCHEMA = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(500)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def spans(text, n=fingerprints.SPAN):
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))} if text else set()


def test_any_span_and_extension():
    rng = random.Random(1)
    a = "".join(rng.choices("ab\0é😀", k=400))
    b = a[100:300] + "".join(rng.choices("ab", k=200))
    x, y = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for _ in range(2000):
        i, j, n = rng.randrange(400), rng.randrange(400), rng.choice([1, 2, 3, 20])
        assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        if i >= 100 and rng.random() < 0.5:
            j = min(i - 100, 399)
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert x.extension(i, y, j) == want
    assert x.extension(400, y, 0) == 0


def test_span_hashes_do_not_depend_on_place(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 300)
    codes = fingerprints.code_points(text + "###" + text)
    monkeypatch.setattr(fingerprints, "CHUNK", 100)
    found = {}
    for at, hashes in fingerprints.span_hashes(codes):
        for i, h in enumerate(hashes.tolist()):
            found.setdefault((text + "###" + text)[at + i : at + i + fingerprints.SPAN], set()).add(h)
    assert all(len(h) == 1 for h in found.values())
    prime, base = fingerprints.PRIMES[0], fingerprints.BASES[0]
    for span, (h,) in list(found.items())[:50]:
        assert h == sum((ord(c) + 1) * pow(base, i + 100, prime) for i, c in enumerate(span)) % prime


@pytest.mark.parametrize("kept", [0.0, 0.3, 0.6, 0.9, 1.0])
def test_likeness_is_near_the_exact_one(kept):
    rng, off = random.Random(3), []
    for _ in range(30):
        a = prose(rng, 400)
        b = a[: int(kept * len(a))] + prose(rng, 400)[int(kept * len(a)) :]
        exact = len(spans(a) & spans(b)) / len(spans(a) | spans(b))
        x, y = fingerprints.sketches([fingerprints.code_points(t) for t in (a, b)])
        off.append(float(fingerprints.likeness(x, y)) - exact)
    assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.2


def brute(rows):
    """The contract but for the sketch: (doc_id, n_chars, edited_sha256) in order, repeats included."""
    texts = {}
    for i, t in rows:
        texts.setdefault((i, t or ""), 0)
        texts[i, t or ""] += 1
    order = [k for i in sorted({i for i, _ in texts if i is not None}, reverse=True) + ([None] if any(i is None for i, _ in texts) else []) for k in sorted(k for k in texts if k[0] == i)]
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        x, y, z = fingerprints.fingerprints_of([t, changed, nxt])[1]
        names = fingerprints.fingerprints_of([t, changed])[0]
        like = [float(fingerprints.likeness(x, o)) for o in (y, z)]
        out += [(i, len(t), hashlib.sha256(changed.encode()).hexdigest(), *names, *like)] * texts[i, t]
    return sorted(out, key=str)


def compared(spark, rows):
    return sorted((tuple(r) for r in fingerprints.compare_next(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_each_meets_the_next(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i * 3, prose(rng, rng.choice([1, 5, 60, 400]))) for i in range(200)]
    rows += [(1, ""), (2, None), (4, "é"), (5, "😀" * 50), (None, "without id"), (7, "x" * 300_000), (8, "long " * 50_000), rows[9], rows[9], rows[50]]
    assert compared(spark, rows) == brute(rows)


def test_one_few_and_no_documents(spark):
    for rows in ([(1, "alone in the table, and long enough for a span")], [(1, None)], [(1, "a"), (1, "a")], [(2, "abcd"), (1, "xyz")], []):
        assert compared(spark, rows) == brute(rows)


def test_equal_texts_and_parts(spark):
    text = prose(random.Random(5), 200)
    got = {r.doc_id: r for r in fingerprints.compare_next(spark.createDataFrame([(3, text), (2, text), (1, "quite another text, with nothing in common"), (0, "")], SCHEMA)).collect()}
    assert got[3].fingerprint == got[2].fingerprint != got[1].fingerprint
    assert got[3].near_next == 1.0 and got[2].near_next == 0.0 and got[0].near_next == 0.0
    assert 0.2 < got[3].near_edited < 0.8
    again = fingerprints.parsed(got[3].fingerprint)
    assert np.array_equal(again, fingerprints.sketches([fingerprints.code_points(text)])[0])


def test_query(spark):
    df = queries.QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)
