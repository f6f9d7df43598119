"""Token files, WARC archives, the language model and the pipeline: exact round trips, damage, odd rows."""

import gzip
import hashlib
import io
import random
import struct
import sys
import zipfile
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from labelforge.llm import lm, rangecoder, tokens, warc  # noqa: E402

DOC = "doc_id long, text string"
TEXTS = [None, "", " ", "Hello world", "a  b", " lead and trail ", "line\nnext line\n\n x", "tab\t x", "it's 12,345 ½ ünï x  y", "😀 <|endoftext|> !", "w" * 5000, "rep eat " * 4000]


class Bytes:
    """Bytes with the reading method of an open file."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("n", [0, 1, 3, 64, 65, 4000])
def test_coder_round_trip_and_single_blocks(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n) ** 2
    ids[n // 2 : n // 2 + n // 4] = ids[: n // 4]
    alphabet, x = np.unique(ids, return_inverse=True)
    if not n:
        assert rangecoder.encode(x, np.array([1 << 20]))[0] == []
        return
    freq = rangecoder.order0(np.bincount(x))
    assert freq.sum() == 1 << rangecoder.ORDER0_BITS and freq.min() >= 1
    blocks, sums = rangecoder.encode(x, freq, 64)
    sizes = rangecoder._lanes_of(n, 64)
    assert np.array_equal(np.concatenate(rangecoder.decode(blocks, sizes, freq)), x)
    last = rangecoder.decode(blocks[-1:], sizes[-1:], freq)[0]
    assert np.array_equal(last, x[-len(last) :]) and zlib.crc32(last.astype("<u4").tobytes()) == sums[-1]


def test_repeats_cost_little():
    x = np.tile(np.arange(50), 200)
    blocks, _ = rangecoder.encode(x, rangecoder.order0(np.bincount(x)))
    assert 8 * sum(map(len, blocks)) / len(x) < 1


def test_pieces_give_the_ids_of_whole_texts():
    encoder = tokens.Encoder(tokens.public_tokenizer())
    rng = random.Random(1)
    parts = ["word", "Word's", "don't", "12", "3.5", "é", "中文", "!!", "\n", "\t", " ", "\x85", "😀", "-", "a_b", ""]
    many = TEXTS[1:] + [rng.choice([" ", "  ", ""]).join(rng.choices(parts, k=20)) for _ in range(400)]
    for ids, want in zip(encoder.encode(many), encoder.whole(many), strict=True):
        assert ids.tolist() == list(want)


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = tokens.public_tokenizer()
    parts = ["word", "don't", "12", "é", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "\n", "", " "]
    rng = random.Random(2)
    many = TEXTS[1:] + ["<|endoftext|>", " <|endoftext|> ", *(rng.choice([" ", "  ", ""]).join(rng.choices(parts, k=15)) for _ in range(300))]
    want = Tokenizer.from_file(path).encode_batch(many, add_special_tokens=False)
    got = tokens.Encoder(path).encode(many)
    assert [g.tolist() for g in got] == [w.ids for w in want]
    assert any(50256 in g.tolist() for g in got)


def test_pieces_at_any_white_space():
    encoder = tokens.Encoder(tokens.public_tokenizer())
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace() or chr(c) in "\u180e\u200b\ufeff"]
    many = [t for c in spaces for t in (f"a {c}b", f"a{c} b", f"{c} a b", f"a b{c}", f"a {c} b", c, f"x{c}y z")]
    for _ in range(2):  # again, from what is remembered
        assert [x.tolist() for x in encoder.encode(many)] == [list(x) for x in encoder.whole(many)]


def test_an_encoder_remembers_little_and_a_segment_takes_little():
    import tracemalloc

    import pyarrow as pa

    encoder = tokens.Encoder(tokens.public_tokenizer())
    texts = [" ".join(f"w{i:x}q{j:x}" for j in range(2000)) for i in range(150)]  # 300 000 pieces
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for k in range(0, 150, 10):
        encoder.encode(texts[k : k + 10])
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert kept < 25e6
    ids = np.random.default_rng(1).integers(0, 5000, 1 << 20).astype(np.uint32)
    tracemalloc.start()
    tokens.pack_segment([1], [len(ids)], ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * len(ids)


def test_texts_are_cut_into_slices_by_bytes():
    import pyarrow as pa

    data = [b"x" * n for n in (3, 0, 50, 1, 1, 9, 0)] + [b"\xff a", b""]
    for most in (1, 7, 1000):
        parts = [p.to_pylist() for p in tokens._few(pa.array(data, pa.binary()), most)]
        assert [t for p in parts for t in p] == [str(d, "utf-8", "replace") for d in data]
        assert all(sum(map(len, p)) <= max(most, 50) + most for p in parts)
    assert sum(map(len, tokens._few(pa.array([], pa.binary())))) == 0 and len(list(tokens._few(pa.array([b"", b""])))) == 1


def test_batches_are_gathered_and_settings_are_given_back(spark):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": [k, None], "tie": [0, 0], "data": [b"x" * k, None]}) for k in range(9)]
    for least in (1, 60, 1 << 20):
        made = [(k, d) for keys, data in tokens._gathered(iter(batches), least) for k, d in zip(keys.to_pylist(), data.to_pylist(), strict=True)]
        assert made == [x for k in range(9) for x in ((k, b"x" * k), (None, None))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), tokens._conf(spark, key, 7):
        assert spark.conf.get(key) == "7" and 1 // 0
    assert spark.conf.get(key) == before


def want_tokens(rows):
    encoder, at, out = tokens.Encoder(tokens.public_tokenizer()), 0, []
    for d, t in rows:
        ids = encoder.whole([t or ""])[0] + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("segment", [1 << 20, 100])
def test_token_files_give_back_all_ids(spark, segment):
    rows = [(3 * i - 5, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    manifest = tokens.write(docs.selectExpr("*", "1 as tie", "2 as data"), tokens.public_tokenizer(), segment=segment)
    got = tokens.read(spark, manifest, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == want_tokens(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_token_files_of_odd_tables(spark):
    rows = [(None, "x y"), (1, "a"), (1, "a"), (1, "b c")]
    got = tokens.read(spark, tokens.write(spark.createDataFrame(rows, DOC), tokens.public_tokenizer())).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 1, 1]
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    empty = tokens.write(spark.createDataFrame([], DOC), tokens.public_tokenizer())
    assert empty.count() == 0 and tokens.read(spark, empty).count() == 0


def test_damage_is_seen():
    ids = np.arange(500, dtype=np.uint32) % 37
    data = tokens.pack_segment([1, None], [300, 200], ids, block=64)
    docs, lengths, back = next(tokens.read_segments(Bytes(data), len(data)))
    assert docs == [1, None] and lengths.tolist() == [300, 200] and np.array_equal(back, ids)
    for at in (2, 40, len(data) - 30):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            list(tokens.read_segments(Bytes(bytes(bad)), len(bad)))


PAGES = [(3, "http://a/é", "x" * 100), (1, None, "x" * 100), (2, "u", "x" * 100), (4, "u\r\nv", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (7, "u", ""),
         (8, "u", "é" * 50), (9, "u", "é" * 50), (None, "u", "z" * 200), (10, "u", "z" * 200), (1, None, "x" * 100), (11, "u", "line\r\n\r\nline " * 9000)]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_archives_give_back_all_pages(spark, archive_bytes):
    pages = spark.createDataFrame([(*p, "s") for p in PAGES], "page_id long, url string, html string, digest string")
    manifest = warc.write(pages, archive_bytes=archive_bytes)
    got = warc.read(spark, manifest, with_payload=True).collect()
    first = {}
    for p, _, h in PAGES:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        again = h in first and first[h] != p and len(raw) >= 100
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None, None if again else raw))
    made = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(str, made)) == sorted(map(str, want))
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def packed(zip64=False):
    out = io.BytesIO()
    record = warc.pack_record(1, "u", "response", None, b"<p>hi</p>", hashlib.sha256(b"<p>hi</p>").hexdigest())
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("notes.txt"), "x" * 500, zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo(warc.DATA), record + record)
        z.writestr(zipfile.ZipInfo(warc.INDEX), f"0 {len(record)} 1\n{len(record)} {len(record)} 1\n")
        z.comment = b"a comment"
    data = out.getvalue()
    if zip64:  # sizes and places above 4 GB are written so: all ones, and the true values in the ZIP64 records
        end = data.rfind(b"PK\x05\x06")
        count, length, at = struct.unpack("<H", data[end + 10 : end + 12])[0], *struct.unpack("<II", data[end + 12 : end + 20])
        directory, p, wide = data[at : at + length], 0, b""
        for _ in range(count):
            n_name, n_extra, n_note = struct.unpack("<HHH", directory[p + 28 : p + 34])
            sizes, local = struct.unpack("<II", directory[p + 20 : p + 28]), struct.unpack("<I", directory[p + 42 : p + 46])[0]
            extra = struct.pack("<HHQQQ", 1, 24, sizes[1], sizes[0], local)
            entry = bytearray(directory[p : p + 46])
            entry[20:28], entry[42:46] = b"\xff" * 8, b"\xff" * 4
            entry[30:32] = struct.pack("<H", len(extra))
            wide += bytes(entry) + directory[p + 46 : p + 46 + n_name] + extra
            p += 46 + n_name + n_extra + n_note
        record64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(wide), at)
        locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(wide), 1)
        tail = bytearray(data[end:])
        tail[8:20] = b"\xff" * 12
        data = data[:at] + wide + record64 + locator + bytes(tail)
    return data


@pytest.mark.parametrize("zip64", [False, True])
def test_directories_of_zip_and_zip64(zip64):
    data = packed(zip64)
    where = warc.members(Bytes(data), len(data))
    assert set(where) == {warc.DATA, warc.INDEX}  # the deflated member isn't readable by range
    assert [r["payload"] for r in warc.read_records(Bytes(data), len(data))] == [b"<p>hi</p>"] * 2


def test_damaged_archives_are_refused():
    with pytest.raises(ValueError):
        warc.members(Bytes(b"no archive" * 20), 200)
    raw = gzip.decompress(warc.pack_record(1, "u", "response", None, b"abc", hashlib.sha256(b"abc").hexdigest()))
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(raw.replace(b"abc", b"abd")))


def test_base_scores_and_held_out_gain(spark):
    rng = random.Random(3)
    sets = [[f"{s}{i}" for i in range(60)] for s in "ab"]
    rows = [(i, " ".join(rng.choices(sets[i % 2], k=rng.choice([5, 40, 90])))) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, "Unseen WORDS unseen"), (None, "a1 a2"), (1003, "a1 " * 20_000), (4, rows[4][1])]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    got = lm.score(docs, "coalesce(doc_id, 0) % 7 <> 2", head_size=50, sample=200, epochs=4).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for d, t in rows:
        if (d or 0) % 7 != 2:
            counts.update(lm.tokens_of((t or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    by = {d: lm.tokens_of((t or "").encode()) for d, t in rows}
    better = all_ = 0
    for r in got:
        w = by[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert r.base_score == pytest.approx(sum(log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
        assert r.score < 0
        if r.doc_id is not None and r.doc_id % 7 == 2 and 30 < r.n_tokens < 1000:
            better, all_ = better + (r.score > r.base_score), all_ + 1
    assert better == all_ > 5
    assert lm.score(docs.limit(0)).count() == 0


def chains(rng, n):
    """Texts in which each word follows from the one before it."""
    return [" ".join(f"c{(k + i) % 40}" for i in range(60)) for k in (rng.randrange(40) for _ in range(n))]


def lots(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lot = F.xxhash64("doc_id", F.col("text").cast("binary"))
    return docs, {r.doc_id: r.lot for r in docs.select("doc_id", lot.alias("lot")).collect()}


def test_the_network_learns_from_all_training_documents(spark):
    rng = random.Random(8)
    _, junk = lots(spark, [(i, f"n{i % 40} n{i % 7}") for i in range(3000)])
    first = sorted(junk, key=junk.get)[:1600]
    edge = max(junk[i] for i in first)
    rows = [(10_000 + i, t) for i, t in enumerate(chains(rng, 400))]
    _, lot = lots(spark, rows)
    late = [r for r in rows if lot[r[0]] > edge]
    docs, _ = lots(spark, [(i, f"n{i % 40} n{i % 7}") for i in first] + late)
    got = [r for r in lm.score(docs).collect() if r.doc_id >= 10_000]
    assert len(got) > 100
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_shards_are_averaged_and_none_is_lost(spark):
    rows = [(i, t) for i, t in enumerate(chains(random.Random(9), 300))]
    docs = lm.texts(spark.createDataFrame(rows, "doc_id long, text string"))
    head = spark.sparkContext.broadcast(lm.head_of(lm.count_words(docs)))
    lessons = lm._lessons(docs, head, None, 500)
    assert lessons.count() == 300 and lessons.groupBy("round").count().count() == lm.ROUNDS
    assert lessons.select("shard").distinct().count() > 5
    nets = [lm.learned(x, head, epochs=1, shard=500).packed() for x in (docs, docs.repartition(7))]
    assert np.allclose(*nets, atol=1e-5)
    assert not np.allclose(nets[0], lm.Network(head.value).packed(), atol=1e-2)
    ranks = [np.array([head.value.index().get(w, -1) for w in lm.tokens_of(t.encode())]) for _, t in rows[:20]]
    after = lm.Network(head.value).unpack(nets[0]).score(head.value, ranks).sum()
    assert after > lm.Network(head.value).score(head.value, ranks).sum()


def test_a_round_reads_its_own_lessons_in_as_many_tasks_as_shards(spark, monkeypatch):
    docs = lm.texts(spark.createDataFrame([(i, t) for i, t in enumerate(chains(random.Random(9), 300))], "doc_id long, text string"))
    head = spark.sparkContext.broadcast(lm.head_of(lm.count_words(docs)))
    seen = []
    monkeypatch.setattr(lm, "_round", lambda *a, made=lm._round: seen.append((made(*a), a)) or seen[-1][0])
    lm.learned(docs, head, epochs=1, shard=500)
    shards = lm._shards(head.value, 500)
    assert shards > 5 and len(seen) == lm.ROUNDS
    assert sum(d.count() for d, _ in seen) == 300
    for d, (lessons, k, n) in seen:
        assert n == shards and d.rdd.getNumPartitions() == shards
        assert d.select("shard", F.spark_partition_id().alias("p")).distinct().filter("shard <> p").count() == 0
        assert lessons.filter(F.col("round") == k).count() == d.count()
        assert "PartitionFilters: [isnotnull(round" in d._jdf.queryExecution().executedPlan().toString()


def test_a_huge_document_shuts_out_no_other(spark):
    huge = " ".join([c * (1 << 20) for c in "abcdefghi"])
    made = spark.createDataFrame([(huge,)], "text string").crossJoin(spark.range(100).selectExpr("id as doc_id"))
    giant = made.select("doc_id", F.xxhash64("doc_id", F.col("text").cast("binary")).alias("lot")).orderBy("lot").first()
    rows = [(10_000 + i, t) for i, t in enumerate(chains(random.Random(10), 300))]
    _, lot = lots(spark, rows)
    docs, _ = lots(spark, [r for r in rows if lot[r[0]] > giant.lot] + [(giant.doc_id, huge)])
    got = [r for r in lm.score(docs).collect() if r.doc_id >= 10_000]
    assert len(got) > 100
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_training_rows_of_which_nothing_is_learned_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        lm.score(docs, sample=0)


def test_state_is_carried_and_documents_dont_mix():
    words = [b"a", b"b", b"\n", *(f"w{i}".encode() for i in range(1500))]
    head = lm.Head(words, np.arange(len(words), 0, -1) * 10, 100_000, 5000, 700)
    net = lm.Network(head)
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(-1, len(words), n), 2).astype(np.int32) for n in (0, 1, lm.WINDOW - 1, lm.WINDOW, 3 * lm.WINDOW + 5, 700)]
    together = net.score(head, docs)
    for d, got in zip(docs, together, strict=True):
        h, want, last = np.zeros((1, lm.HIDDEN), np.float32), 0.0, head.start
        for x in d:
            h = net.step(np.array([last]), h)[0]
            logits = (h @ net.c + net.cb)[0].astype(float)
            want += logits[head.cls[x]] - np.log(np.exp(logits).sum()) + head.inside[x]
            if 0 <= x < head.own:
                k = x // lm.EACH
                s = (net.w[k * lm.EACH : (k + 1) * lm.EACH] @ h[0] + net.wb[k * lm.EACH : (k + 1) * lm.EACH]).astype(float)
                want += s[x - k * lm.EACH] - np.log(np.exp(s).sum())
            last = head.inp[x]
        assert got == pytest.approx(want, rel=1e-4)


def test_equal_documents_are_dealt_to_all_lanes(monkeypatch):
    words = [b"\n", *(f"w{i}".encode() for i in range(1500))]
    head = lm.Head(words, np.arange(len(words), 0, -1), 10_000_000, 5000, 700)
    net, seen, step = lm.Network(head), [], lm.Network.step
    docs = [np.arange(i, i + 10, dtype=np.int32) for i in range(2 * lm.LANES)]
    alone = [net.score(head, [d])[0] for d in (docs[0], docs[-1])]
    monkeypatch.setattr(lm.Network, "step", lambda *a: seen.append(1) or step(*a))
    assert net.score(head, docs)[[0, -1]] == pytest.approx(alone, rel=1e-4)
    assert len(seen) == 20


def test_windows_share_their_arrays():
    words = [b"\n", *(f"w{i}".encode() for i in range(1100))]
    head = lm.Head(words, np.arange(len(words), 0, -1), 10_000_000, 5000, 700)
    net, rng, room, held = lm.Network(head), np.random.default_rng(6), [], None
    h = hr = np.zeros((3, lm.HIDDEN), np.float32)
    for steps in (6, 6, 2):
        word, fresh = rng.integers(-1, 40, size=(steps, 3)), rng.random((steps, 3)) < 0.2
        given = head.inp[rng.integers(0, 40, size=(steps, 3))], head.cls[word], word, fresh
        loss, grads, h = net.learn(*given, h)
        loss_r, grads_r, hr = net.learn(*given, hr, room)
        held = held or list(map(id, room))
        assert list(map(id, room)) == held and len(room) == 6
        assert loss == loss_r and np.array_equal(h, hr) and all(np.array_equal(grads[k], grads_r[k]) for k in net.NAMES)


def test_sums_by_key():
    rng = np.random.default_rng(5)
    keys, rows = rng.choice([*[3] * 90, *range(40), 49], 700), rng.normal(size=(700, 6))
    want = np.zeros((50, 6))
    np.add.at(want, keys, rows)
    assert np.allclose(lm._sums(keys, rows, 50), want)


def test_probabilities_sum_to_one():
    words = [b"\n", *(f"w{i}".encode() for i in range(3000))]
    head = lm.Head(words, np.arange(len(words), 0, -1), 10_000_000, 5000, 700)
    net, n = lm.Network(head), len(words)
    h = np.tile(np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32), (n + 1, 1))
    every = np.append(np.arange(n), -1)
    p = np.exp(net.log_probabilities(h, head.cls[every], every).astype(float) + head.inside[every])
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_gradients_of_the_recurrent_network():
    words = [b"\n", *(f"w{i}".encode() for i in range(1100))]
    head = lm.Head(words, np.arange(len(words), 0, -1), 10_000_000, 5000, 700)
    net, rng = lm.Network(head), np.random.default_rng(4)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(float))
    word = rng.integers(-1, 40, size=(6, 3))
    inputs, fresh = head.inp[rng.integers(0, 40, size=(6, 3))], rng.random((6, 3)) < 0.2
    h = rng.normal(size=(3, lm.HIDDEN)) * 0.1
    _, grads, _ = net.learn(inputs, head.cls[word], word, fresh, h)
    for name, g in grads.items():
        value = getattr(net, name)
        order = np.argsort(-np.abs(g).ravel())[:3]
        for at in (np.unravel_index(i, g.shape) for i in order):
            old, value[at] = value[at], value[at] + 1e-3
            up = net.learn(inputs, head.cls[word], word, fresh, h)[0]
            value[at] = old - 1e-3
            down = net.learn(inputs, head.cls[word], word, fresh, h)[0]
            value[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=2e-5)


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=80)), f"s{i % 3}") for i in range(200)]
    toxic = [(i, f"{t} blorgish {t[:100]} blorged", s) for i, t, s in rows[:40]]
    clean = rows[40:]
    item = " ".join(rng.choices(words, k=30))
    leaked = [(300, f"{clean[0][1]} {item}", "s0")]
    copies = [(400 + i, clean[5][1], "s1") for i in range(5)]
    table = [*toxic, *clean, *leaked, *copies, (500, None, None), (501, "", "s0")]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, "en", 0) for r in table], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i < 40)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = given = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs)
    toxicless, single, free, mix, ids = seen
    assert all(d.columns == given.columns for d in seen[:4])
    assert {r.doc_id for r in toxicless.collect()} == {r[0] for r in table if r[0] >= 40}
    assert {r.doc_id for r in single.collect()} == {r[0] for r in [*clean, *leaked]} | {500}
    assert {r.doc_id for r in free.collect()} == {r[0] for r in clean} | {500}
    assert mix.count() == ids.count() and {r.doc_id for r in mix.collect()} <= {r.doc_id for r in free.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "token_ids"] and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, folder).count() == ids.count()
