"""Language-model scoring: a gated recurrent network with a class-factored output, over whole documents.

The vocabulary is every word of the training documents. The HEAD most frequent words are known to the tasks; the first of
them have their own classes of the output softmax, the others lie in classes by rank, inside which a word's share is that of
its count. All further words are one class, whose words share it by their counts in the whole corpus, with the share that
words seen once have for words never seen; those counts reach the documents by a join, so that the vocabulary may outgrow
any machine. The network is trained on all training documents, in rounds: shards of bounded size, dealt by hash, each start from
the network of the round before and go through their own documents by truncated backpropagation in numpy; the next
network is the mean of theirs, weighted by words. It scores every document from its first word to its end, the state carried
from window to window.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import slices, texts, written

#: Words that every task knows. Of these the first OWN are told apart by the network, in classes of EACH.
HEAD, OWN, EACH = 1 << 18, 1024, 32
HIDDEN, WINDOW, LANES = 32, 48, 512
#: Times that the network sees every training document, rounds of each (every document is in one), and words of a shard.
EPOCHS, ROUNDS, SHARD = 3, 4, 1 << 20
#: Most tasks that add up the networks of a round, and so most rows that the driver gets of it.
SUMS = 32
#: Bytes of text that a task scores side by side.
TOGETHER = 12 << 20
END = b"\n"
_LN10 = float(np.log(10))


def tokens_of(data: bytes | None) -> list[bytes]:
    """Words (ASCII letters in lower case) and one end."""
    words = data.lower().split() if data else []
    words.append(END)
    return words


@dataclass
class Head:
    """The most frequent words, in order of count, and what the tasks need to know of them."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    once: int  # words of the tail seen once

    def __post_init__(self):
        n = len(self.words)
        rank = np.arange(n)
        band = np.where(rank < OWN, 0, np.floor(np.log2(np.maximum(rank, 1) / OWN)).astype(np.int64))
        self.own = min(n, OWN)
        n_own = -(-self.own // EACH)
        bands = int(band[-1]) + 1 if n > OWN else 0
        self.classes = n_own + bands + 1
        self.inputs = self.own + bands + 1
        # one more entry, at the end, for the words of the tail (index -1)
        self.cls = np.append(np.where(rank < OWN, rank // EACH, n_own + band), self.classes - 1)
        self.inp = np.append(np.where(rank < OWN, rank, self.own + band), self.inputs - 1)
        inside = np.zeros(n + 1)
        if bands:
            sums = np.bincount(band[OWN:], weights=self.counts[OWN:], minlength=bands)
            inside[OWN:n] = np.log(self.counts[OWN:] / sums[band[OWN:]])
        # small numbers, of which every task has a copy and takes one for each word
        self.inside = inside.astype(np.float32)
        self.cls, self.inp = self.cls.astype(np.int16), self.inp.astype(np.int32)
        self.base = np.append(np.log10((self.counts + 1) / (self.total + self.distinct + 1)), 0.0)
        self.start = int(self.inp[self.words.index(END)]) if END in self.words else self.inputs - 1
        # an input says all that the network learns of a word
        self.cls_of_input = np.zeros(self.inputs, np.int64)
        self.cls_of_input[self.inp] = self.cls

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


class Network:
    """GRU with input table X (gates of each input), recurrent U, class softmax C and word softmaxes W of the own classes."""

    NAMES = ("x", "u", "c", "cb", "w", "wb")

    def __init__(self, head: Head, seed: int = 11):
        rng = np.random.default_rng(seed)
        f, h = np.float32, HIDDEN
        self.x = (rng.normal(size=(head.inputs, 3 * h)) * 0.1).astype(f)
        self.u = (rng.normal(size=(h, 3 * h)) / np.sqrt(h)).astype(f)
        self.c = (rng.normal(size=(h, head.classes)) * 0.1).astype(f)
        self.w = (rng.normal(size=(head.own, h)) * 0.1).astype(f)
        mass = np.bincount(head.cls[:-1], weights=head.counts, minlength=head.classes)
        mass[-1] = max(1.0, head.total - head.counts.sum()) + head.once
        self.cb = np.log(np.maximum(mass, 0.5) / max(1.0, mass.sum())).astype(f)
        self.wb = np.log(np.maximum(head.counts[: head.own], 0.5)).astype(f)

    def packed(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def unpack(self, row: np.ndarray) -> Network:
        """Take the weights of :meth:`packed`."""
        return self.view(row.astype(np.float32))

    def view(self, row: np.ndarray) -> Network:
        """Let the weights be parts of ``row``: who changes it changes them."""
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, row[at : at + old.size].reshape(old.shape))
            at += old.size
        return self

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """x and u gate by gate, for :meth:`step`: each gate lies together, those of z and r negated, as sigmoid(a) is 1 / (1 + exp(-a))."""
        x, u = (np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).swapaxes(0, 1)) for a in (self.x, self.u))
        x[:2] *= -1
        u[:2] *= -1
        return x, u

    def step(self, inputs: np.ndarray, h: np.ndarray, gates=None, into=(None,) * 4):
        """The next state, z times what the state before has more than n, the gates z, r and n, and the recurrent part of n; written to ``into``, if given."""
        x, u = gates or self.gates()
        to_h, to_kept, to_g, to_hu = into
        g, hu = x.take(inputs, 1, to_g, "clip"), np.matmul(h, u, to_hu)
        zr, n = g[:2], g[2]
        zr += hu[:2]
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        n += zr[1] * hu[2]
        np.tanh(n, n)
        kept = np.subtract(h, n, to_kept)
        kept *= zr[0]
        return np.add(kept, n, to_h), kept, g, hu[2]

    def log_probabilities(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray, learn: bool = False):
        """Natural log of P(class) and, for own words, of P(word | class); with ``learn`` also the gradients.

        All is done in order of the classes, so that a class is a slice, and with a column for each row, so that sums and
        maxima run along whole rows. States end in a one, that with which the biases are multiplied.
        """
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cls, word, rows, states = cls[order], word[order], np.arange(len(h)), np.ones((len(h), HIDDEN + 1), h.dtype)
        states[:, :HIDDEN] = h[order]
        logits = np.vstack([self.c, self.cb]).T @ states.T
        logits -= logits.max(0)
        out = logits[cls, rows]
        e = np.exp(logits, logits)
        sums = e.sum(0)
        out -= np.log(sums)
        n_own = -(-len(self.w) // EACH)
        edges = np.searchsorted(cls, np.arange(n_own + 1)).tolist()
        parts = [(slice(a, b), slice(k * EACH, min((k + 1) * EACH, len(self.w)))) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        n, own = edges[-1], np.hstack([self.w, self.wb[:, None]])
        s = np.full((EACH, n), -np.inf, h.dtype)  # the last class may have fewer words
        for mine, part in parts:
            np.matmul(own[part], states[mine].T, s[: part.stop - part.start, mine])
        s -= s.max(0)
        at = word[:n] - cls[:n] * EACH
        out[:n] += s[at, rows[:n]]
        es = np.exp(s, s)
        total = es.sum(0)
        out[:n] -= np.log(total)
        back = np.empty_like(out)
        back[order] = out
        if not learn:
            return back
        e /= sums
        e[cls, rows] -= 1
        es /= total
        es[at, rows[:n]] -= 1
        dc, dw, dh = e @ states, np.zeros_like(own), e.T @ self.c.T
        for mine, part in parts:
            d = es[: part.stop - part.start, mine]
            np.matmul(d, states[mine], dw[part])
            dh[mine] += d.T @ self.w[part]
        grads = {"c": dc[:, :HIDDEN].T, "cb": dc[:, HIDDEN], "w": dw[:, :HIDDEN], "wb": dw[:, HIDDEN]}
        dback = np.empty_like(dh)
        dback[order] = dh
        return back, grads, dback

    @np.errstate(over="ignore")  # a gate that is shut: 1 / inf
    def learn(self, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: list | None = None):
        """Loss and gradients of one window [time, lane], and the state at its end; nothing flows past the window's begin.

        ``room`` keeps the arrays for the next window, which may be shorter: six tasks' new ones would go through all caches.
        """
        steps, lanes = inputs.shape
        if not room:
            kinds = [(HIDDEN,)] * 4 + [(3 * HIDDEN,)]
            room = [] if room is None else room
            room += [np.empty((steps, lanes, *k), self.u.dtype) for k in kinds] + [np.empty((steps, 3, lanes, HIDDEN), self.u.dtype)]
        befores, hs, bs, cs, dg, gs = (a[:steps] for a in room)
        gates, starts, hu = self.gates(), fresh.any(1).tolist(), np.empty_like(gs[0])
        for t in range(steps):
            before = befores[t]
            before[:] = h
            if starts[t]:
                before[fresh[t]] = 0
            h, b, (z, r, n), c = self.step(inputs[t], before, gates, (hs[t], bs[t], gs[t], hu))
            # what the state's gradient is multiplied with for n, z and r
            rest = 1 - z
            b *= rest
            n *= n
            np.subtract(1, n, n)
            n *= rest
            c *= r
            np.subtract(1, r, rest)
            np.multiply(c, rest, cs[t])
        out, grads, dh = self.log_probabilities(hs.reshape(-1, HIDDEN), cls.ravel(), word.ravel(), True)
        scale = 1 / len(dh)
        for g in grads.values():
            g *= scale
        dh *= scale
        dhs, u = dh.reshape(hs.shape), np.ascontiguousarray(self.u.T)
        back = 0
        for t in range(steps - 1, -1, -1):
            (z, r, dn), d, through = gs[t], dhs[t], dg[t]
            d += back
            dn *= d
            np.multiply(d, bs[t], through[:, :HIDDEN])
            np.multiply(dn, cs[t], through[:, HIDDEN : 2 * HIDDEN])
            np.multiply(dn, r, through[:, 2 * HIDDEN :])
            back = through @ u
            d *= z
            back += d
            if starts[t]:
                back[fresh[t]] = 0
        last, dg = h.copy(), dg.reshape(-1, 3 * HIDDEN)
        grads["u"] = befores.reshape(-1, HIDDEN).T @ dg
        dg.reshape(steps, lanes, 3 * HIDDEN)[:, :, 2 * HIDDEN :] = gs[:, 2]
        grads["x"] = _sums(inputs.ravel(), dg, len(self.x))
        return -out.mean(), grads, last

    @np.errstate(over="ignore")
    def score(self, head: Head, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each document (ranks in the head, -1 for the tail, the end last), tail words by their class only."""
        if not docs:
            return np.zeros(0)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        # documents are laid end to end on lanes of about equal length, longest lanes first
        lanes, gates = min(LANES, len(docs)), self.gates()
        # the next longest document goes where there is least
        load, lane, least = np.zeros(lanes, np.int64), np.zeros(len(docs), np.int64), [(0, i) for i in range(lanes)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            size, at = least[0]
            lane[i] = at
            load[at] = size + sizes[i]
            heapq.heapreplace(least, (int(load[at]), at))
        place = np.lexsort((np.arange(len(docs)), lane, -load[lane]))
        seq = np.concatenate([docs[i] for i in place])
        begins = np.cumsum(sizes[place]) - sizes[place]
        inputs = np.empty(len(seq), np.int32)
        inputs[1:] = head.inp[seq[:-1]]
        inputs[begins] = head.start
        fresh = np.zeros(len(seq), bool)
        fresh[begins] = True
        long = np.sort(load)[::-1]
        starts = np.cumsum(long) - long
        cls, inside = head.cls[seq], head.inside[seq]
        out = np.zeros(len(seq), np.float32)
        h = np.zeros((lanes, HIDDEN), np.float32)
        hs = np.empty((WINDOW * lanes, HIDDEN), np.float32)
        active = lanes
        for begin in range(0, int(long[0]), WINDOW):
            where, used = [], 0
            for t in range(begin, min(begin + WINDOW, int(long[0]))):
                while long[active - 1] <= t:
                    active -= 1
                pos = starts[:active] + t
                h = h[:active]
                h[fresh[pos]] = 0
                h = self.step(inputs[pos], h, gates)[0]
                hs[used : used + active] = h
                used += active
                where.append(pos)
            pos = np.concatenate(where)
            out[pos] = self.log_probabilities(hs[:used], cls[pos], seq[pos])
        total = np.add.reduceat(np.add(out, inside, dtype=np.float64), begins)
        back = np.empty(len(docs))
        back[place] = total
        return back


def _sums(keys: np.ndarray, rows: np.ndarray, n: int, often: int = 24) -> np.ndarray:
    """The sum of the rows of each key below ``n``: key by key where one comes often, else the first rows of all keys, then the second ones."""
    order, out = np.argsort(keys.astype(np.int16), kind="stable"), np.zeros((n, rows.shape[1]), rows.dtype)
    counts = np.bincount(keys, minlength=n)
    begins = np.cumsum(counts) - counts
    for k in np.flatnonzero(counts > often).tolist():
        out[k] = rows[order[begins[k] : begins[k] + counts[k]]].sum(0)
    left = np.flatnonzero((counts > 0) & (counts <= often))
    for i in range(often):
        left = left[counts[left] > i]
        out[left] += rows[order[begins[left] + i]]
    return out


def train(net: Network, head: Head, docs: list[np.ndarray], seed: int, begin: float = 0.0, end: float = 1.0, lanes: int = 192) -> None:
    """One pass of truncated backpropagation over documents (their inputs) laid end to end on lanes, by Adam.

    ``begin`` and ``end`` say which part of the whole training this is. The lanes are filled up by words from the begin.
    """
    rng = np.random.default_rng(seed)
    total = sum(map(len, docs))
    lanes = max(1, min(lanes, total // WINDOW, max(4, total // (40 * WINDOW))))  # at least 40 steps
    long = -(-total // lanes)
    order = rng.permutation(len(docs))
    seq = np.concatenate([docs[i] for i in order]).astype(np.int64)
    inputs = np.concatenate([[head.start], seq[:-1]])
    fresh = np.zeros(len(seq), bool)
    fresh[np.cumsum([0, *(len(docs[i]) for i in order[:-1])])] = True
    inputs[fresh] = head.start
    cut = [np.resize(a, lanes * long).reshape(lanes, long).T for a in (inputs, head.cls_of_input[seq], seq, fresh)]
    h = np.zeros((lanes, HIDDEN), np.float32)
    step, every = 0, -(-long // WINDOW)
    row, room = net.packed(), []
    net.view(row)
    m, v = np.zeros_like(row), np.zeros_like(row)
    for t in range(0, long, WINDOW):
        _, grads, h = net.learn(*(np.ascontiguousarray(a[t : t + WINDOW]) for a in cut), h, room)
        step += 1
        rate = (0.01 * (1 - begin - (end - begin) * step / (every + 1)) + 2e-4) * min(1.0, step / 5)
        g = np.concatenate([grads[k].ravel() for k in net.NAMES])
        g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
        m *= 0.9
        m += g * np.float32(0.1)
        v *= 0.99
        g *= g
        g *= 0.01
        v += g
        np.divide(v, 1 - 0.99**step, g)
        np.sqrt(g, g)
        g += 1e-6
        np.divide(m, g, g)
        g *= rate / (1 - 0.9**step)
        row -= g


# --- tables --------------------------------------------------------------------------------------------------------


def count_words(rows: DataFrame) -> DataFrame:
    """word, c over rows (doc_id, data); counted in the tasks before the shuffle."""

    def run(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for data in batch.column(1).to_pylist():
                seen.update(tokens_of(data))
                if len(seen) > 300_000:
                    yield _pairs(seen)
                    seen.clear()
        if seen:
            yield _pairs(seen)

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _pairs(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def head_of(counts: DataFrame, size: int = HEAD) -> Head:
    """The most frequent words, at most ``size``, and the sums over all.

    A histogram of the counts says above which count there are no more than ``size`` words. Words of equal count are
    in or out together, so that nothing is sorted and only the head's own rows are gathered.
    """
    steps = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", F.expr("sum(n) over (order by c desc)"))
    least = steps.filter(F.col("upto") <= size).agg(F.min("c")).first()[0]
    top = counts.filter(F.col("c") >= least).toArrow() if least is not None else counts.limit(0).toArrow()  # bounded by size
    all_ = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("int"))).first()
    found = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, n = [bytes(w) for w, _ in found], np.array([c for _, c in found], np.int64)
    return Head(words, n, all_[0] or 0, all_[1], (all_[2] or 0) - (int((n == 1).sum()) if all_[1] > len(words) else 0))


def _ranks(get, words: list[bytes]) -> np.ndarray:
    """The rank of each word, -1 in the tail."""
    return np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))


def _lessons(rows: DataFrame, head, sample: int | None, shard: int) -> DataFrame:
    """round, shard, lot, inputs (of the network, int16) of all training documents, or the ``sample`` of smallest hashes.

    Rounds and shards come from hashes, so that neither files nor the cluster change what is learned. A shard has about
    ``shard`` words of a round.
    """

    def run(batches):
        known = head.value
        get, inp = known.index().get, known.inp.astype(np.int16)
        for batch in slices(batches):
            made = [inp[_ranks(get, tokens_of(x))].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "inputs"])

    shards = _shards(head.value, shard)
    made = rows.mapInArrow(run, "doc_id long, inputs binary").withColumn("lot", F.xxhash64("doc_id", "inputs"))
    if sample is not None:
        made = made.orderBy("lot").limit(sample)
    part = F.pmod(F.xxhash64("lot"), F.lit(ROUNDS * shards))
    return written(made.select((part % ROUNDS).cast("int").alias("round"), F.floor(part / ROUNDS).cast("int").alias("shard"), "lot", "inputs"), "lessons", ["round"])


def _shards(head: Head, shard: int) -> int:
    """Shards of a round."""
    return max(1, -(-head.total // (ROUNDS * shard)))


def _round(lessons: DataFrame, k: int, shards: int) -> DataFrame:
    """The lessons of one round, read alone, with a task for each shard: by their bytes or hashes some would share a task, and cores wait."""
    return lessons.filter(F.col("round") == k).repartitionById(shards, F.col("shard"))


def _lesson(head, before, seed: int, k: int, begin: float, end: float):
    """The network of one shard after round ``k``, and its number of words."""

    def run(key, table):
        docs = [np.frombuffer(x.as_buffer(), np.int16) for x in table.sort_by("lot")["inputs"]]
        net = Network(head.value, seed).unpack(before.value)
        train(net, head.value, docs, seed + k, begin, end)
        out = [pa.array([key[0].as_py()], pa.int32()), pa.array([sum(map(len, docs))], pa.int64()), pa.array([net.packed().tobytes()], pa.binary())]
        return pa.table(out, names=["shard", "n", "net"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    """One network of several, weighted by words."""
    table = table.sort_by("shard")
    n, row = table["n"].to_numpy(), 0
    for x, w in zip(table["net"], n, strict=True):
        row = row + np.frombuffer(x.as_buffer(), np.float32) * (w / n.sum())
    return pa.table([pa.array([n.sum()], pa.int64()), pa.array([row.astype(np.float32).tobytes()], pa.binary())], names=["n", "net"])


def learned(rows: DataFrame, head, epochs: int = EPOCHS, sample: int | None = None, shard: int = SHARD, seed: int = 11) -> Network:
    """The network of the training ``rows`` (doc_id, data), in ``epochs`` times ROUNDS rounds.

    The driver gets at most SUMS networks a round. No rows: the network as it begins; rows of which nothing was learned are an
    error.
    """
    context = rows.sparkSession.sparkContext
    net, n_learned = Network(head.value, seed), 0
    lessons = _lessons(rows, head, sample, shard)
    for k in range(epochs * ROUNDS):
        before, span = context.broadcast(net.packed()), (k / (epochs * ROUNDS), (k + 1) / (epochs * ROUNDS))

        each = _round(lessons, k % ROUNDS, _shards(head.value, shard)).groupBy("shard").applyInArrow(_lesson(head, before, seed, k, *span), "shard int, n long, net binary")
        got = each.groupBy(F.col("shard") % SUMS).applyInArrow(_mean, "n long, net binary").toArrow().sort_by([("n", "ascending"), ("net", "ascending")])  # bounded by SUMS
        n = got["n"].to_numpy()
        if len(n):
            net.unpack(sum(np.frombuffer(x.as_buffer(), np.float32) * float(w) for x, w in zip(got["net"], n, strict=True)) / n.sum())
            n_learned += int(n.sum())
        before.unpersist()
    if head.value.total and epochs and not n_learned:
        raise ValueError("there are training rows, but the network has learned from none")
    return net


def score(docs: DataFrame, training: Column | None = None, key: str = "doc_id", text: str = "text", head_size: int = HEAD, sample: int | None = None, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 likelihoods of whole texts) of every row.

    ``training`` is a condition on doc_id: the rows whose words are counted and which train the network (default: all). A caller
    may give a ``sample``, the number of documents that train it at most. The base is the add-one unigram. A null or empty text is just an end. Repeated rows are scored alike (and counted as
    often as they come), null ids are kept. No rows: no result.
    """
    spark = docs.sparkSession
    rows = texts(docs, key, text)
    learn = rows if training is None else rows.filter(training)
    counts = written(count_words(learn), "counts")
    head = head_of(counts, head_size)
    shared = spark.sparkContext.broadcast(head)  # bounded by head_size
    net = spark.sparkContext.broadcast(learned(learn, shared, epochs, sample))

    def run(batches):
        known, model = shared.value, net.value
        get = known.index().get
        number, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids, data = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]) if len(data) else []
            k = 0
            while k < len(ids):
                end, size = k, 0
                while end < len(ids) and (end == k or size < TOGETHER):
                    size += int(sizes[end])
                    end += 1
                made, tails = [], []
                for x in data[k:end]:
                    words = tokens_of(x.as_py())
                    ranks = _ranks(get, words)
                    made.append(ranks)
                    tails.append(Counter(words[i] for i in np.flatnonzero(ranks < 0).tolist()))
                scores = model.score(known, made) / _LN10
                out = [
                    pa.array(range(number + at, number + at + end - k), pa.int64()), pa.array(ids[k:end], pa.int64()),
                    pa.array([len(r) for r in made], pa.int64()), pa.array([int((r >= 0).sum()) for r in made], pa.int64()),
                    pa.array([float(known.base[r].sum()) for r in made]), pa.array(scores),
                    pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "times"])
                at += end - k
                k = end

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"
    scored = written(rows.mapInArrow(run, schema), "scored")
    tail = scored.filter(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("n"))
    found = tail.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rest = max(1, head.total - int(head.counts.sum())) if head.distinct > len(head.words) else 0
    never = max(1, head.once)
    share = F.when(F.col("c").isNull(), F.lit(float(never))).otherwise(F.col("c")) / float(rest + never)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((c + 1) / float(head.total + head.distinct + 1))).alias("b"), F.sum(F.col("n") * F.log10(share)).alias("s"),
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scored.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("k")).cast("long").alias("n_known"), F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )
