"""Quality by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones in pieces. Every passage is encoded (how kinds of signs follow each
other, how words repeat) and embedded; gated attention, learned from document labels alone, weighs the passages, and the weighted
mean of their embeddings is scored. The network is trained in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import append_columns, ship, slices, written

#: Labelled documents used, at most, of each class (the smallest hashes).
SAMPLE = 4000
#: Bytes of their texts, at most. Past it long documents give passages spread over them; each stays in the sample.
SAMPLE_BYTES = 256 << 20
#: Bytes at which a line is cut into passages.
PASSAGE = 512
#: Texts that are encoded together have about this many bytes.
TOGETHER = 1 << 20
HIDDEN, GATE = 32, 16

# kinds of bytes: small, capital, digit, blank, end of line, stop, call, bar, other sign, beyond ASCII
_KIND = np.full(256, 8, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 9
for _i, _signs in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".,;:'\"-"), (6, b"!?"), (7, b"|")):
    _KIND[list(_signs)] = _i
KINDS = 10
FEATURES = KINDS * KINDS + 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def passages(data: np.ndarray, begins: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Where passages begin in the joined bytes of some texts, and the text each belongs to. A text without bytes has one."""
    ends = np.append(begins[1:], len(data))
    cuts = np.unique(np.concatenate([begins[begins < len(data)], (at := np.flatnonzero(data == 10) + 1)[at < len(data)]]))
    lengths = np.diff(np.append(cuts, len(data)))
    more = (lengths - 1) // size
    starts = np.repeat(cuts, more + 1) + size * (np.arange(len(cuts) + int(more.sum())) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1))
    owner = np.searchsorted(begins, starts, side="right") - 1
    empty = np.flatnonzero(ends == begins)
    starts, owner = np.concatenate([starts, begins[empty]]), np.concatenate([owner, empty])
    order = np.lexsort((starts, owner))
    return starts[order], owner[order]


def encode(items: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the text each belongs to."""
    items = [x or b"" for x in items]
    data = np.frombuffer(b"".join(items), np.uint8)
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    begins = np.cumsum(sizes) - sizes
    starts, owner = passages(data, begins)
    n = len(starts)
    if not len(data):
        return np.zeros((n, FEATURES), np.float32), owner
    # empty texts' passages share the place of the next one: they own no bytes
    full = np.flatnonzero(sizes[owner] > 0)
    at = starts[full]
    length = np.diff(np.append(at, len(data)))
    which = np.repeat(np.arange(len(full)), length)
    kind = _KIND[data]
    pair = np.empty(len(data), np.int64)
    pair[0], pair[1:] = kind[0], kind[:-1] * KINDS + kind[1:]
    pair[at] = KINDS * 4 + kind[at]
    counts = np.bincount(which * (KINDS * KINDS) + pair, minlength=len(full) * KINDS * KINDS).reshape(len(full), -1)
    out = np.zeros((n, FEATURES), np.float32)
    out[full, : KINDS * KINDS] = np.sqrt(counts / length[:, None])
    # words: a hash from sums of mixed bytes and places, equal words next to each other or two apart, distinct ones
    blank = (kind == 3) | (kind == 4)
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    before[at] = True
    head = np.flatnonzero(~blank & before)
    if len(head):
        word = np.cumsum(~blank & before) - 1
        inside = np.flatnonzero(~blank)
        offset = (inside - head[word[inside]]).astype(np.uint64)
        low = np.where((data[inside] >= 65) & (data[inside] <= 90), data[inside] + 32, data[inside]).astype(np.uint64)
        mixed = (low + np.uint64(1)) * (offset * _STEP + np.uint64(0xD6E8FEB86659FD93))
        mixed ^= mixed >> np.uint64(29)
        edges = np.searchsorted(inside, head)
        name = np.add.reduceat(mixed * _STEP, edges)
        mine = which[head]
        words = np.bincount(mine, minlength=len(full))
        some = np.maximum(words, 1)
        same = np.zeros(len(head), bool)
        same[1:] = (name[1:] == name[:-1]) & (mine[1:] == mine[:-1])
        apart = np.zeros(len(head), bool)
        apart[2:] = (name[2:] == name[:-2]) & (mine[2:] == mine[:-2])
        order = np.lexsort((name, mine))
        first = np.ones(len(head), bool)
        first[1:] = (name[order][1:] != name[order][:-1]) | (mine[order][1:] != mine[order][:-1])
        distinct = np.bincount(mine[order], weights=first, minlength=len(full))
        tail = out[:, KINDS * KINDS :]
        tail[full, 0] = np.bincount(mine, weights=same, minlength=len(full)) / some
        tail[full, 1] = np.bincount(mine, weights=apart, minlength=len(full)) / some
        tail[full, 2] = distinct / some
        tail[full, 3] = np.log1p(words) / 5
        tail[full, 4] = np.minimum(length / some, 40) / 20
    out[full, -1] = np.log1p(length) / 6
    return out, owner


@dataclass
class Network:
    """Embedding, gated attention and score; about 5000 numbers."""

    mean: np.ndarray
    scale: np.ndarray
    we: np.ndarray
    be: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray

    NAMES = ("we", "be", "v", "u", "w", "c")

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        return cls(mean, scale, draw(len(mean), HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE, 1)[:, 0], np.zeros(HIDDEN + 1))

    def forward(self, x: np.ndarray, owner: np.ndarray, docs: int) -> dict:
        """owner: ascending; every document has a passage."""
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.we + self.be)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.w
        begins = np.searchsorted(owner, np.arange(docs))
        a = np.exp(e - np.maximum.reduceat(e, begins)[owner])
        a /= np.add.reduceat(a, begins)[owner]
        z = np.add.reduceat(a[:, None] * h, begins)
        logit = z @ self.c[:-1] + self.c[-1]
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": logit, "begins": begins}

    def gradients(self, s: dict, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        d = weight * (1 / (1 + np.exp(-s["logit"])) - y)
        dz = d[:, None] * self.c[:-1]
        da = (s["h"] * dz[owner]).sum(1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, s["begins"])[owner])
        dt, dg = de[:, None] * self.w * s["g"], de[:, None] * self.w * s["t"]
        dt, dg = dt * (1 - s["t"] ** 2), dg * s["g"] * (1 - s["g"])
        dh = s["a"][:, None] * dz[owner] + dt @ self.v.T + dg @ self.u.T
        dx = dh * (1 - s["h"] ** 2)
        return {
            "we": s["x"].T @ dx, "be": dx.sum(0), "v": s["h"].T @ dt, "u": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ de,
            "c": np.append(s["z"].T @ d, d.sum()),
        }

    def score(self, items: list[bytes | None]) -> np.ndarray:
        """P(good) of each text; texts are encoded about a megabyte at a time."""
        out, k = np.zeros(len(items)), 0
        while k < len(items):
            size, end = 0, k
            while end < len(items) and (end == k or size < TOGETHER):
                size += len(items[end] or b"")
                end += 1
            x, owner = encode(items[k:end])
            out[k:end] = 1 / (1 + np.exp(-np.clip(self.forward(x, owner, end - k)["logit"], -30, 30)))
            k = end
        return out


def train(bags: list[np.ndarray], y: np.ndarray, prior: float, epochs: int = 30, seed: int = 7) -> Network:
    """Adam on the documents' cross-entropy, both classes of equal weight; the last bias then moves to ``prior``."""
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    spread = np.sqrt(np.maximum(sum((b.astype(np.float64) ** 2).sum(0) for b in bags) / n - mean**2, 0))
    net = Network.fresh(mean, spread + 0.02, seed)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    m, v, t = {}, {}, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(bags)), 0.01 * (1 - epoch / epochs) + 1e-4
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            owner = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            s = net.forward(np.concatenate([bags[i] for i in part]).astype(np.float64), owner, len(part))
            t += 1
            for name, g in net.gradients(s, owner, y[part], weight[part] / len(part)).items():
                g = g + 1e-4 * getattr(net, name)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                setattr(net, name, getattr(net, name) - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8))
    net.c[-1] += np.log(prior / (1 - prior))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """doc_id, data, quality of at most ``sample`` labelled documents per class, and the share of good ones among all labels.

    ``keep`` is a condition on doc_id. A document with several labels is good only if all say so.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if keep is not None:
        known = known.filter(keep)
    share = known.agg(F.avg("quality")).first()[0]
    parts = [known.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # bounded by sample
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    return given.join(chosen, "doc_id"), 0.5 if share is None else min(0.999, max(0.001, float(share)))


def share_of(sizes: list[int], most: int) -> int | None:
    """The bytes that each document may give, so that all together give at most ``most``; none if all fit whole."""
    left = most
    for k, size in enumerate(sorted(sizes)):
        if size > left // (len(sizes) - k):
            return max(PASSAGE, left // (len(sizes) - k))
        left -= size
    return None


def spread(data: bytes | None, share: int | None) -> bytes | None:
    """``data``, or windows of the size of a passage at even distances, of ``share`` bytes together."""
    if data is None or share is None or len(data) <= share:
        return data
    n = max(1, share // (PASSAGE + 1))
    at = [(len(data) - PASSAGE) * k // max(1, n - 1) for k in range(n)]
    return b"\n".join(data[k : k + PASSAGE] for k in at)


def fit(labelled: DataFrame, prior: float = 0.5, share: int | None = None) -> Network:
    """A network from rows (data, quality 0/1). Features, not texts, come to the driver, of a bounded number of documents.

    Of each document count at most ``share`` bytes, spread over it. Without rows of both classes the network knows only the
    prior.
    """
    ship(labelled.sparkSession)

    def bags(batches):
        for batch in slices(batches):
            x, owner = encode([spread(data, share) for data in batch.column(0).to_pylist()])
            parts = np.split(x.astype(np.float16), np.searchsorted(owner, np.arange(1, batch.num_rows))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), batch.column(1)], names=["bag", "quality"])

    got = labelled.select("data", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("data")).mapInArrow(bags, "bag binary, quality int").toArrow()
    y = np.array(got["quality"].to_pylist(), float)
    if not 0 < y.sum() < len(y):
        net = Network.fresh(np.zeros(FEATURES), np.ones(FEATURES))
        net.c[-1] = np.log(prior / (1 - prior))
        return net
    return train([np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got["bag"].to_pylist()], y, prior)


def trained_on(docs: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE) -> Network:
    """The network from the labelled documents that ``keep`` admits."""
    rows, prior = labelled_sample(docs, labels, keep, sample)
    rows = written(rows, "quality-sample")
    sizes = rows.agg(F.sort_array(F.collect_list(F.coalesce(F.octet_length("data"), F.lit(0))))).first()[0]  # bounded by sample
    return fit(rows, prior, share_of(sizes, SAMPLE_BYTES))


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``name``: 0 to 1, higher for good. One pass without a shuffle.

    Null and empty texts are one passage without signs. Repeated rows are scored alike; a column that already has the name is
    replaced. Very long texts are encoded whole.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return append_columns(docs, text, f"{name} double", lambda batch: [pa.array(shared.value.score(batch), pa.float64())])
