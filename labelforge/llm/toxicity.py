"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

1. A bounded sample of labelled rows says which words and word beginnings stand in toxic texts much oftener than in others.
   They and a short general list of insults become lexicon voters, by kind and strength; patterns of abuse are voters too.
2. The label model explains the votes by a hidden class: expectation-maximisation estimates how often each voter fires
   in either class. Voters that agree more than the class explains are correlated, and share their weight.
3. A logistic regression learns the posteriors from votes, densities and the single lexicon entries, and scores every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import append_columns, free_name, ship, slices, written

#: Labelled rows used, at most, of each class (the smallest hashes).
SAMPLE = {1: 5000, 0: 10_000}
#: Lexicon entries that the samples give, at most, of each kind: whole words and beginnings of 4, 5 and 6 bytes.
ENTRIES = 400
KINDS = ("w", 4, 5, 6)
#: An entry's log odds against toxic texts must be this high, and this many toxic sample texts must hold it.
ODDS, SUPPORT = 3.0, 3
BANDS = 3

INSULTS = frozenset(
    b"idiot idiots stupid moron morons imbecile loser losers trash garbage scum scumbag pathetic worthless disgusting clown "
    b"dumb dumbass fool pig filth vermin bastard bitch asshole jerk creep freak ugly crap hate kill die shut".split()
)
PATTERNS = (
    re.compile(rb"\byou(?:'re| are)? (?:an? |such an? |all )?[a-z]{3,}(?:\s|[.!,])", re.I),
    re.compile(rb"\b(?:shut up|go away|drop dead|get lost|screw you|hate you)\b", re.I),
    re.compile(rb"\b[A-Za-z]+[*@#$]{1,4}[A-Za-z]+\b"),
    re.compile(rb"[!?]{3,}"),
    re.compile(rb"(?:\b[A-Z]{3,}\b[ ,!]*){4,}"),
)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> Counter:
    """Words (runs of ASCII letters in lower case and signs beyond ASCII) and how often they occur."""
    return Counter(data.translate(_LETTERS).split()) if data else Counter()


def entries_of(words: Counter) -> set[tuple]:
    """All words and word beginnings a lexicon may hold."""
    out = {("w", w) for w in words if len(w) > 2}
    out.update((k, w[:k]) for w in words for k in KINDS[1:] if len(w) > k)
    return out


@dataclass
class Model:
    """Everything a task needs to score a text; its size is bounded by the parameters above."""

    entries: dict[tuple, tuple[int, int]]  # entry -> its column, its voter
    voters: int
    fires: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # class, voter
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))  # weight of a voter among correlated ones
    prior: float = 0.1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, data: bytes | None) -> tuple[list[int], np.ndarray]:
        """Columns of the lexicon entries found, and votes with densities."""
        words = words_of(data)
        total = sum(words.values())
        get = self.entries.get
        heads = self.heads
        columns, hits, voted = set(), 0, set()
        for w, n in words.items():
            if w[:4] not in heads:
                continue
            found = [x for x in (get(("w", w)), *(get((k, w[:k])) for k in KINDS[1:] if len(w) > k)) if x]
            if found:
                hits += n
                for column, voter in found:
                    columns.add(column)
                    voted.add(voter)
        own = len(KINDS) * BANDS
        if not INSULTS.isdisjoint(words):
            voted.add(own)
        for i, pattern in enumerate(PATTERNS):
            if data and pattern.search(data):
                voted.add(own + 1 + i)
        if hits > 1:
            voted.add(self.voters - 2)
        if total and hits / total > 0.004:
            voted.add(self.voters - 1)
        dense = np.zeros(self.voters + 3, np.float32)
        dense[list(voted)] = 1
        dense[self.voters :] = 1, math.log1p(hits), math.log1p(100 * hits / total) if total else 0
        return sorted(columns), dense

    @property
    def heads(self) -> set[bytes]:
        if not hasattr(self, "_heads"):
            self._heads = {e[1][:4] for e in self.entries}
        return self._heads

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) under the label model, correlated voters sharing their weight."""
        f = self.fires
        logit = math.log(self.prior / (1 - self.prior)) + (
            votes * self.share @ np.log(f[1] / f[0]) + (1 - votes) * self.share @ np.log((1 - f[1]) / (1 - f[0]))
        )
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, data: bytes | None) -> float:
        columns, dense = self.features(data)
        z = float(dense @ self.weights[: len(dense)] + self.weights[[len(dense) + c for c in columns]].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def label_model(model: Model, votes: np.ndarray, gold: np.ndarray, rounds: int = 50) -> None:
    """Fit firing rates, prior and shares by expectation-maximisation; the human label is one more voter, right 95 times in 100."""
    n, voters = votes.shape
    believed = np.where(gold == 1, 0.95, 0.05)
    model.prior = float(np.clip(gold.mean(), 0.001, 0.999)) if n else 0.1
    model.share = np.ones(voters)
    q = believed.copy()
    for step in range(rounds):
        model.fires = np.stack([((1 - q) @ votes + 0.5) / ((1 - q).sum() + 50), (q @ votes + 0.5) / (q.sum() + 1)])
        model.fires = np.clip(model.fires, 1e-4, 1 - 1e-4)
        if step % 5 == 0 and n:
            # agreement beyond what the class explains: correlation of what is left of the votes
            rest = votes - (q[:, None] * model.fires[1] + (1 - q)[:, None] * model.fires[0])
            sd = np.sqrt((rest**2).mean(0)) + 1e-6
            alike = np.abs(rest.T @ rest / n / sd[:, None] / sd[None, :])
            np.fill_diagonal(alike, 0)
            model.share = 1 / (1 + np.where(alike > 0.1, alike, 0).sum(1))
        p = model.posterior(votes)
        odds = np.log(p / (1 - p)) + np.log(believed / (1 - believed)) - math.log(model.prior / (1 - model.prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if n == 0 or np.abs(new - q).max() < 1e-5:
            q = new
            break
        q = new
    model.targets = q


def _linear(x: np.ndarray, target: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft targets, by Adam over all rows."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) / len(x) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(labelled: DataFrame, sample: dict[int, int] | None = None, entries: int = ENTRIES) -> Model:
    """A model from rows (doc_id, data, toxic 0/1); at most ``sample`` rows of each class are used, those of smallest hash.

    Without rows of both classes the lexicons are empty, and the general list and the patterns decide alone.
    """
    sample = sample or SAMPLE
    ship(labelled.sparkSession)
    rows = labelled.select("data", F.col("toxic").cast("int").alias("toxic"))

    def count(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for data, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((k, e, toxic) for k, e in entries_of(words_of(data)))
                seen[("", b"", toxic)] += 1
            if len(seen) > 300_000:
                yield _counts(seen)
                seen.clear()
        yield _counts(seen)

    counts = rows.mapInArrow(count, "kind string, entry binary, toxic int, n long").groupBy("kind", "entry")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    counts = counts.filter(f"n1 >= {SUPPORT} or kind = ''").persist()
    total = counts.filter("kind = ''").first()
    n1, n0 = (total["n1"], total["n0"]) if total else (0, 0)
    found: dict[tuple, tuple[int, int]] = {}
    if n1 and n0:
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
        strong = counts.withColumn("odds", odds).filter(F.col("odds") >= ODDS)
        for place, kind in enumerate(KINDS):
            best = strong.filter(F.col("kind") == str(kind)).orderBy(F.col("n1") * F.col("odds"), "entry", ascending=[False, True]).limit(entries).collect()
            for rank, r in enumerate(best):
                found[(kind, bytes(r["entry"]))] = (len(found), place * BANDS + rank * BANDS // len(best))
    counts.unpersist()
    model = Model(found, len(KINDS) * BANDS + 1 + len(PATTERNS) + 2)

    def vectors(batches):
        for batch in slices(batches):
            made = [model.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in made], pa.list_(pa.int32())), pa.array([d.tolist() for _, d in made], pa.list_(pa.float32())), batch.column(1)],
                names=["columns", "dense", "toxic"],
            )

    got = rows.mapInArrow(vectors, "columns array<int>, dense array<float>, toxic int").toArrow()
    width = model.voters + 3
    dense = np.array(got["dense"].to_pylist(), np.float32).reshape(-1, width)
    x = np.zeros((len(dense), width + len(found)), np.float32)
    x[:, :width] = dense
    for i, columns in enumerate(got["columns"].to_pylist()):
        x[i, [width + c for c in columns]] = 1
    gold = np.array(got["toxic"].to_pylist(), float)
    label_model(model, dense[:, : model.voters].astype(float), gold)
    model.weights = _linear(x, model.targets) if len(x) else np.zeros(width + len(found))
    if not len(x):
        model.weights[len(KINDS) * BANDS] = 4.0
        model.weights[model.voters] = -2.0
    model.targets = None
    return model


def _counts(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([str(k[0]) for k in keys]), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())],
        names=["kind", "entry", "toxic", "n"],
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, keep=None, sample: dict[int, int] | None = None) -> DataFrame:
    """doc_id, data, toxic of at most ``sample`` labelled documents per class, those of smallest hash.

    ``keep`` is a condition on doc_id. A document with several labels is toxic if one says so; labels without id or value
    don't count. Of documents that repeat an id, each row counts.
    """
    sample = sample or SAMPLE
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if keep is not None:
        known = known.filter(keep)
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in sample.items()]
    chosen = F.broadcast(parts[0].union(parts[1]))  # bounded by sample
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    return given.join(chosen, "doc_id")


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` with the column ``name``: 0 to 1, higher for toxic; null and empty texts get the score of no evidence.

    One pass without a shuffle; repeated rows are scored alike, and a column that already has the name is replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ENTRIES
    return append_columns(docs, text, f"{name} double", lambda batch: [pa.array([shared.value.score(x) for x in batch], pa.float64())])


def trained_on(docs: DataFrame, labels: DataFrame, keep=None) -> Model:
    """The model from the labelled documents that ``keep`` admits."""
    return fit(written(labelled_sample(docs, labels, keep), "toxic-sample"))



def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below ``threshold``, with their columns."""
    name = free_name(docs, "__toxic")
    return score(docs, trained_on(docs, labels), "text", name).filter(F.col(name) < threshold).drop(name)
