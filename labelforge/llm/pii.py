"""Personal data by weak supervision, in DataFrame functions alone.

Fixed patterns give the base spans of e-mail addresses, IP addresses, cards and phone numbers. Wider patterns propose further
candidates. On each candidate several labelers vote: regex labelers look at its form, gazetteer labelers at known prefixes,
countries and endings, context labelers at the words around it. The votes of all documents are counted by pattern, a
bounded table, from which expectation-maximisation estimates how reliable each labeler is for a kind, and a logistic
classifier on the votes is fitted to the posteriors. Candidates it accepts become spans, unless they overlap a base span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import written

#: Kind, pattern, and a condition that every text with a match meets. The possessive forms and the conditions in front match the same
#: runs as the plain patterns and don't run long over long texts: a run of digits can only begin where no digit is before it.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
BASE_KINDS = tuple(k for k, _, _ in BASE)

#: Wider patterns. No candidate is a span before the classifier accepts it.
CANDIDATES = (
    ("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,63}[0-9])[A-Za-z0-9]{16,64}+(?![A-Za-z0-9])", None),
    ("local_phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", None),
    ("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    ("spelled_email", r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,64}\x20?(?:\x20at\x20|\[at\]|\(at\))\x20?[A-Za-z0-9-]{2,64}\x20?(?:\x20dot\x20|\[dot\]|\(dot\))\x20?[a-z]{2,24}", "dot"),
)
KINDS = BASE_KINDS + tuple(k for k, _, _ in CANDIDATES)

#: Labelers of each kind: a name, whether it is regex, gazetteer or context, and what it looks for (``not:`` votes against).
#: Context labelers see CONTEXT signs before and after the candidate.
CONTEXT = 32
LABELERS = {
    "secret": (
        ("mixed", "regex", r"(?:[0-9].*){3}"), ("hex", "regex", r"^[0-9a-f]{16,64}$|^[A-Z0-9]{20}$"),
        ("prefix", "gazetteer", r"^(?:AKIA|ASIA|AROA|AIDA|AGPA|ghp|gho|xox[abp]|AIza|eyJ|sk|pk|rk)"),
        ("assigned", "context", r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api.?key|access.?key|auth)[\"']?\s{0,2}[=:]\s{0,2}[\"']?$"),
        ("named", "context", r"(?i)pass|pwd|secret|token|key|auth|credential"), ("not:digits", "regex", r"^[0-9]+$"),
    ),
    "local_phone": (
        ("parens", "regex", r"^\("), ("dashes", "regex", r"^[0-9]{3}[.-][0-9]{3}[.-]"), ("area", "gazetteer", r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"),
        ("called", "context", r"(?i)phone|tel|call|mobile|cell|fax|contact"), ("not:figure", "context", r"(?i)version|license|isbn|no\.\s*$|\$\s*$"),
    ),
    "national_id": (
        ("range", "regex", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), ("dashes", "regex", r"^[0-9-]{11}$"),
        ("named", "context", r"(?i)ssn|social|security|national|tax"), ("area", "gazetteer", r"^(?:00[1-9]|0[1-9]|[1-5]|6[0-57-9]|7)"),
        ("not:figure", "context", r"(?i)version|part|serial|model"),
    ),
    "iban": (
        ("country", "gazetteer", r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)"),
        ("grouped", "regex", r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+"), ("mostly", "regex", r"^[A-Z]{2}[0-9]{2}(?:[A-Z]{4})?[0-9 ]{10,}"),
        ("named", "context", r"(?i)iban|account|bank|transfer|konto|compte|cuenta"), ("not:capitals", "regex", r"^(?:[A-Z]+[0-9]{1,3}){3,}[A-Z]+$"),
    ),
    "spelled_email": (
        ("brackets", "regex", r"[\[(]at[\])]"), ("dotted", "regex", r"[\[(]dot[\])]"), ("ending", "gazetteer", r"(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"),
        ("named", "context", r"(?i)mail|contact|write|reach|correo|courriel"), ("not:prose", "regex", r"^(?:the|a|an|is|look|be|was|are)\x20"),
    ),
}
#: Share of candidates believed right before any vote.
PRIOR = 0.5


#: Code points of a block in which a candidate's context is looked up, and items that are gone through at a time.
BLOCK, RUN = 512, 128
SPAN = "struct<start:int,kind:int,end:int>"
VOTED = "struct<start:int,kind:int,end:int,votes:int>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _folded(items: Column, state: Column, state_type: str, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The array that ``step`` makes while it goes through ``items``, in nearly linear time.

    ``step`` sees the state and an item, and gives the next state, a condition, and what to append where it holds. Spark copies an
    accumulator whole for each item, so that none may hold a long list: the states before runs of RUN items come first,
    then every run makes its own list.
    """

    def appended(run: Column, first: Column) -> Column:
        def merge(a: Column, x: Column) -> Column:
            after, wanted, item = step(a["s"], x)
            return F.struct(after.alias("s"), F.when(wanted, F.concat(a["out"], F.array(item))).otherwise(a["out"]).alias("out"))

        return F.aggregate(run, F.struct(first.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), merge, lambda a: a["out"])

    def before(a: Column, run: Column) -> Column:
        last = F.aggregate(run, a["s"], lambda s, x: step(s, x)[0])
        return F.struct(last.alias("s"), F.concat(a["seen"], F.array(a["s"])).alias("seen"))

    def through(runs: Column) -> Column:
        zero = F.struct(state.alias("s"), F.array().cast(f"array<{state_type}>").alias("seen"))
        return F.flatten(F.zip_with(runs, F.aggregate(runs, zero, before, lambda a: a["seen"]), appended))

    firsts = lambda xs: F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(RUN))
    return _bound(items, lambda xs: _bound(F.transform(firsts(xs), lambda i: F.slice(xs, i, RUN)), through))


def _may(text: Column, pattern: str, sign: str | None) -> Column:
    return (F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]")) & text.rlike(pattern)


def _found(text: Column, pattern: str, kind: str, made: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """What ``made`` gives for start, end (code points) and value of each leftmost non-overlapping match: a condition, and the item."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("long"), hit.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + x["gap"]
        end = start + F.coalesce(x["long"], F.lit(0))
        good, item = made(start, end, x["hit"])
        return end, x["hit"].isNotNull() & good, item

    return _folded(parts, F.lit(0), "int", kind, step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (less 9 above 9), divisible by 10."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return s + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)) == 0


def _holds(kind: str, value: Column) -> Column:
    """What a base match must meet besides its pattern."""
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _base_of(k: int, text: Column) -> Column:
    kind, pattern, sign = BASE[k]
    spans = _found(text, pattern, SPAN, lambda start, end, value: (_holds(kind, value), F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"))))
    return F.when(_may(text, pattern, sign), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of all base spans, kind as its place in KINDS, in order."""
    return F.array_sort(F.concat(*[_base_of(k, text) for k in range(len(BASE))]))


def _around(blocks: Column, start: Column, size: Column) -> Column:
    """At most CONTEXT code points of a text in blocks: they lie in two of them."""
    at = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return two.substr(start - at * BLOCK + 1, size)


def _votes(kind: str, blocks: Column, start: Column, end: Column, value: Column) -> Column:
    """The labelers' votes as bits."""
    before = _around(blocks, F.greatest(start - CONTEXT, F.lit(0)), F.least(start, F.lit(CONTEXT)))
    after = _around(blocks, end, F.lit(CONTEXT))
    bits = F.lit(0)
    for i, (_, sort, pattern) in enumerate(LABELERS[kind]):
        seen = value.rlike(pattern)
        if sort == "context":
            seen = before.rlike(pattern) | (after.rlike(pattern) if not pattern.endswith("$") else F.lit(False))
        bits = bits + F.when(seen, 1 << i).otherwise(0)
    return bits


def _candidates_of(k: int, text: Column) -> Column:
    kind, pattern, sign = CANDIDATES[k - len(BASE)]

    def spans(blocks: Column) -> Column:
        item = lambda start, end, value: F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), _votes(kind, blocks, start, end, value).alias("votes"))
        return _found(text, pattern, VOTED, lambda start, end, value: (F.lit(True), item(start, end, value)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(_may(text, pattern, sign), _bound(cut, spans)).otherwise(F.array().cast(f"array<{VOTED}>"))


def candidate_spans(text: Column) -> Column:
    """Array of (start, kind, end, votes) of all candidates."""
    return F.concat(*[_candidates_of(k, text) for k in range(len(BASE), len(KINDS))])


@dataclass
class Labeling:
    """What one kind's votes taught: firing rates of the labelers in wrong and right candidates, and the classifier."""

    right: list[float]
    wrong: list[float]
    share: float
    weights: list[float]
    bias: float

    def probability(self, votes: int) -> float:
        z = self.bias + sum(w for i, w in enumerate(self.weights) if votes >> i & 1)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def estimate(kind: str, counts: dict[int, int], rounds: int = 60) -> Labeling:
    """Expectation-maximisation over vote patterns and their counts, then the logistic classifier on its posteriors.

    Firing rates start from what the labelers are meant for and are held by a few pseudo-counts, so that few candidates, or
    candidates that all vote alike, don't turn the classes around.
    """
    m = len(LABELERS[kind])
    against = [name.startswith("not:") for name, _, _ in LABELERS[kind]]
    first = ([0.1 if a else 0.7 for a in against], [0.5 if a else 0.15 for a in against])
    right, wrong, share = list(first[0]), list(first[1]), PRIOR
    soft: dict[int, float] = {}
    for _ in range(rounds):
        for votes in counts:
            z = math.log(share / (1 - share))
            for i in range(m):
                z += math.log(right[i] / wrong[i]) if votes >> i & 1 else math.log((1 - right[i]) / (1 - wrong[i]))
            soft[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        mass = sum(n * soft[v] for v, n in counts.items())
        total = sum(counts.values())
        share = min(0.98, max(0.02, (mass + 5 * PRIOR) / (total + 5)))
        for i in range(m):
            hit = [(n * soft[v], n * (1 - soft[v])) for v, n in counts.items() if v >> i & 1]
            right[i] = min(0.99, max(0.01, (sum(a for a, _ in hit) + 10 * first[0][i]) / (mass + 10)))
            wrong[i] = min(0.99, max(0.01, (sum(b for _, b in hit) + 10 * first[1][i]) / (total - mass + 10)))
    weights, bias = [math.log(r / w) - math.log((1 - r) / (1 - w)) for r, w in zip(right, wrong, strict=True)], math.log(share / (1 - share))
    bias += sum(math.log((1 - r) / (1 - w)) for r, w in zip(right, wrong, strict=True))
    total = sum(counts.values()) or 1
    for step in range(200):  # from the label model's own weights towards its posteriors
        g, gb = [0.0] * m, 0.0
        for votes, n in counts.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(w for i, w in enumerate(weights) if votes >> i & 1)))))
            d = (p - soft[votes]) * n / total
            gb += d
            for i in range(m):
                if votes >> i & 1:
                    g[i] += d
        bias -= 0.5 * gb
        weights = [w - 0.5 * (x + 1e-4 * w) for w, x in zip(weights, g, strict=True)]
    return Labeling(right, wrong, share, weights, bias)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans (arrays of (start, kind, end), kind as its place in KINDS) of every row.

    A null text is empty and has no spans. Repeated rows each get their own, and null ids are kept. Spans are in order of
    start, then kind; an accepted candidate that overlaps a base span, or a better one (earlier kind, then earlier start), is
    not added. Whole texts are searched, in time that grows with their length and number of matches. No rows: no result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = written(rows.select("doc_id", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("candidates")), "spans")
    votes = found.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect()  # at most kinds x 2^labelers rows
    accepted: list[int] = []
    for k, kind in enumerate(KINDS):
        if kind in LABELERS:
            model = estimate(kind, {r["votes"]: r["count"] for r in votes if r["kind"] == k})
            accepted += [k << 8 | v for v in range(1 << len(LABELERS[kind])) if model.probability(v) >= threshold]
    code = lambda c: F.shiftleft(c["kind"], 8) + c["votes"]
    good = F.filter("candidates", lambda c: F.array_contains(F.array(*[F.lit(a) for a in accepted]) if accepted else F.array().cast("array<int>"), code(c)))
    plain = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    clear = _clear(F.concat("base", plain), lambda kind: F.when(kind < len(BASE), 0).otherwise(len(BASE)))
    spans = _clear(clear, lambda kind: F.when(kind < len(BASE), 0).otherwise(kind))
    return found.select("doc_id", "base", F.when(F.size("candidates") > 0, F.array_sort(spans)).otherwise(F.col("base")).alias("spans"))


def _clear(spans: Column, limit: Callable[[Column], Column]) -> Column:
    """The spans that overlap none of a kind below ``limit(kind)``, by a sweep from the left and one from the right.

    From the left, a span is overlapped by an earlier one if that kind's furthest end lies beyond its start; from the right,
    if that kind's next start lies before its end.
    """
    far = (1 << 31) - 1
    below = lambda s, x, fold: fold(F.slice(s, 1, F.greatest(limit(x["kind"]), F.lit(1))))
    put = lambda s, x, v: F.transform(s, lambda old, i: F.when(i == x["kind"], v(old)).otherwise(old))
    any_kind = lambda x: limit(x["kind"]) > 0

    def right(s: Column, x: Column) -> tuple[Column, Column, Column]:
        hit = any_kind(x) & (below(s, x, F.array_max) > x["start"])
        item = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), hit.cast("int").alias("votes"))
        return put(s, x, lambda old: F.greatest(old, x["end"])), F.lit(True), item

    def left(s: Column, x: Column) -> tuple[Column, Column, Column]:
        hit = (x["votes"] == 1) | (any_kind(x) & (below(s, x, F.array_min) < x["end"]))
        item = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        return put(s, x, lambda old: F.least(old, x["start"])), ~hit, item

    kinds = F.lit(len(KINDS))
    forth = _folded(F.array_sort(spans), F.array_repeat(F.lit(-1), kinds), "array<int>", VOTED, right)
    return _folded(F.reverse(forth), F.array_repeat(F.lit(far), kinds), "array<int>", SPAN, left)


def joined(spans: str) -> Column:
    """kind:start:end of each, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; of spans that overlap the first counts."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = find(docs, key, text).groupBy("doc_id").agg(F.first("spans").alias("spans"))
    name = F.array(*[F.lit(k) for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        between = F.col("text").substr(s["at"] + 1, x["start"] - s["at"])
        put = F.concat(s["out"], between, F.lit("<"), F.element_at(name, x["kind"] + 1), F.lit(">"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), put.alias("out")))

    rest = lambda s: F.concat(s["out"], F.expr("text").substr(s["at"] + 1, F.length("text")))
    return rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"])).select(rows["doc_id"], F.aggregate("spans", zero, step, rest).alias("text"))
