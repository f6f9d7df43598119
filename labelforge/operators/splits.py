"""Splits, samples and class balancing. Every choice follows the seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelforge.functions.hashing import DEFAULT_SEED, digest, hash_hex, hash_int
from labelforge.operators.attach import small_table
from labelforge.operators.cuts import group_counts, order_key, rank_thresholds, take_ranked, with_cuts
from labelforge.operators.running import running_totals
from labelforge.session import cut_lineage

# The split shares, sample sizes and the class down-sampled for claim evidence.
TEST_SHARE = 0.2
DEV_SHARE = 0.5
TRAIN_CAP = 10_000
TEST_SUBSET = 1000
EVIDENCE_DOWNSAMPLE = ("NOT_ENOUGH_INFO", 1539)
DOCUMENTS_PER_QUERY = 10


def _whole(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def _three_way(test: float, dev: float) -> dict:
    """Train = first floor(n(1-test)); dev = floor(rest * dev), last; test = what lies between."""
    train = lambda n: _whole(n * F.lit(1 - test))
    upto_test = lambda n: n - _whole((n - train(n)) * F.lit(float(dev)))
    return {"train": train, "test": upto_test}


def _name_split(df: DataFrame, flags: list[str]) -> DataFrame:
    split = F.when(F.col(flags[0]), "train").when(F.col(flags[1]), "test").otherwise("dev")
    return df.withColumn("split", split).drop(*flags)


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test: float = TEST_SHARE, dev: float = DEV_SHARE,
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """80/10/10 per label in hash order."""
    return _name_split(*with_cuts(df, [label], key, _three_way(test, dev), seed=seed))


def carve_dev(
    df: DataFrame, key: str, label: str = "label", dev: float = TEST_SHARE, split: str = "split",
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """Keep the given test rows; move a stratified share of the train rows to ``dev``."""
    train, flags = with_cuts(
        df.filter(F.col(split) == "train"), [label], key, {"train": lambda n: _whole(n * F.lit(1 - dev))}, seed=seed
    )
    train = train.withColumn(split, F.when(F.col(flags[0]), "train").otherwise("dev")).drop(*flags)
    return df.filter(F.col(split) != "train").unionByName(train)


def held_out_split(
    df: DataFrame, flag: str, key: str, label: str = "label", seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """Test = flagged rows; dev = a stratified tenth of the others."""
    marked = df.withColumn("split", F.when(F.col(flag), "test").otherwise("train"))
    return carve_dev(marked, key, label, dev=TEST_SHARE * DEV_SHARE, seed=seed)


def grouped_split(
    df: DataFrame, group_key: str, test: float = TEST_SHARE, dev: float = DEV_SHARE, seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """Unstratified split of the distinct ``group_key`` values: all rows of a group land in one split.

    With a unique ``group_key`` this is the plain row-level split.
    """
    keys = df.select(group_key).distinct().withColumn("__all", F.lit(1))
    cuts = small_table(rank_thresholds(keys, ["__all"], group_key, _three_way(test, dev), seed=seed))
    joined = df.crossJoin(F.broadcast(cuts.drop("__all")))
    order = order_key(group_key, seed=seed)
    split = F.when(order <= F.col("train"), "train").when(order <= F.col("test"), "test").otherwise("dev")
    return joined.withColumn("split", split).drop("train", "test")


def hash_bucket_split(
    df: DataFrame, group_key: str, test: float = TEST_SHARE, dev: float = DEV_SHARE, seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """As :func:`grouped_split` up to chance, in one narrow pass: for tables that only ever grow."""
    u = hash_int(group_key, seed=seed) / F.lit(float(2**32))
    split = F.when(u < 1 - test, "train").when(u < 1 - test * dev, "test").otherwise("dev")
    return df.withColumn("split", split)


def time_split(
    df: DataFrame, key: str, date: str = "Date", label: str = "label", test: float = TEST_SHARE,
    dev: float = DEV_SHARE, seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """Per label by day: oldest rows train, the next ones test, the newest dev. Rows of one day in hash order."""
    dated = df.withColumn("__day", F.to_date(date))
    out = _name_split(*with_cuts(dated, [label], key, _three_way(test, dev), lead="__day", seed=seed))
    return out.drop("__day")


def undersample(df: DataFrame, key: str, label: str = "label", seed: int | str = DEFAULT_SEED) -> DataFrame:
    """Every class cut down to the size of the smallest one."""
    counts = _counts(df, [label])
    least = counts.agg(F.min("n").alias("k"))
    return take_ranked(df, [label], key, counts.drop("n").crossJoin(least), seed=seed)


def water_filling_quotas(counts: DataFrame, label: str, n_samples: int) -> DataFrame:
    """Quota per class: smallest classes first, each gets an equal share of what is left (rounded down), at most its size.

    The classes stand in order of size and name. Up to the water level they give all their rows; the first one larger than its
    share sets the level, and all from there on get that share, the last ones one row more until the samples are used up.
    So one running total over the classes finds every quota, whatever their number.
    """
    ordered = running_totals(counts.select(label, "n", F.lit(1).alias("__one")), ["n", label], __rows="n", __place="__one")
    ordered = cut_lineage(ordered.drop("__one"))
    m = ordered.count()
    share = F.expr(f"({n_samples} - (__rows - n)) div ({m} - __place + 1)")
    level = ordered.filter(F.col("n") > share).agg(F.min(F.struct("__place", F.col("__rows") - F.col("n"))).alias("l")).first()["l"]
    if level is None:
        return ordered.select(label, F.col("n").cast("bigint").alias("k"))
    first, before = level
    each, more = divmod(max(0, n_samples - before), m - first + 1)
    k = F.when(F.col("__place") < first, F.col("n")).when(F.col("__place") <= m - more, F.lit(each)).otherwise(each + 1)
    return ordered.select(label, k.cast("bigint").alias("k"))


def water_filling_sample(
    df: DataFrame, key: str, n_samples: int, label: str = "label", seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """At most ``n_samples`` rows, as evenly over the classes as their sizes allow."""
    quotas = water_filling_quotas(_counts(df, [label]), label, n_samples)
    return take_ranked(df, [label], key, quotas, seed=seed)


def proportional_quotas(counts: DataFrame, label: str, max_size: int) -> DataFrame:
    """Shares of ``max_size`` by class size; the rows lost to rounding go to the largest remainders, by a running total."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    exact = F.col("n") * F.lit(max_size) / F.lit(max(total, 1))
    base = counts.select(label, "n", _whole(exact).alias("__q"), F.round(exact - F.floor(exact), 9).alias("__rest"), F.lit(1).alias("__one"))
    ranked = running_totals(base, [F.desc("__rest"), F.asc(label)], __rank="__one")
    short = max_size - (base.agg(F.sum("__q")).first()[0] or 0)
    k = F.when(F.col("__rank") <= short, F.col("__q") + 1).otherwise(F.col("__q"))
    return ranked.select(label, F.least(k, F.col("n")).cast("bigint").alias("k"))


def resize(
    df: DataFrame, key: str, max_size: int, stratify_on: str = "label", seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """Stratified down-size to exactly ``max_size`` rows; unchanged when there are no more."""
    counts = _counts(df, [stratify_on])
    if (counts.agg(F.sum("n")).first()[0] or 0) <= max_size:
        return df
    return take_ranked(df, [stratify_on], key, proportional_quotas(counts, stratify_on, max_size), seed=seed)


def truncate(
    df: DataFrame, key: str, max_size: int = TRAIN_CAP, policy: str = "balanced", stratify_on: str = "label",
    label: str = "label", split: str = "split", seed: int | str = DEFAULT_SEED, sizes: dict[str, int] | None = None,
) -> DataFrame:
    """Size policy for train and dev, used when train holds more than ``max_size`` rows; test is not touched.

    ``sizes`` of train and dev are counted if they are not given.

    ``random``: under-sample the classes, then resize. ``weighted``: water-filling (dev only if too large).
    Any other name: resize.
    """
    if sizes is None:
        sizes = {r[split]: r["n"] for r in group_counts(df, [split]).collect()}
    if sizes.get("train", 0) <= max_size:
        return df

    def cut(part: DataFrame, size: int) -> DataFrame:
        if policy == "random":
            return resize(undersample(part, key, label, seed), key, max_size, stratify_on, seed)
        if policy == "weighted":
            return water_filling_sample(part, key, max_size, label, seed)
        return resize(part, key, max_size, stratify_on, seed)

    train = cut(df.filter(F.col(split) == "train"), sizes["train"])
    dev = df.filter(F.col(split) == "dev")
    if policy != "weighted" or sizes.get("dev", 0) > max_size:
        dev = cut(dev, sizes.get("dev", 0))
    rest = df.filter(~F.col(split).isin("train", "dev"))
    return train.unionByName(dev).unionByName(rest)


def downsample_class(
    df: DataFrame, key: str, value: str, size: int, label: str = "label", seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """Cut one named class to ``size`` rows; rows of the other classes all stay."""
    named = F.coalesce(F.col(label) == value, F.lit(False))
    return df.filter(~named).unionByName(take_up_to(df.filter(named), [label], key, size, seed))


def evaluation_subset(
    df: DataFrame, key: str, n_samples: int = TEST_SUBSET, label: str = "label", seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """The whole table when it is small enough, else a water-filling sample."""
    return df if df.limit(n_samples + 1).count() <= n_samples else water_filling_sample(df, key, n_samples, label, seed)


def sample_documents_per_query(
    df: DataFrame, query: str = "query", document: str = "document_id", n: int = DOCUMENTS_PER_QUERY,
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """All rows of up to ``n`` documents per query value (null is a value of its own)."""
    # The cut reads the pairs three times; they are far smaller than what they come from.
    pairs = cut_lineage(df.select(query, document).distinct())
    chosen = take_up_to(pairs, [query], document, n, seed).select(document).distinct()
    return df.join(chosen, document, "left_semi")


def take_up_to(
    df: DataFrame, group: Sequence[str], key: str, n: int, seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """Up to ``n`` rows per group in hash order; smaller groups stay whole."""
    return take_ranked(df, group, key, lambda size: F.least(size, F.lit(n)), seed=seed)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by a named order."""
    return df.orderBy(*order).limit(n)


def negative_answers(
    df: DataFrame, key: str, question: str = "question", answer: str = "answer", buckets: int = 1024,
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """Add ``false_answer``: the answer of a row drawn among all rows whose answer is never given to this row's question.

    The draw is exact and complete: null only where the question's own answers are all there are. Distinct answers lie
    on a line, each as long as its rows are many. A question's own answers are gaps in it; a row draws a place
    on what is left, and the gaps before it shift it to its place on the line. Gaps and places meet in order, in
    ``buckets`` pieces of each question and of the line, whose offsets are running totals over the pieces: no window
    holds a whole question or answer. Only ids, digests and numbers travel; the drawn text is fetched at the end.
    """
    pool = df.select(F.col(key).alias("id"), F.coalesce(digest(question), F.lit("")).alias("q"), digest(answer).alias("a"))
    pool = cut_lineage(pool)
    given = pool.filter(F.col("a").isNotNull())
    answers = given.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("drawn"))
    answers = answers.withColumn("p", F.substring("a", 1, 4))
    answers = cut_lineage(_running(answers, [], "p", "n", ["a"], "start").drop("p"))
    total = answers.agg(F.sum("n")).first()[0] or 0
    width = max(1, -(-total // buckets))

    known = given.select("q", "a").distinct().join(answers.select("a", "start", "n"), "a")
    known = known.withColumn("p", F.floor(F.col("start") / width))
    known = _running(known, ["q"], "p", "n", ["start"], "before").withColumn("v", F.col("start") - F.col("before"))
    known = cut_lineage(known.select("q", "v", "n"))
    owned = known.groupBy("q").agg(F.sum("n").alias("owned"))
    free = (F.lit(total) - F.coalesce("owned", F.lit(0))).alias("free")
    rows = pool.join(owned, "q", "left").select("id", "q", free).filter("free > 0")
    place = F.conv(F.substring(hash_hex("id", seed=seed), 1, 15), 16, 10).cast("bigint") % F.col("free")
    none = F.lit(None).cast(dict(pool.dtypes)["id"])
    gaps = known.join(owned, "q").select("q", "v", "n", free, none.alias("id"), F.lit(0).alias("kind"))
    drawn = rows.select("q", place.alias("v"), F.lit(0).cast("bigint").alias("n"), "free", "id", F.lit(1).alias("kind"))
    both = gaps.unionByName(drawn).withColumn("p", F.floor(F.col("v") / F.greatest(F.ceil(F.col("free") / buckets), F.lit(1))))
    placed = _running(both, ["q"], "p", "n", ["v", "kind"], "shift").filter("kind = 1")
    placed = placed.select("id", (F.col("v") + F.col("shift")).alias("v"))

    salts = 16
    pieces = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width))).alias("p")
    line = answers.select(pieces, F.col("start").alias("v"), "drawn")
    line = line.select("*", none.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    seek = placed.select(
        F.floor(F.col("v") / width).alias("p"), "v", F.lit(None).cast(dict(answers.dtypes)["drawn"]).alias("drawn"), "id",
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
    )
    order = W.partitionBy("p", "salt").orderBy("v", F.col("id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = line.unionByName(seek).withColumn("drawn", F.last("drawn", True).over(order)).filter(F.col("id").isNotNull())
    found = found.select("id", "drawn")
    texts = df.select(F.col(key).alias("drawn"), F.col(answer).alias("false_answer"))
    chosen = found.join(texts, "drawn").select(F.col("id").alias("__for"), "false_answer")
    return df.join(chosen, F.col(key) == F.col("__for"), "left").drop("__for")


def _running(df: DataFrame, group: list[str], piece: str, n: str, order: list[str], name: str) -> DataFrame:
    """Sum of ``n`` over the rows before each row by (``piece``, ``order``) in its group.

    Pieces are summed first; their running totals are one row per group and piece, and rows are only ordered inside
    a piece.
    """
    sums = df.groupBy(*group, piece).agg(F.sum(n).alias("__s"))
    upto = W.partitionBy(*group).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*group, piece, F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__o"))
    inside = W.partitionBy(*group, piece).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(offsets, [*group, piece])
    return out.withColumn(name, F.col("__o") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("__o")


def stack_answers(df: DataFrame, question: str, answer: str, false_answer: str) -> DataFrame:
    """(query, text, label): the true answers with 1 and the drawn ones with 0, in one pass; nothing for what wasn't drawn."""
    pair = F.explode(
        F.filter(
            F.array(
                F.struct(F.col(answer).alias("text"), F.lit(1).alias("label")),
                F.struct(F.col(false_answer).alias("text"), F.lit(0).alias("label")),
            ),
            lambda p: (p["label"] == 1) | p["text"].isNotNull(),
        )
    ).alias("p")
    return df.select(F.col(question).alias("query"), pair).select("query", "p.text", "p.label")


def _counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Class sizes, counted once: a local table, or a written one where there are very many classes."""
    counts = cut_lineage(group_counts(df, group))
    local = small_table(counts)
    return counts if local is None else local
