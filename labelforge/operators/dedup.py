"""Duplicates, label conflicts and leakage between splits.

Copies are found with hash aggregates over digests, never by sorting or collecting a group of copies: a text that makes
up a third of the table leaves one short row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate, combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.hashing import digest
from labelforge.functions.text import normalise_hard, remove_phrase
from labelforge.operators.attach import attach_small, null_safe_join, spread_join
from labelforge.session import cut_lineage


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct."""
    return df.dropDuplicates()


def key_digest(columns: Sequence[Column | str]) -> Column:
    """A digest of several columns, nulls included, so that a long text is no grouping key."""
    return F.sha2(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(columns)])), 256)


def _per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key digest: ``__n`` rows and the first ``order``. A hash aggregate of short columns."""
    return df.select(key_digest(keys).alias("__d"), F.col(order).alias("__o")).groupBy("__d").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__o").alias("__first")
    )


def _rows_of(df: DataFrame, chosen: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows whose key and ``order`` are chosen; only here do rows meet with their texts."""
    marked = df.withColumn("__d", key_digest(keys))
    match = (F.col("__d") == F.col("__c")) & F.col(order).eqNullSafe(F.col("__first"))
    return marked.join(chosen.select(F.col("__d").alias("__c"), "__first"), match, "left_semi").drop("__d")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per ``keys``: the first by ``order``, which is unique among the rows of a key (an id)."""
    return _rows_of(df, _per_key(df, keys, order), keys, order)


def drop_all_copies(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Only rows whose ``keys`` occur once."""
    return _rows_of(df, _per_key(df, keys, order).filter("__n = 1"), keys, order)


def drop_conflicting_negatives(df: DataFrame, keys: Sequence[str], label: str = "label", order: str = "doc_id") -> DataFrame:
    """For ``keys`` that occur more than once, drop every row with label 0.

    Rows with another label pass through untouched; a label-0 row stays when its key occurs once. Digests of all rows
    are counted, and of the rows themselves only those with label 0 are shuffled.
    """
    zero = F.coalesce(F.col(label) == 0, F.lit(False))
    single = _per_key(df, keys, order).filter("__n = 1")
    return df.filter(~zero).unionByName(_rows_of(df.filter(zero), single, keys, order))


def duplicate_counts(df: DataFrame, definitions: dict[str, Sequence[Column]]) -> DataFrame:
    """Per named key definition: rows, rows that have a copy, copies beyond the first."""
    named = [F.struct(F.lit(name).alias("definition"), key_digest(columns).alias("d")) for name, columns in definitions.items()]
    keyed = df.select(F.explode(F.array(*named)).alias("k")).groupBy("k.definition", "k.d").agg(F.count(F.lit(1)).alias("n"))
    found = keyed.groupBy("definition").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("with_copy"), F.sum(F.col("n") - 1).alias("surplus")
    )
    # an empty table has a row of zeros per definition
    names = df.sparkSession.createDataFrame([(n,) for n in definitions], "definition string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(found, "definition", "left").select("definition", F.col("n_rows"), zero("with_copy"), zero("surplus"))


def entity_blind_copies(df: DataFrame, text: str, phrase: str, key: str) -> DataFrame:
    """Rows whose text, without the row's own phrase and normalised, occurs more than once: (key, n_copies)."""
    blind = cut_lineage(df.select(F.col(key), digest(normalise_hard(remove_phrase(text, phrase))).alias("__d")).filter("__d is not null"))
    sizes = blind.groupBy("__d").agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return spread_join(blind, sizes, ["__d"], "inner").select(key, "n_copies")


def leakage_matrix(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """Per pair of splits: texts they share, and the rows a join on the text would pair up.

    Counted from per-text counts, so that a text with many copies in both splits is not multiplied out.
    """
    sizes = df.select(digest(text).alias("d"), split).groupBy("d", split).agg(F.count(F.lit(1)).alias("n"))
    left = sizes.select("d", F.col(split).alias("split_a"), F.col("n").alias("n_a"))
    right = sizes.select("d", F.col(split).alias("split_b"), F.col("n").alias("n_b"))
    return (
        left.join(right, "d")
        .filter(F.col("split_a") < F.col("split_b"))
        .groupBy("split_a", "split_b")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_a") * F.col("n_b")).alias("row_pairs"))
    )


def leaking_rows(df: DataFrame, source: str, target: str, key: str, text: str = "text", split: str = "split") -> DataFrame:
    """Rows of split ``target`` whose text also occurs in split ``source``, with the number of copies there."""
    theirs = df.filter(F.col(split) == source).groupBy(digest(text).alias("d")).agg(F.count(F.lit(1)).alias("n_copies"))
    ours = cut_lineage(df.filter(F.col(split) == target).select(key, digest(text).alias("d")).filter("d is not null"))
    return spread_join(ours, theirs, ["d"], "inner").select(key, "n_copies")


def contamination(
    documents: DataFrame, items: DataFrame, key: str, item_key: str, text: str = "text", item_text: str = "text"
) -> DataFrame:
    """Per document: ``lines`` that also occur in a benchmark item, and ``item_hits``, over these lines the items that
    have them.

    Lines meet on the digest of their normalised text. The items of a line are counted before the join, so that a
    line of many documents and many items is not multiplied out.
    """
    def lines(df: DataFrame, k: str, t: str) -> DataFrame:
        parts = df.select(F.col(k), F.explode(F.split(F.col(t), "\n")).alias("line"))
        norm = parts.select(k, normalise_hard("line").alias("line")).filter(F.length("line") > 0)
        return norm.select(k, digest("line").alias("d"))

    known = lines(items, item_key, item_text).distinct().groupBy("d").agg(F.count(F.lit(1)).alias("n_items"))
    ours = cut_lineage(lines(documents, key, text).distinct())
    found = spread_join(ours, known, ["d"], "inner")
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.sum("n_items").alias("item_hits"))


#: Letters whose numbers bound the distance: a substitution changes two of them by one, any other edit one.
COUNTED = "etaoinsr"


def _bounds(parts: int, place: Column, length: Column) -> tuple[Column, Column]:
    """Begin and size of the piece ``place`` of ``parts`` nearly equal ones of a text."""
    begin = lambda i: F.floor(i * length / F.lit(parts)).cast("int")
    return begin(place), begin(place + 1) - begin(place)


def _piece_keys(texts: DataFrame, parts: int, shared: int) -> DataFrame:
    """(g, id, letters, piece) of every choice of ``shared`` of ``parts`` pieces of each text: ``piece`` is a hash of the length,
    the choice and the pieces."""
    out = texts.select("g", "id", "len", "t", "letters", F.explode(_choices(parts, shared)).alias("i"))
    pieces = []
    for c in range(shared):
        at, size = _bounds(parts, F.get("i", F.lit(c)), F.col("len"))
        pieces.append(F.substr("t", at + 1, size))
    return out.select("g", "id", "letters", F.xxhash64("len", "i", *pieces).alias("piece"))


def _choices(parts: int, shared: int) -> Column:
    return F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(parts), shared)])


def _shifted(parts: int, shared: int, k: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(extra length, choice, its pieces' shifts) under which every text within ``k`` = parts - shared edits is found.

    Cut the longer text where the edits cut it, one part for each piece. Before the first piece up to which there are fewer
    edits than pieces stand as many edits as pieces, and none in it; the same holds again for the pieces behind it. So the
    chosen pieces shift by no more than the number of pieces left out before them, and the last leaves no more than are left out behind.
    """
    out = []
    for extra in range(k + 1):
        for choice in combinations(range(parts), shared):
            gaps = [choice[0], *(b - a - 1 for a, b in zip(choice, choice[1:], strict=False))]
            for moves in product(*(range(-g, g + 1) for g in gaps)):
                if abs(extra - sum(moves)) <= parts - 1 - choice[-1]:
                    out.append((extra, choice, tuple(accumulate(moves))))
    return out


def _piece_probes(texts: DataFrame, parts: int, shared: int, k: int) -> DataFrame:
    """The keys under which texts of the same or a smaller length, within ``k`` edits, may be found."""
    ints = lambda x: F.array(*map(F.lit, x))
    ways = F.array(*[F.struct(F.lit(e).alias("extra"), ints(i).alias("i"), ints(s).alias("s")) for e, i, s in _shifted(parts, shared, k)])
    out = texts.withColumnRenamed("len", "own").select("g", "id", "t", "letters", "own", F.explode(ways).alias("way"))
    out = out.select("g", "id", "t", "letters", "own", "way.i", "way.s", (F.col("own") - F.col("way.extra")).alias("len")).filter("len >= 0")
    pieces, inside = [], F.lit(True)
    for c in range(shared):
        begin, size = _bounds(parts, F.get("i", F.lit(c)), F.col("len"))
        at = begin + F.get("s", F.lit(c))
        inside &= (at >= 0) & (at + size <= F.col("own"))
        pieces.append(F.substr("t", at + 1, size))
    # a text that shifts bring to one key twice gives a pair twice, which the pairs' distinct mends
    return out.filter(inside).select("g", "id", F.col("letters").alias("own_letters"), F.xxhash64("len", "i", *pieces).alias("piece"))


#: The number first: joins sort by it, and by a name of few values only among equal numbers.
PIECE_KEY = ["piece", "g"]


def _letter_counts(text: str, length: str) -> Column:
    """The numbers of the counted letters, up to 255 each, as the bytes of one number."""
    count = lambda c: F.least(F.col(length) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))), F.lit(255)).cast("bigint")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(count(c), 8 * i) for i, c in enumerate(COUNTED)])


def _candidates(probes: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Pairs (g, a, b) that share a key and whose letters differ by no more than ``k`` edits can make them."""
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte("letters", i) - byte("own_letters", i)) for i in range(len(COUNTED))), F.lit(0))
    keys = [c for c in (*PIECE_KEY, "__block") if c in index.columns]
    pairs = probes.withColumnRenamed("id", "long").join(index.withColumnRenamed("id", "short"), keys)
    pairs = pairs.filter((F.col("long") != F.col("short")) & (apart <= 2 * k))
    return pairs.select("g", F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"))


def _in_blocks(probes: DataFrame, index: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """A key of more than ``most`` texts is dealt out to blocks by their ids, and its probes visit every block."""
    sizes = index.groupBy(*PIECE_KEY).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__blocks")).filter("__blocks > 1")
    sizes = cut_lineage(sizes)
    wide = lambda df: attach_small(df, sizes, PIECE_KEY).withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    index = wide(index).withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).drop("__blocks")
    return wide(probes).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks"), index


def edit_distance_pairs(
    df: DataFrame, group: str, key: str, text: str, max_distance: int, carry: Sequence[str] = (), hot: int = 256
) -> DataFrame:
    """All unordered pairs of different texts of a group within ``max_distance`` edits: exact, without all pairs.

    Cut a text into ``max_distance + 1`` pieces: a text within that many edits leaves one piece whole, at one of the few
    places that :func:`_shifted` names. So candidates come from an equi-join on (group, length, piece number, piece)
    and only they are measured. A piece of more than ``hot`` texts (a template) is no key: its texts are cut into one piece
    more, of which two are whole, and meet on both. What then still has more than ``hot`` texts is compared in blocks, so that
    no task holds all pairs of a key. Before texts are fetched, the numbers of some letters must be near enough. Copies
    of a text are one row here, with their count in ``copies_a``/``copies_b`` (distance 0 is the business of the exact
    operators), so that a group of copies cannot multiply. Null texts take no part.
    """
    k = max_distance
    # the least number alone is hashed; a struct makes Spark sort all texts
    first = F.min(F.struct(F.col(key).alias("id"), *carry)) if carry else F.struct(F.min(key).alias("id"))
    texts = (
        df.filter(F.col(text).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(text).alias("t"))
        .agg(first.alias("row"), F.count(F.lit(1)).alias("copies"))
        .select("g", "t", "copies", F.col("row.id").alias("id"), *[F.col(f"row.{c}").alias(c) for c in carry])
        .withColumn("len", F.length("t"))
    )
    texts = cut_lineage(texts.withColumn("letters", _letter_counts("t", "len")))
    index, probes = _piece_keys(texts, k + 1, 1), _piece_probes(texts, k + 1, 1, k)
    crowded = cut_lineage(index.groupBy(*PIECE_KEY).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot).drop("__n").withColumn("__hot", F.lit(True)))
    if crowded.isEmpty():
        hits = _candidates(probes, index, k)
    else:
        index, probes = (attach_small(d, crowded, PIECE_KEY) for d in (index, probes))
        hits = _candidates(*(d.filter("__hot is null").drop("__hot") for d in (probes, index)), k)
        once = lambda d: texts.join(d.filter("__hot").select("g", "id").distinct(), ["g", "id"], "left_semi")
        again = _in_blocks(_piece_probes(once(probes), k + 2, 2, k), _piece_keys(once(index), k + 2, 2), hot)
        hits = hits.union(_candidates(*again, k))
    side = lambda s: texts.select(
        F.col("g"), F.col("id").alias(s), F.col("t").alias(f"t_{s}"), F.col("copies").alias(f"copies_{s}"),
        *[F.col(c).alias(f"{c}_{s}") for c in carry],
    )
    measured = hits.distinct().join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
    measured = measured.withColumn("distance", F.levenshtein("t_a", "t_b", k)).filter(F.col("distance").between(1, k))
    return measured.drop("t_a", "t_b").withColumnRenamed("g", group)


def common_rows(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner and full-outer sizes of a join on ``on`` (null matches null), from counts per key and side."""
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n_a"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("n_b"))
    both = null_safe_join(a, b, on, "full").select(
        F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")
    )
    pairs = F.col("n_a") * F.col("n_b")
    return both.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
        F.coalesce(F.sum(pairs), F.lit(0)).alias("inner_pairs"),
        F.coalesce(F.sum(F.when(pairs > 0, pairs).otherwise(F.col("n_a") + F.col("n_b"))), F.lit(0)).alias("outer_pairs"),
        F.coalesce(F.sum((pairs > 0).cast("bigint")), F.lit(0)).alias("inner_keys"),
        F.count(F.lit(1)).alias("outer_keys"),
    )
