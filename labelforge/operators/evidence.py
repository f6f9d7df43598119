"""Scores of predicted evidence tuples (query, stance, pages) against gold ones.

Tables are flat: one row per document, query, stance and page list. All tuples of a document are dealt out once and scored as
arrays. A document of more than DOCUMENT_TUPLES tuples or DOCUMENT_PAGES pages is spread instead: its pages are bits of 64-bit
words, and its sets of pages meet on (document, word).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelforge.operators.attach import null_safe_join
from labelforge.session import cut_lineage

# Which parts a facet compares.
OVERLAP_FACETS = {"page": (), "query": ("query",), "stance": ("stance",)}
DOCUMENT_FACETS = {"page": ("page",), "query": ("query",), "stance": ("stance",)}
STRICT_FACETS = {
    "all": ("pages", "query", "stance"), "page": ("pages",), "query": ("pages", "query"), "stance": ("pages", "stance"),
}
EPSILON = 1e-16
DOCUMENT_TUPLES, DOCUMENT_PAGES = 64, 4096
#: Tuples of a partition, about: their number grows with the table.
TUPLES_A_TASK = 1 << 20
SUMS = ("g", "s", "c", "w_g", "w_s")


def process_score(x: Column) -> Column:
    """Percentage cut (not rounded) to one decimal."""
    return F.floor(x * 1000) / 10


def flatten(documents: DataFrame) -> DataFrame:
    """Nested documents to (document_id, query, stance, pages). Repeated documents add up."""
    one = documents.select("document_id", F.explode("evidences").alias("e"))
    return one.select("document_id", "e.query", "e.stance", F.col("e.page_indices").alias("pages"))


def evidence_tuples(flat: DataFrame, facet: Sequence[str]) -> DataFrame:
    """Distinct tuples after masking: (document_id, query, stance, pages as a sorted set). No pages is an error."""
    mask = lambda c: F.col(c) if c in facet else F.lit("_")
    return _checked(flat).select("document_id", mask("query").alias("query"), mask("stance").alias("stance"), "pages").distinct()


def _checked(flat: DataFrame) -> DataFrame:
    """Pages as a sorted set; an evidence without pages is an error."""
    return flat.withColumn("pages", F.when(F.size("pages") > 0, F.array_sort(F.array_distinct("pages"))).otherwise(_no_page()))


def _no_page() -> Column:
    return F.raise_error(F.concat(F.lit("no page in "), F.col("document_id").cast("string"))).cast("array<int>")


def _page_bits(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pages of the tuples of all overlap facets and both sides as words of 64 bits, written once.

    (facet, document_id, value, side, pages_id, n, word, bits): a tuple is a masked value and a set of pages, which 64 bits
    tell apart within a document. Equal tuples fall together while they are counted, before the shuffle.
    """
    both = _checked(gold).select("document_id", "query", "stance", "pages", F.lit("g").alias("side")).unionByName(
        _checked(pred).select("document_id", "query", "stance", "pages", F.lit("s").alias("side"))
    )
    value = lambda columns: F.to_json(F.struct(*columns)) if len(columns) > 1 else F.col(columns[0]) if columns else F.lit("_")
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), value(c).cast("string").alias("value")) for f, c in OVERLAP_FACETS.items()])).alias("m")
    page = both.select("document_id", "side", F.xxhash64("pages").alias("pages_id"), F.size("pages").alias("n"), facets, "pages")
    page = page.select("m.facet", "document_id", "m.value", "side", "pages_id", "n", F.explode("pages").alias("page"))
    bit = F.expr("shiftleft(1L, cast(pmod(page, 64) as int))")
    return cut_lineage(page.withColumn("word", F.floor(F.col("page") / 64)).groupBy(
        "facet", "document_id", "value", "side", "pages_id", "n", "word"
    ).agg(F.bit_or(bit).alias("bits")))


def _cover(bits: DataFrame) -> DataFrame:
    """(document_id, side, pages_id, w): the largest share of a set of pages that a set of the other side covers.

    Only distinct sets of a document meet, by word; their common pages are the bits of the AND.
    """
    sets = bits.filter(F.col("facet") == next(f for f, c in OVERLAP_FACETS.items() if not c))
    one = lambda side: sets.filter(F.col("side") == side).select(
        "document_id", "word", F.col("pages_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")
    )
    common = F.bit_count(F.col("bits_g").bitwiseAND(F.col("bits_s")))
    pairs = one("g").join(one("s"), ["document_id", "word"]).withColumn("common", common).filter("common > 0")
    pairs = pairs.groupBy("document_id", "g", "s").agg(F.sum("common").alias("common"), F.max("n_g").alias("n_g"), F.max("n_s").alias("n_s"))
    ends = F.explode(F.array(*[
        F.struct(F.lit(x).alias("side"), F.col(x).alias("pages_id"), (F.col("common") / F.col(f"n_{x}")).alias("w")) for x in ("s", "g")
    ])).alias("e")
    return pairs.select("document_id", ends).groupBy("document_id", "e.side", "e.pages_id").agg(F.max("e.w").alias("w"))


def overlap_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Weighted precision, recall and F1 for the page, query and stance facets.

    A tuple counts when a tuple of the other side with its query and stance shares a page; its weight is the largest share of
    its pages that any tuple of the document covers.
    """
    return _scores(gold, pred, ("overlap",))


def document_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Set scores on (document, page), (document, query), (document, stance); tuples without pages do not count."""
    return _scores(gold, pred, ("document",))


def strict_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Set scores with the whole sorted page list (repeats kept) as part of the key."""
    return _scores(gold, pred, ("strict",))


def all_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlap, document and strict scores in one long table."""
    return _scores(gold, pred, ("overlap", "document", "strict"))


def _scores(gold: DataFrame, pred: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The scores of some metrics: sums over documents, and over those that are spread.

    Tuples are written once: sizes and sums read them, and no task holds sizes beside what makes its tuples.
    """
    both = cut_lineage(_one_side(gold, "g").unionByName(_one_side(pred, "s")))
    sizes = both.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("pages"), F.lit(0))).alias("m"))
    sizes = sizes.withColumn("large", (F.col("n") > DOCUMENT_TUPLES) | (F.col("m") > DOCUMENT_PAGES))
    tuples = {r["large"]: r["n"] for r in sizes.groupBy("large").agg(F.sum("n").alias("n")).collect()}
    parts = []
    if True in tuples:
        large = cut_lineage(sizes.filter("large").select("document_id"))
        of = lambda df, how: null_safe_join(df, large, ["document_id"], how)
        spread = [of(both.filter(F.col("side") == x).drop("side"), "left_semi") for x in ("g", "s")]
        parts = [SPREAD[m](*spread) for m in metrics]
        both = of(both, "left_anti")
    sums = _union([_document_sums(both, tuples.get(False, 0), metrics), *parts])
    return _scored(sums.groupBy("metric", "facet").agg(*[F.sum(x).alias(x) for x in SUMS]))


def _one_side(flat: DataFrame, side: str) -> DataFrame:
    return flat.select("document_id", "query", "stance", "pages", F.lit(side).alias("side"))


def _document_sums(both: DataFrame, tuples: int, metrics: Sequence[str]) -> DataFrame:
    """Sums over documents whose tuples of both sides fit arrays: (metric, facet, g, s, c, w_g, w_s)."""
    partitions = math.ceil(tuples / TUPLES_A_TASK)
    if partitions > 1:
        partitions = max(partitions, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        both = both.repartition(partitions, "document_id")
    pages = F.array_sort("pages") if "overlap" not in metrics else F.when(F.size("pages") > 0, F.array_sort("pages")).otherwise(_no_page())
    # pages below 64 are bits of one word, too, which spares sets of them
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p.cast("int"))
    bits = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a.bitwiseOR(bit(p)))
    bits = F.when((F.array_min("pages") >= 0) & (F.array_max("pages") < 64), bits)
    one = F.struct("query", "stance", *([bits.alias("bits")] if "overlap" in metrics else []), pages.alias("pages"))
    documents = both.groupBy("document_id").agg(*[F.collect_list(F.when(F.col("side") == x, one)).alias(x) for x in ("g", "s")])
    if "overlap" in metrics:
        documents = _with_overlap_sets(documents)
    cells = {(m, f): {x: F.lit(None) for x in SUMS} | sums for m in metrics for f, sums in ARRAYS[m]().items()}
    kinds = {x: "bigint" if x in ("g", "s", "c") else "double" for x in SUMS}
    name = lambda m, f, x: f"{m}_{f}_{x}"
    one_row = documents.agg(*[
        F.coalesce(F.sum(c.cast(kinds[x])), F.lit(0).cast(kinds[x])).alias(name(m, f, x)) for (m, f), sums in cells.items() for x, c in sums.items()
    ])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(f).alias("facet"), *[F.col(name(m, f, x)).alias(x) for x in SUMS]) for m, f in cells
    ])))


def _document_arrays(sets: dict[str, dict[str, Column]]) -> dict[str, dict[str, Column]]:
    """Sizes of two sets of a document and of their intersection, of every facet."""
    return {f: {x: F.size(one[x]) for x in ("g", "s")} | {"c": F.size(F.array_intersect(one["g"], one["s"]))} for f, one in sets.items()}


def _strict_sums() -> dict[str, dict[str, Column]]:
    sets = lambda side, columns: F.array_distinct(F.transform(side, lambda t: F.struct(*[t[c].alias(c) for c in columns])))
    return _document_arrays({f: {x: sets(x, columns) for x in ("g", "s")} for f, columns in STRICT_FACETS.items()})


def _set_sums() -> dict[str, dict[str, Column]]:
    paged = lambda side: F.filter(side, lambda t: F.size(t["pages"]) > 0)
    one = lambda side, c: F.flatten(F.transform(paged(side), lambda t: t["pages"])) if c == "page" else F.transform(paged(side), lambda t: t[c])
    return _document_arrays({f: {x: F.array_distinct(one(x, c)) for x in ("g", "s")} for f, (c,) in DOCUMENT_FACETS.items()})


def _with_overlap_sets(documents: DataFrame) -> DataFrame:
    """Sets of tuples as columns, so that they are not made again for every tuple that asks them."""
    value = lambda t, columns: t[columns[0]] if columns else F.lit("_")
    apart = lambda t: F.when(t["bits"].isNull(), F.array_distinct(t["pages"]))
    sets = lambda side, columns: F.array_distinct(F.transform(
        side, lambda t: F.struct(value(t, columns).alias("value"), t["bits"].alias("bits"), apart(t).alias("pages"))
    ))
    return documents.withColumns({f"{x}_{f}": sets(x, columns) for f, columns in OVERLAP_FACETS.items() for x in ("g", "s")})


def _overlap_sums() -> dict[str, dict[str, Column]]:
    listed = lambda t: F.coalesce(t["pages"], F.filter(F.array(*map(F.lit, range(64))), lambda p: F.getbit(t["bits"], p) == 1))
    # two sets in words meet by AND; a null page equals no other
    common = lambda x, y: F.when(x["bits"].isNotNull() & y["bits"].isNotNull(), F.bit_count(x["bits"].bitwiseAND(y["bits"]))).otherwise(
        F.size(F.array_intersect(F.array_compact(listed(x)), listed(y)))
    )
    count = lambda x: F.coalesce(F.bit_count(x["bits"]), F.size(x["pages"]))

    def weight(mine: Column, other: Column, columns: Sequence[str]) -> Column:
        # a null value equals no other, nor does a null document
        same = lambda x, y: F.coalesce(x["value"] == y["value"], F.lit(False)) if columns else F.lit(True)
        hit = lambda x: F.exists(other, lambda y: same(x, y) & (common(x, y) > 0))
        most = lambda x: F.array_max(F.transform(other, lambda y: common(x, y)))
        weights = F.transform(mine, lambda x: F.when(hit(x), most(x) / count(x)).otherwise(0.0))
        return F.when(F.col("document_id").isNotNull(), F.aggregate(weights, F.lit(0.0), lambda a, w: a + w))

    out = {}
    for f, columns in OVERLAP_FACETS.items():
        g, s = F.col(f"g_{f}"), F.col(f"s_{f}")
        out[f] = {"g": F.size(g), "s": F.size(s), "w_g": weight(g, s, columns), "w_s": weight(s, g, columns)}
    return out


ARRAYS = {"overlap": _overlap_sums, "document": _set_sums, "strict": _strict_sums}


def _spread_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Sums of the overlap of documents with very many tuples.

    Whether a page is shared is asked of the union of the other side's pages with that query and stance, word by word, so that
    tuples of one value are never paired; how many are is asked of the distinct sets of pages, once for all facets.
    """
    bits = _page_bits(gold, pred)
    same = W.partitionBy("facet", "document_id", "value", "word")
    union = lambda side: F.bit_or(F.when(F.col("side") == side, F.col("bits"))).over(same)
    other = F.when(F.col("side") == "g", union("s")).otherwise(union("g"))
    # a null value equals no other
    hit = F.col("value").isNotNull() & F.coalesce(F.col("bits").bitwiseAND(other) != 0, F.lit(False))
    tuples = bits.withColumn("hit", hit).groupBy("facet", "document_id", "value", "side", "pages_id").agg(F.bool_or("hit").alias("hit"))
    weighted = tuples.join(_cover(bits), ["document_id", "side", "pages_id"], "left")
    total = lambda side: F.sum(F.when((F.col("side") == side) & F.col("hit"), F.col("w"))).alias(f"w_{side}")
    one = weighted.groupBy("facet").agg(*[F.count_if(F.col("side") == x).alias(x) for x in ("g", "s")], total("g"), total("s"))
    return one.select(F.lit("overlap").alias("metric"), "facet", "g", "s", F.lit(0).cast("bigint").alias("c"), "w_g", "w_s")


def _spread_sets(gold: DataFrame, pred: DataFrame, facets: dict, parts: Sequence[str], metric: str) -> DataFrame:
    """Sizes of two sets and of their intersection, for all facets and both sides in one aggregation.

    A part a facet does not compare is null in its key.
    """
    both = gold.withColumn("side", F.lit(1)).unionByName(pred.withColumn("side", F.lit(2)))
    keys = F.explode(F.array(*[
        F.struct(F.lit(name).alias("facet"), *[(F.col(p) if p in columns else F.lit(None)).alias(p) for p in parts])
        for name, columns in facets.items()
    ])).alias("k")
    rows = both.select("document_id", "side", keys).select("document_id", "side", "k.*")
    sides = rows.groupBy("facet", "document_id", *parts).agg(
        F.max((F.col("side") == 1).cast("int")).alias("in_g"), F.max((F.col("side") == 2).cast("int")).alias("in_s")
    )
    sums = sides.groupBy("facet").agg(
        F.sum("in_g").alias("g"), F.sum("in_s").alias("s"), F.sum(F.col("in_g") * F.col("in_s")).alias("c")
    )
    weight = lambda x: F.lit(0.0).alias(f"w_{x}")
    return sums.select(F.lit(metric).alias("metric"), "facet", "g", "s", "c", weight("g"), weight("s"))


def _spread_document(gold: DataFrame, pred: DataFrame) -> DataFrame:
    flat = lambda df: df.select("document_id", "query", "stance", F.explode("pages").alias("page"))
    return _spread_sets(flat(gold), flat(pred), DOCUMENT_FACETS, ("page", "query", "stance"), "document")


def _spread_strict(gold: DataFrame, pred: DataFrame) -> DataFrame:
    flat = lambda df: df.select("document_id", "query", "stance", F.array_sort("pages").alias("pages"))
    return _spread_sets(flat(gold), flat(pred), STRICT_FACETS, ("pages", "query", "stance"), "strict")


SPREAD = {"overlap": _spread_overlap, "document": _spread_document, "strict": _spread_strict}


def _scored(sums: DataFrame) -> DataFrame:
    """Precision, recall and F1 of sums: weights for the overlap, common members for sets."""
    overlap = F.col("metric") == "overlap"
    ratio = lambda x: F.when(overlap, F.col(f"w_{x}") / (F.col(x) + F.lit(EPSILON))).otherwise(F.when(F.col(x) > 0, F.col("c") / F.col(x)).otherwise(0.0))
    df = sums.withColumn("p", ratio("s")).withColumn("r", ratio("g"))
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return df.select(
        "metric", "facet", "g", "s", F.when(~overlap, F.col("c")).alias("c"),
        process_score(F.col("p")).alias("p"), process_score(F.col("r")).alias("r"), process_score(f).alias("f"),
    )


def score_row(scores: DataFrame) -> DataFrame:
    """The nine F numbers of the report, one column each."""
    wanted = [("strict", f) for f in ("page", "query", "stance")] + [("overlap", f) for f in ("page", "query", "stance")] + [
        ("document", f) for f in ("page", "query", "stance")
    ]
    pick = lambda m, f: F.max(F.when((F.col("metric") == m) & (F.col("facet") == f), F.col("f"))).alias(f"{m}_{f}")
    return scores.agg(*[pick(m, f) for m, f in wanted])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
