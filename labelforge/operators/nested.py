"""Nested documents, pages, claims, votes, and reshaping between wide, long and nested forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.operators.attach import with_catalogue

# The separator between blocks of a rebuilt page is a backslash and an n, not a line feed.
BLOCK_SEPARATOR = "\\n"

DOCUMENT_SCHEMA = (
    "document_id string,"
    "sentences array<struct<page_idx:int,sentence_id:string,block_idx:int,block_sentence_idx:int,text:string>>,"
    "evidences array<struct<query:string,stance:string,page_indices:array<int>,comment:string>>,"
    "meta struct<evidences:array<array<struct<sentence_ids:array<string>>>>>"
)
CLAIM_SCHEMA = (
    "claim_id string, claim string, claim_label string,"
    "evidences array<struct<article:string,entropy:double,evidence:string,evidence_id:string,evidence_label:string,"
    "votes:array<string>>>"
)


def join_ordered(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, sep: str, name: str = "text") -> DataFrame:
    """Texts of a group in a named order, joined by ``sep``. One group is one output text (a page, a block)."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(items, lambda x: x["__t"]), sep).alias(name))


def sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence, with its position in the document."""
    exploded = documents.select("document_id", F.posexplode("sentences").alias("pos", "s"))
    return exploded.select("document_id", "pos", "s.*")


def rebuild_pages_by_block(sents: DataFrame) -> DataFrame:
    """Sentences of a block run together, blocks joined in order: (document_id, page_idx, text)."""
    blocks = join_ordered(sents, ["document_id", "page_idx", "block_idx"], ["pos"], "text", "")
    return join_ordered(blocks, ["document_id", "page_idx"], ["block_idx"], "text", BLOCK_SEPARATOR)


def rebuild_pages_by_sentence(sents: DataFrame, order: Sequence[str] = ("sentence_id",)) -> DataFrame:
    """Sentences of a page joined by a space, by sentence id or by (block, place in block)."""
    return join_ordered(sents, ["document_id", "page_idx"], list(order), "text", " ")


def page_map(pages: DataFrame) -> DataFrame:
    """(document_id, map page -> text)."""
    return pages.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_idx", "text")))).alias("pages")
    )


def evidence_pages(evidences: Column | str = "evidences") -> Column:
    """The set of pages any evidence of the document points at, sorted."""
    e = F.col(evidences) if isinstance(evidences, str) else evidences
    return F.array_sort(F.array_distinct(F.flatten(F.transform(e, lambda x: x["page_indices"]))))


def evidence_rows(documents: DataFrame) -> DataFrame:
    """(document_id, page_idx, query, stance, comment), one row per evidence and page."""
    one = documents.select("document_id", F.explode("evidences").alias("e"))
    return one.select(
        "document_id", F.explode("e.page_indices").alias("page_idx"), "e.query", "e.stance", "e.comment"
    )


def page_queries(documents: DataFrame) -> DataFrame:
    """(document_id, page_idx, label): the sorted list of queries of a page."""
    return collect_labels(evidence_rows(documents), ["document_id", "page_idx"], "query", repeats=True)


def collect_labels(df: DataFrame, keys: Sequence[str], value: str, name: str = "label", repeats: bool = False) -> DataFrame:
    """Labels per key as a sorted list. Without ``repeats`` a key holds at most the label vocabulary, so that a text
    with very many copies stays small; with them, its list is as long as its rows are many."""
    values = F.collect_list(value) if repeats else F.collect_set(value)
    return df.groupBy(*keys).agg(F.array_sort(values).alias(name))


def labelled_pages(documents: DataFrame) -> DataFrame:
    """Pages with label 1 where an evidence points at them."""
    pages = rebuild_pages_by_block(sentences(documents))
    marks = evidence_rows(documents).select("document_id", "page_idx").distinct().withColumn("label", F.lit(1))
    return pages.join(marks, ["document_id", "page_idx"], "left").fillna(0, ["label"])


def attach_pages(rows: DataFrame, pages: DataFrame, page: str = "page_idx") -> DataFrame:
    """Left join of evidence rows with page texts; rows on missing pages keep a null text."""
    renamed = pages.select(F.col("document_id"), F.col("page_idx").alias(page), "text")
    return rows.join(renamed, ["document_id", page], "left")


def sentence_membership(documents: DataFrame) -> DataFrame:
    """Sentences with 1 where the first entry of an evidence lists them.

    Sentences and listed ids meet in a join, so that a document with many of both is not searched once per sentence.
    """
    ids = F.flatten(F.transform("meta.evidences", lambda e: F.get(e, F.lit(0))["sentence_ids"]))
    listed = documents.select("document_id", F.explode(ids).alias("sentence_id")).distinct().withColumn("y", F.lit(1))
    sents = documents.select("document_id", F.explode("sentences").alias("s")).select(
        "document_id", F.col("s.page_idx").alias("page_id"), "s.sentence_id", F.col("s.text").alias("sentences")
    )
    return sents.join(listed, ["document_id", "sentence_id"], "left").select(
        "document_id", "page_id", "sentence_id", "sentences", F.coalesce("y", F.lit(0)).alias("y")
    )


def claim_evidence_rows(claims: DataFrame) -> DataFrame:
    """Claims to (claim_id, text = evidence, query = claim, label = evidence label)."""
    one = claims.select("claim_id", F.col("claim").alias("query"), "claim_label", F.explode("evidences").alias("e"))
    return one.select(
        "claim_id", "query", "claim_label", F.col("e.evidence").alias("text"), F.col("e.evidence_label").alias("label"),
        F.col("e.evidence_id").alias("evidence_id"), F.col("e.votes").alias("votes"),
    )


def array_to_columns(df: DataFrame, array: str, n: int, prefix: str) -> DataFrame:
    """``array`` to ``prefix1..prefixn``; missing places become null."""
    return df.select("*", *[F.get(F.col(array), F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(n)])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "task", value: str = "label") -> DataFrame:
    """Wide to long: one binary task per column."""
    return df.unpivot(list(ids), list(values), name, value)


def spread_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Long to wide counts with 0 for absent cells. Values are named, so that no extra pass looks for them."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def nest_evidences(flat: DataFrame) -> DataFrame:
    """(document_id, query, stance, page) rows to documents with an evidence list."""
    one = flat.groupBy("document_id", "query", "stance").agg(F.array_sort(F.collect_set("page")).alias("page_indices"))
    packed = F.array_sort(F.collect_list(F.struct("query", "stance", "page_indices")))
    return one.groupBy("document_id").agg(packed.alias("evidences"))


def as_page_list(raw: Column | str) -> Column:
    """``3`` or ``[3, 4]`` as text to ``array<int>``."""
    c = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    return F.when(c.startswith("["), F.from_json(c, "array<int>")).otherwise(F.array(c.try_cast("int")))


def as_evidence_list(raw: Column | str) -> Column:
    """One ``(query, stance, pages)`` tuple or a list of them, as printed, to an array of structs.

    The printed tuples hold no nested parentheses, so each is one match of a pattern.
    """
    c = F.col(raw) if isinstance(raw, str) else raw
    quoted = r"(?:'((?:[^'\\]|\\.)*+)'|\"((?:[^\"\\]|\\.)*+)\")"  # in one quote sign, which may hold the other
    body = rf"\s*{quoted}\s*,\s*{quoted}\s*,\s*(\[[^\]]*\]|[0-9]+)\s*"
    pattern, bracketed = rf"\({body}\)", rf"^\s*\[?{body}\]?\s*$"

    def one(text: Column, pat: str) -> Column:
        group = lambda i: F.regexp_replace(F.concat(F.regexp_extract(text, pat, i), F.regexp_extract(text, pat, i + 1)), r"\\(.)", "$1")
        return F.struct(group(1).alias("query"), group(3).alias("stance"), as_page_list(F.regexp_extract(text, pat, 5)).alias("page_indices"))

    tuples = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.when(c.rlike(bracketed), F.array(one(c, bracketed))).otherwise(
        F.transform(tuples, lambda t: one(t, pattern))
    )


def expand_to_queries(df: DataFrame, queries: DataFrame, labels: str = "label") -> DataFrame:
    """Every text with every known query and whether the query is among its labels.

    A Cartesian product by meaning (see :func:`with_catalogue`). A null list has no labels.
    """
    wide = with_catalogue(df, queries.select("query"), "query")
    return wide.withColumn("label", F.coalesce(F.array_contains(labels, F.col("query")), F.lit(False)))


def gold_and_first_prediction(df: DataFrame, key: str, gold: str, pred: str, order: str) -> DataFrame:
    """Per input: all gold rows as a sorted list, and the prediction of the first row by ``order``."""
    return df.groupBy(key).agg(
        F.array_sort(F.collect_list(gold)).alias("gold"), F.min_by(pred, order).alias("prediction")
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a part become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
