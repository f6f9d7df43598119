"""Error tables, error sheets, tag statistics, taxonomy and overlap of several models' errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.hashing import DEFAULT_SEED
from labelforge.functions.text import strip
from labelforge.operators.attach import null_safe_join
from labelforge.operators.cleaning import map_values
from labelforge.operators.dedup import common_rows
from labelforge.operators.splits import take_up_to

# Tag classes of the error taxonomy and the files that hold no sheets.
ACTUAL_TAGS = ["error", "honest-mistake", "indirect", "implicit-describe", "table", "list"]
DEBATABLE_TAGS = [
    "ambiguous", "main-branch", "cropped-small", "off-topic", "debatable", "out-of-context", "close", "page-selection",
    "nature-arg", "exhaustif",
]
MULTI_TAGS = ["multi", "multiple"]
MISLABELED_TAGS = ["wrong"]
CLASSES = ["Actual Error", "Debatable Error", "Mislabeled", "Multilabel"]
SKIPPED_FILES = "_old|archive|[.]zip|iaa"
SAMPLE = 10


def error_rows(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Rows whose prediction differs from gold; a missing prediction is an error."""
    return df.filter(~F.col(y_pred).cast("string").eqNullSafe(F.col(y_true).cast("string")))


def error_sheets(
    df: DataFrame, key: str, negative: str, positive: str, readable: DataFrame | None = None, n: int = SAMPLE,
    y_true: str = "label", y_pred: str = "y_pred", seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """Up to ``n`` errors predicted negative (side ``fn``) and positive (``fp``), with an empty comment."""
    side = F.when(F.col(y_pred).cast("string") == negative, "fn").when(F.col(y_pred).cast("string") == positive, "fp")
    errors = error_rows(df, y_true, y_pred).withColumn("side", side).filter(F.col("side").isNotNull())
    sheet = take_up_to(errors, ["side"], key, n, seed).withColumn("comment", F.lit(""))
    return sheet if readable is None else map_values(sheet, y_true, readable, mode="identity")


def tags(comment: Column | str) -> Column:
    """Tags before the first colon, trimmed."""
    c = F.col(comment) if isinstance(comment, str) else comment
    return F.transform(F.split(F.substring_index(c, ":", 1), ","), strip)


def tag_counts(df: DataFrame, by: Sequence[str] = (), comment: str = "comment") -> DataFrame:
    """Per sheet and tag: rows with the tag, rows in all, share."""
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    each = df.select(*by, F.explode(F.array_distinct(tags(comment))).alias("tag"))
    counts = each.groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("n"))
    return null_safe_join(counts, total, list(by)).withColumn("share", F.col("n") / F.col("total"))


def _has(comment: str, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(tags(comment), F.array(*[F.lit(t) for t in wanted]))


def taxonomy(df: DataFrame, comment: str = "comment", name: str = "error") -> DataFrame:
    """Class per annotated row: mislabeled before actual before multilabel before debatable; untagged rows go."""
    value = (
        F.when(_has(comment, MISLABELED_TAGS), "Mislabeled").when(_has(comment, ACTUAL_TAGS), "Actual Error")
        .when(_has(comment, MULTI_TAGS), "Multilabel").when(_has(comment, DEBATABLE_TAGS), "Debatable Error")
    )
    return df.withColumn(name, value).filter(F.col(name).isNotNull())


def relaxed_class(df: DataFrame, comment: str = "comment", name: str = "error_type") -> DataFrame:
    """As :func:`taxonomy` with short names; rows without a known tag are debatable."""
    value = (
        F.when(_has(comment, MISLABELED_TAGS), "wrong").when(_has(comment, ACTUAL_TAGS), "error")
        .when(_has(comment, MULTI_TAGS), "multi").otherwise("debatable")
    )
    return df.withColumn(name, value)


def taxonomy_counts(classified: DataFrame, totals: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows per dataset and class, the errors nobody annotated, and all errors. ``totals(dataset, errors)``."""
    wide = classified.groupBy(dataset).agg(
        *[F.count_if(F.col("error") == c).alias(c.lower().replace(" ", "_")) for c in CLASSES]
    )
    names = [c.lower().replace(" ", "_") for c in CLASSES]
    annotated = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    joined = wide.join(totals, dataset, "left").withColumn("not_annotated", F.col("errors") - annotated)
    return joined.withColumn("total", annotated + F.col("not_annotated")).drop("errors")


def collect_sheets(sheets: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Comments of all sheets, without archive, old and agreement files and without blank page comments."""
    kept = sheets.filter(~F.col(file_name).rlike(SKIPPED_FILES))
    if "comment_page" in sheets.columns:
        kept = kept.filter(F.col("comment_page").isNull() | ~F.col("comment_page").isin("true:", ""))
        # Sheets with a page comment carry their comment in another column.
        kept = kept.withColumn("comment", F.when(F.col("comment_page").isNull(), F.col("comment")).otherwise(F.col("comment_query")))
    name = F.regexp_extract(file_name, r"([^/]*)_(?:fn|fp)[.]json$", 1)
    return kept.select("comment", name.alias("dataset"))


def shared_errors(first: DataFrame, second: DataFrame, on: Sequence[str], n_first: Column, n_second: Column, mode: str = "keys") -> DataFrame:
    """Error rate of two models and the share of errors they have in common.

    ``keys``: distinct examples. ``pairs``: rows of the inner over rows of the outer join on ``on``.
    """
    sizes = common_rows(first, second, on)
    share = F.col("inner_keys") / F.col("outer_keys") if mode == "keys" else F.col("inner_pairs") / F.col("outer_pairs")
    percent = lambda x: F.bround(100 * x, 2)
    return sizes.select(
        percent(F.col("rows_a") / n_first).alias("error_a"), percent(F.col("rows_b") / n_second).alias("error_b"),
        percent(share).alias("common"),
    )


def error_rates(long: DataFrame, key: Sequence[str], dataset: str, models: Sequence[str]) -> DataFrame:
    """Error percentage per model and shared-error percentage of all pairs with the first model, per dataset.

    ``long(dataset, key.., model, wrong)``: one row per example and model. One aggregation per example puts the
    models side by side; no join between error sets.
    """
    flag = lambda m: F.coalesce(F.bool_or(F.when(F.col("model") == m, F.col("wrong"))), F.lit(False)).alias(m)
    one = long.groupBy(dataset, *key).agg(*[flag(m) for m in models])
    first = F.col(models[0])
    out = [F.bround(100 * F.avg(F.col(m).cast("double")), 2).alias(f"{m}_error") for m in models]
    for m in models[1:]:
        both, some = F.count_if(first & F.col(m)), F.count_if(first | F.col(m))
        out.append(F.bround(F.when(some > 0, 100 * both / some), 2).alias(f"{models[0]}_{m}_common"))
    return one.groupBy(dataset).agg(*out)


def error_overlap(long: DataFrame, annotated: DataFrame, key: Sequence[str], dataset: str, base: str, others: Sequence[str]) -> DataFrame:
    """Per dataset and in total (null): errors of the base model, of the others, and those shared; and how many of the
    annotated errors the others make too. ``annotated(dataset, key..)``."""
    flag = lambda m: F.coalesce(F.bool_or(F.when(F.col("model") == m, F.col("wrong"))), F.lit(False)).alias(m)
    one = long.groupBy(dataset, *key).agg(*[flag(m) for m in (base, *others)])
    marks = annotated.select(dataset, *key).distinct().withColumn("__annotated", F.lit(True))
    joined = null_safe_join(one, marks, [dataset, *key], "left")
    is_annotated = F.coalesce(F.col("__annotated"), F.lit(False))
    out = [F.count_if(is_annotated).alias("annotated"), F.count_if(F.col(base)).alias(f"{base}_errors")]
    for m in others:
        out += [
            F.count_if(F.col(m)).alias(f"{m}_errors"), F.count_if(F.col(m) & F.col(base)).alias(f"{m}_common"),
            F.count_if(F.col(m) & is_annotated).alias(f"{m}_annotated"),
        ]
    return joined.rollup(dataset).agg(*out)


def prompt_comparison(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Errors only the first, only the second and both prompt variants make, by a full outer join on ``on``."""
    sizes = first.withColumn("s", F.lit(1)).select(*on, "s").unionByName(second.withColumn("s", F.lit(2)).select(*on, "s"))
    counts = sizes.groupBy(*on).agg(F.count_if(F.col("s") == 1).alias("a"), F.count_if(F.col("s") == 2).alias("b"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("a"))), F.lit(0)).alias("fixed_by_second"),
        F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("b"))), F.lit(0)).alias("broken_by_second"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("in_both"),
    )


def annotator_pairs(first: DataFrame, second: DataFrame, on: Sequence[str], value: str = "error_type") -> DataFrame:
    """Both annotators' classes side by side, left join on the sheet key."""
    a = first.select(*on, F.col(value).alias(f"{value}_1"))
    b = second.select(*on, F.col(value).alias(f"{value}_2"))
    return null_safe_join(a, b, list(on), "left")
