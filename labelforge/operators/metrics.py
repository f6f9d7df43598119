"""Classification reports, confusion matrices, bootstrap intervals and agreement.

Everything is computed from confusion cells (rows per pair of labels). The cells are one aggregation of the
predictions; all later steps work on a table of at most labels x labels rows per slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelforge.functions.hashing import DEFAULT_SEED, hash_int
from labelforge.operators.attach import MAX_SMALL_ROWS, attach_small, with_catalogue
from labelforge.operators.running import running_totals
from labelforge.operators.stats import most_frequent
from labelforge.session import cut_lineage

UNPARSED = "<unparsed>"
N_DRAWS = 1000  # fixed value: bootstrap draws
N_DRAWS_MULTILABEL = 100  # fixed value: draws for multilabel answers of language models
CONFIDENCE = 0.95  # fixed value
PIECE = 64  # neighbouring row numbers that meet the cells together, where these are too many for an array
DRAWN_TOGETHER = 1 << 20  # row numbers that one generated row of a draw stands for


def confusion_cells(
    df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Rows per (slice, gold, predicted); labels become text, a missing prediction is a class of its own."""
    return (
        df.select(
            *by, F.col(y_true).cast("string").alias("y_true"),
            F.coalesce(F.col(y_pred).cast("string"), F.lit(UNPARSED)).alias("y_pred"),
        )
        .groupBy(*by, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def report_from_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label of the union of gold and predicted labels; x/0 is 0."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
            F.struct(F.col("y_pred").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
        )
    ).alias("s")
    sums = cells.select(*by, sides).groupBy(*by, F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "predicted")]
    )
    return _ratios(sums)


def _ratios(sums: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return (
        sums.withColumn("precision", over(tp, predicted))
        .withColumn("recall", over(tp, support))
        .withColumn("f1", over(2 * tp, support + predicted))
    )


def classification_report(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-label report of every slice."""
    return report_from_cells(confusion_cells(df, by, y_true, y_pred), by)


def averages(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and weighted averages and accuracy of per-label reports."""
    support = F.sum("support")
    return report.groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / support).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / support).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / support).alias("weighted_f1"),
        (F.sum("tp") / support).alias("accuracy"), support.alias("support"), F.count(F.lit(1)).alias("n_labels"),
    )


def multilabel_report(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", classes: DataFrame | None = None
) -> DataFrame:
    """Per-label report over label lists, one row per label of the vocabulary.

    ``classes`` (one column of labels) is the vocabulary, that of the train split: its labels count with F1 0 where
    neither list has them, and other labels are ignored. Without it the vocabulary is all gold and predicted labels.
    """
    t, p = F.array_distinct(y_true), F.array_distinct(y_pred)
    one = df.select(t.alias("t"), p.alias("p"), F.explode(F.array_union(t, p)).alias("label"))
    in_t = F.array_contains("t", F.col("label")).cast("bigint")
    in_p = F.array_contains("p", F.col("label")).cast("bigint")
    sums = one.groupBy("label").agg(
        F.sum(in_t * in_p).alias("tp"), F.sum(in_t).alias("support"), F.sum(in_p).alias("predicted")
    )
    if classes is not None:
        names = classes.select(F.col(classes.columns[0]).alias("label")).dropna().distinct()
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        sums = names.join(sums, "label", "left").select("label", *[zero(c) for c in ("tp", "support", "predicted")])
    return _ratios(sums)


def vocabulary_row(df: DataFrame, lists: Sequence[str], classes: DataFrame | None) -> DataFrame:
    """One row: ``__known``, the distinct labels of ``classes`` or else of the ``lists`` of ``df``."""
    if classes is not None:
        names = classes.select(F.col(classes.columns[0]).alias("label"))
    else:
        names = df.select(F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])).alias("label"))
    return names.dropna().distinct().agg(F.array_sort(F.collect_list("label")).alias("__known"))


def samples_average(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", classes: DataFrame | None = None
) -> DataFrame:
    """Mean over rows of precision, recall and F1 of the row's two label lists; labels outside the vocabulary don't count."""
    known = vocabulary_row(df, [y_true, y_pred], classes)
    t = F.array_intersect(F.array_distinct(y_true), F.col("__known"))
    p = F.array_intersect(F.array_distinct(y_pred), F.col("__known"))
    rows = df.crossJoin(known).select(
        F.size(t).alias("t"), F.size(p).alias("p"), F.size(F.array_intersect(t, p)).alias("c")
    )
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c, n_t, n_p = F.col("c"), F.col("t"), F.col("p")
    return rows.agg(
        F.avg(over(c, n_p)).alias("samples_precision"), F.avg(over(c, n_t)).alias("samples_recall"),
        F.avg(over(2 * c, n_t + n_p)).alias("samples_f1"),
    )


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Dense matrix in long form over the union of labels: count, and share of the gold label's row."""
    cells = confusion_cells(df, (), y_true, y_pred)
    labels = cells.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    dense = with_catalogue(labels.withColumnRenamed("label", "y_true"), labels.withColumnRenamed("label", "y_pred"), "y_pred")
    full = dense.join(cells, ["y_true", "y_pred"], "left").fillna(0, ["n"])
    row = F.sum("n").over(W.partitionBy("y_true"))
    return full.withColumn("share", F.when(row > 0, F.bround(F.col("n") / row, 2)).otherwise(0.0))


def category_ranges(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels ordered by the part before the first comma: first and last index per such category."""
    category = F.element_at(F.split(label, ","), 1)
    indexed = labels.select(label, category.alias("category")).withColumn(
        "i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("category", label)) - 1
    )
    return indexed.groupBy("category").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def confusion_by_category(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Confusion cells of the parent categories."""
    parent = lambda c: F.element_at(F.split(F.coalesce(F.col(c), F.lit(UNPARSED)), ","), 1)
    return confusion_cells(df.select(parent(y_true).alias("y_true"), parent(y_pred).alias("y_pred")))


def slices(df: DataFrame, by: str, positive: str, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per slice: size, macro F1, precision and recall of the positive label; one pass for all slices."""
    report = classification_report(df, [by], y_true, y_pred)
    is_pos = F.col("label") == positive
    return report.groupBy(by).agg(
        F.sum("support").alias("size"), F.avg("f1").alias("macro_f1"),
        F.coalesce(F.max(F.when(is_pos, F.col("precision"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.max(F.when(is_pos, F.col("recall"))), F.lit(0.0)).alias("recall"),
    )


def replace_unknown(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Predictions that are no gold label become the most frequent gold label."""
    gold = df.select(F.col(y_true).alias("__gold")).filter(F.col("__gold").isNotNull()).distinct()
    known = gold.select(F.col("__gold").alias(y_pred), F.lit(True).alias("__known"))
    mode = most_frequent(df, y_true)
    joined = attach_small(df, known, [y_pred]).crossJoin(F.broadcast(mode))
    value = F.when(F.coalesce(F.col("__known"), F.lit(False)), F.col(y_pred)).otherwise(F.col("mode"))
    return joined.withColumn(y_pred, value).drop("__known", "mode")


def bootstrap_f1(
    df: DataFrame, draws: int = N_DRAWS, confidence: float = CONFIDENCE, y_true: str = "y_true", y_pred: str = "y_pred",
    seed: int | str = DEFAULT_SEED, method: str = "resample",
) -> DataFrame:
    """Percentile interval of macro F1 under resampling with replacement.

    F1 depends on a draw only through its confusion cells. ``resample``, at every size, lets every draw hash n row
    numbers, and the cell of a row number follows from the running totals of the cells (see :func:`drawn_counts`). That
    costs n x draws hashes, spread over all cores. A caller may ask for ``multinomial``: the cell counts of a draw at
    once, the same in law, for draws x cells. Draws with one gold label are left out.
    """
    cells = confusion_cells(df, (), y_true, y_pred)
    if method == "resample":
        drawn = drawn_counts(cells, ["y_true", "y_pred"], draws, seed)
    else:
        drawn = _multinomial_cells(cells, cells.agg(F.sum("n")).first()[0] or 0, draws, seed)
    return _interval(averages_per_draw(drawn), "macro_f1", confidence)


def averages_per_draw(cells: DataFrame) -> DataFrame:
    """(draw, macro_f1), draws with a single gold label left out."""
    report = report_from_cells(cells, ["draw"])
    return report.groupBy("draw").agg(
        F.avg("f1").alias("macro_f1"), F.count_if(F.col("support") > 0).alias("gold_labels")
    ).filter("gold_labels > 1")


def _interval(scores: DataFrame, score: str, confidence: float) -> DataFrame:
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    return scores.agg(
        F.percentile(score, F.lit(low)).alias("lower"), F.percentile(score, F.lit(high)).alias("upper"),
        F.count(F.lit(1)).alias("draws"),
    )


def draw_table(df: DataFrame, draws: int) -> DataFrame:
    """0..draws-1, spread over the cores of the session."""
    spark = df.sparkSession
    return spark.range(draws, numPartitions=min(draws, spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "draw")


def drawn_rows(df: DataFrame, draws: int, total: int, seed: int | str) -> DataFrame:
    """(draw, row): ``total`` row numbers of every draw, by hash. A draw of many rows is made in parts, by many tasks."""
    spark = df.sparkSession
    parts = max(1, -(-total // DRAWN_TOGETHER))
    tasks = max(draws * total // DRAWN_TOGETHER, spark.sparkContext.defaultParallelism)
    table = spark.range(draws * parts, numPartitions=min(draws * parts, tasks))
    first = (F.col("id") % parts) * DRAWN_TOGETHER
    last = F.least(first + DRAWN_TOGETHER, F.lit(total)) - 1
    table = table.select(F.floor(F.col("id") / parts).alias("draw"), F.explode(F.sequence(first, last)).alias("i")) if total else table.select(F.col("id").alias("draw"), F.col("id").alias("i")).limit(0)
    return table.select("draw", F.pmod(hash_int("draw", "i", seed=seed), F.lit(total)).alias("row"))


def steps_below(value: Column, ends: Sequence[float]) -> Column:
    """How many of the few ascending ``ends`` are at most ``value``."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in ends), F.lit(0))


def guide_table(ends: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """For ``buckets`` equal pieces of 0..ends[-1]-1 the place (entries at most the row) of a piece's first row, and the most
    places that lie between two rows of one piece."""
    total = int(ends[-1])
    begins = np.array([-(-b * total // buckets) for b in range(buckets + 1)], dtype=np.int64)
    first = np.searchsorted(ends, begins[:-1], side="right")
    last = np.searchsorted(ends, np.maximum(begins[1:] - 1, begins[:-1]), side="right")
    return first, int(np.max(last - first, initial=0))


def drawn_counts(cells: DataFrame, order: Sequence[str], draws: int, seed: int | str, most: int = MAX_SMALL_ROWS) -> DataFrame:
    """(draw, ``order``, n): how often each draw of as many rows as ``cells`` (``order``, n) stand for picks a cell.

    The rows of a cell are neighbours in the order of the cells, so that a drawn row number names its cell by the running
    totals. Up to ``most`` cells these are an array, and a guide table beside it says where a piece of the numbers begins:
    one access in generated code, and a step more for each doubling of the cells inside one piece. Above it,
    totals and numbers meet in a join on pieces of ``PIECE`` numbers, which at most as many cells share.
    """
    known = cells.select(*order, "n").orderBy(*order).limit(most + 1).toArrow()
    if known.num_rows > most:
        return _joined_counts(cells, order, draws, seed)
    spark, names = cells.sparkSession, known.select(list(order))
    ends = np.cumsum(known.column("n").to_numpy()) if known.num_rows else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    drawn = drawn_rows(cells, draws, total, seed)
    if not total:
        return drawn.select("draw", *[F.lit(None).cast(dict(cells.dtypes)[c]).alias(c) for c in order], F.lit(0).cast("bigint").alias("n"))
    buckets = min(total, 1 << max(4, (8 * len(ends) - 1).bit_length()))
    first, most_steps = guide_table(ends, buckets)
    padded = np.concatenate([ends, np.full(1 << most_steps.bit_length(), total)])
    tables = spark.createDataFrame([(padded.tolist(), first.tolist())], "__ends array<bigint>, __guide array<int>")
    found = drawn.crossJoin(F.broadcast(tables))  # one row
    entry = lambda table, at: F.coalesce(F.get(table, at), F.lit(0))  # never null, so that the join below checks nothing
    found = found.withColumn("__place", entry("__guide", F.expr(f"cast(row * {buckets} div {total} as int)")))
    for k in range(most_steps.bit_length() - 1, -1, -1):
        step = 1 << k
        up = entry("__ends", F.col("__place") + (step - 1)) <= F.col("row")
        found = found.withColumn("__place", F.col("__place") + F.when(up, step).otherwise(0))
    counts = found.groupBy("draw", "__place").agg(F.count(F.lit(1)).alias("n"))
    places = names.append_column("__place", pa.array(range(known.num_rows), pa.int32()))
    return counts.join(F.broadcast(spark.createDataFrame(places)), "__place").select("draw", *order, "n")


def _joined_counts(cells: DataFrame, order: Sequence[str], draws: int, seed: int | str) -> DataFrame:
    upto = cut_lineage(running_totals(cells.select(*order, "n"), list(order), end="n"))
    total = upto.agg(F.max("end")).first()[0] or 0
    begin = F.col("end") - F.col("n")
    pieces = F.explode(F.sequence(F.floor(begin / PIECE), F.floor((F.col("end") - 1) / PIECE))).alias("__piece")
    line = upto.filter("n > 0").select(*order, begin.alias("__begin"), "end", pieces)
    drawn = drawn_rows(cells, draws, total, seed).withColumn("__piece", F.floor(F.col("row") / PIECE))
    # counted before the join: a number is drawn by many draws
    numbers = drawn.groupBy("draw", "__piece", "row").agg(F.count(F.lit(1)).alias("__times"))
    inside = (F.col("row") >= F.col("__begin")) & (F.col("row") < F.col("end"))
    found = numbers.join(line, "__piece").filter(inside)
    return found.groupBy("draw", *order).agg(F.sum("__times").alias("n"))


def _multinomial_cells(cells: DataFrame, total: int, draws: int, seed: int | str) -> DataFrame:
    rows = cells.orderBy("y_true", "y_pred").collect()
    shares = np.array([r["n"] for r in rows], dtype=float) / max(total, 1)
    y_true, y_pred = [r["y_true"] for r in rows], [r["y_pred"] for r in rows]
    root = int.from_bytes(str(seed).encode(), "little") % (2**63)

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for draw in batch["draw"]:
                n = np.random.default_rng([root, int(draw)]).multinomial(total, shares)
                yield pd.DataFrame({"draw": draw, "y_true": y_true, "y_pred": y_pred, "n": n})[n > 0]

    return draw_table(cells, draws).mapInPandas(resample, "draw bigint, y_true string, y_pred string, n bigint")


def poisson_steps(n: int = 12) -> list[float]:
    """P(X <= k) of a Poisson(1) variable for k = 0..n-1: the variable is the number of steps at or below a uniform."""
    steps, term, total = [], float(np.exp(-1.0)), 0.0
    for k in range(n):
        total += term
        steps.append(total)
        term /= k + 1
    return steps


def bootstrap_multilabel_f1(
    df: DataFrame, key: str, draws: int = N_DRAWS_MULTILABEL, confidence: float = CONFIDENCE, y_true: str = "y_true",
    y_pred: str = "y_pred", seed: int | str = DEFAULT_SEED, classes: DataFrame | None = None,
) -> DataFrame:
    """Interval of the multilabel macro F1: the mean over the whole vocabulary (see ``multilabel_report``), in every draw.

    Draws whose gold lists are all alike are left out.

    A row takes part in a draw as often as a Poisson(1) variable says, which is resampling with replacement as n
    grows; so a draw needs no row numbers. Weights come from the hash of (draw, key).
    """
    known = vocabulary_row(df, [y_true, y_pred], classes)
    df = df.crossJoin(known)
    t, p = (F.array_sort(F.array_intersect(F.array_distinct(c), F.col("__known"))) for c in (y_true, y_pred))
    u = hash_int("draw", key, seed=seed) / F.lit(float(2**32))
    steps = poisson_steps()
    # Rows with the same two lists are alike; only their number matters per draw.
    # The lists are made before the rows are repeated: in one projection they would be made again for every draw.
    rows = df.select(key, t.alias("t"), p.alias("p"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    # A row is left out by the first step alone, as a filter makes the hash again for each comparison. Kinds are asked for their
    # weight, too, so that both that read them need the same sums, which are made once.
    kinds = rows.filter(u >= steps[0]).groupBy("draw", "t", "p").agg(F.sum(steps_below(u, steps)).alias("w")).filter("w > 0")
    one = kinds.select("draw", "w", "t", "p", F.explode(F.array_union("t", "p")).alias("label"))
    in_t = F.array_contains("t", F.col("label")).cast("bigint") * F.col("w")
    in_p = F.array_contains("p", F.col("label")).cast("bigint") * F.col("w")
    both = F.when(F.array_contains("t", F.col("label")), in_p).otherwise(0)
    sums = one.groupBy("draw", "label").agg(
        F.sum(both).alias("tp"), F.sum(in_t).alias("support"), F.sum(in_p).alias("predicted")
    )
    # rows without any label still say that gold lists differ; labels that a draw lacks count 0
    alike = kinds.groupBy("draw").agg((F.min("t") == F.max("t")).alias("alike"))
    f1 = _ratios(sums).groupBy("draw").agg(F.sum("f1").alias("f1"))
    scores = alike.filter("not alike").join(f1, "draw", "left").crossJoin(known)
    scores = scores.select("draw", (F.coalesce("f1", F.lit(0.0)) / F.size("__known")).alias("macro_f1"))
    return _interval(scores, "macro_f1", confidence)


def cohen_kappa(
    df: DataFrame, first: str, second: str, labels: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Observed and chance agreement and kappa; rows with a label outside ``labels`` on either side do not count."""
    cells = confusion_cells(df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()), by, first, second)
    if labels is not None:
        cells = cells.filter(F.col("y_true").isin(*labels) & F.col("y_pred").isin(*labels))
    report = report_from_cells(cells, by)
    out = report.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("observed"),
        (F.sum(F.col("support").cast("double") * F.col("predicted")) / (F.sum("support") * F.sum("support"))).alias("chance"),
    )
    kappa = F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance")))
    return out.withColumn("kappa", kappa)


def annotator_f1(
    df: DataFrame, votes: Sequence[str], gold: str = "y_true", key: Sequence[str] = ()
) -> DataFrame:
    """Macro F1 of every annotator column against gold, on the rows the annotator voted on."""
    long = df.unpivot([*key, gold], list(votes), "annotator", "vote").filter(F.col("vote").isNotNull())
    report = classification_report(long, ["annotator"], gold, "vote")
    return report.groupBy("annotator").agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))


def result_row(
    df: DataFrame, dataset: str, model: str, n_labels: int | None = None, seed: int = DEFAULT_SEED,
    draws: int = N_DRAWS, n_epoch: int | None = None,
) -> DataFrame:
    """One row of the result log from a prediction table: report, averages and interval."""
    means = averages(classification_report(df))
    interval = bootstrap_f1(df, draws=draws, seed=seed)
    return means.crossJoin(interval).select(
        F.lit(dataset).alias("dataset_name"), F.lit(model).alias("model_type"), F.col("macro_f1").alias("performance"),
        F.lit("f1_score").alias("performance_type"), F.lit(n_labels).cast("int").alias("n_labels"),
        F.lit(seed).alias("seed"), F.col("upper").alias("f1_upper"), F.col("lower").alias("f1_lower"),
        F.lit(n_epoch).cast("int").alias("n_epoch"), F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"), "weighted_f1", "accuracy",
    )
