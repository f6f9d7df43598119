"""How the tables of the catalogue's tasks are made: each recipe is a composition of operators.

A recipe takes raw tables and returns one table with ``text``, ``label``, maybe ``query``, and ``split``. Raw tables
need a unique ``id`` column where rows are drawn by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelforge.functions.text import clean_text, normalise_hard, remove_phrase
from labelforge.operators.attach import attach_small, null_safe_join, small_table
from labelforge.operators import baselines, cleaning, dedup, nested, splits, voting
from labelforge.operators.language import detect
from labelforge.operators.stats import value_counts
from labelforge.plans import catalog
from labelforge.session import cut_lineage
from labelforge.sources.writers import write_splits

Scored = Callable[[DataFrame], DataFrame]


def random_split(raw: DataFrame) -> DataFrame:
    """One table, split 80/10/10 by label."""
    return splits.stratified_split(raw, "id")


def coded_classes(train: DataFrame, test: DataFrame, names: list[str]) -> DataFrame:
    """Given train and test with integer classes: name them and carve dev out of train."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return splits.carve_dev(cleaning.class_names(both, "label", names), "id")


def given_splits(train: DataFrame, test: DataFrame, dev: DataFrame) -> DataFrame:
    """Splits as published."""
    return nested.union_all([df.withColumn("split", F.lit(s)) for s, df in (("train", train), ("test", test), ("dev", dev))])


def united_train(trains: Sequence[DataFrame], test: DataFrame, dev: DataFrame) -> DataFrame:
    """Train from several files, another file as test."""
    return given_splits(nested.union_all(list(trains)), test, dev)


def drop_empty_test(train: DataFrame, test: DataFrame, dev: DataFrame) -> DataFrame:
    """As published, without test rows that miss their text."""
    return given_splits(train, cleaning.drop_null(test, "text"), dev)


def claims(raw: DataFrame) -> DataFrame:
    """One row per claim."""
    return splits.stratified_split(raw.select(F.col("claim_id").alias("id"), F.col("claim").alias("text"), F.col("claim_label").alias("label")), "id")


def claim_evidences(raw: DataFrame, level: str = "claim") -> DataFrame:
    """One row per evidence; split by claim, so that no claim is in two splits, or by evidence."""
    rows = nested.claim_evidence_rows(raw)
    rows = rows.withColumn("id", F.concat_ws("|", "claim_id", "evidence_id"))
    return splits.grouped_split(rows, "claim_id" if level == "claim" else "id")


def by_time(raw: DataFrame) -> DataFrame:
    """Oldest rows of every label to train."""
    return splits.time_split(raw.withColumn("Date", F.to_date("Date")), "id")


def policy_pages(documents: DataFrame) -> DataFrame:
    """Pages with 1 where they hold evidence."""
    return nested.labelled_pages(documents)


def policy_page_queries(documents: DataFrame) -> DataFrame:
    """Pages with evidence and the list of their queries."""
    pages = nested.rebuild_pages_by_block(nested.sentences(documents))
    return nested.attach_pages(nested.page_queries(documents), pages).select("text", "label")


def policy_page_relations(documents: DataFrame) -> DataFrame:
    """Pages with evidence against every known query."""
    queries = documents.select(F.explode("evidences.query").alias("query"))
    return nested.expand_to_queries(policy_page_queries(documents), queries).select("text", "query", "label")


def policy_page_stances(documents: DataFrame) -> DataFrame:
    """(text, query, stance as label)."""
    pages = nested.rebuild_pages_by_block(nested.sentences(documents))
    return nested.attach_pages(nested.evidence_rows(documents), pages).select("text", "query", F.col("stance").alias("label"))


def policy_sentences(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences with evidence membership, pages joined by sentence id with their queries and stances)."""
    rows = nested.sentence_membership(documents)
    pages = nested.rebuild_pages_by_sentence(nested.sentences(documents))
    marks = nested.evidence_rows(documents).select("document_id", "page_idx", "query", "stance")
    return rows, pages.join(marks, ["document_id", "page_idx"], "left")


def annotators(raw: DataFrame, votes: Sequence[str]) -> DataFrame:
    """Majority label of the annotators, then 80/10/10."""
    return random_split(voting.consensus(raw, votes).drop(*votes))


def held_out_annotators(raw: DataFrame, votes: Sequence[str], flag: str) -> DataFrame:
    """Majority label; test = the flagged rows."""
    return splits.held_out_split(voting.consensus(raw, votes).drop(*votes), flag, "id")


def one_task_per_column(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A binary task per column, each split by its own labels: all in one table with a ``task`` column."""
    long = nested.melt(raw, ["id", "text"], columns).withColumn("strata", F.concat_ws("|", "task", "label"))
    return splits.stratified_split(long, "id", "strata").drop("strata")


def two_annotators(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Rows both annotators labelled alike, then 80/10/10."""
    return random_split(voting.agreed_rows(first, second, on).withColumn("id", F.col(on)))


def listed_labels(rows: DataFrame, text: str, label: str) -> DataFrame:
    """One row per label to one row per text with its label list."""
    kept = cleaning.drop_null(rows, text)
    return nested.collect_labels(kept, ["split", text], label, repeats=False).withColumnRenamed(text, "text")


def conflict_free_pairs(raw: DataFrame) -> DataFrame:
    """(query, text, label) per split without the negatives that contradict a copy."""
    return dedup.drop_conflicting_negatives(raw, ["split", "query", "text"], "label", "id")


def question_answers(raw: DataFrame, completed: DataFrame, question: str, answer: str) -> DataFrame:
    """Answers that the completed set knows, de-duplicated and split, each with a drawn false answer of its split."""
    known = completed.select(F.col("answer").alias(answer)).distinct()
    unique = dedup.keep_first(raw.join(known, answer, "left_semi"), [question, answer], "id")
    parts = cut_lineage(splits.grouped_split(unique, "id"))
    out = []
    for name in ("train", "test", "dev"):
        drawn = splits.negative_answers(parts.filter(F.col("split") == name), "id", question, answer)
        pairs = splits.stack_answers(drawn, question, answer, "false_answer")
        out.append(pairs.withColumn("split", F.lit(name)))
    return nested.union_all(out)


def rebuilt_single_label(all_splits: DataFrame, label: str = "label", min_tokens: int = 5) -> DataFrame:
    """Union of the splits, distinct, long enough, one row per (text, label), no text with two labels, split anew."""
    measured = all_splits if "token_counts" in all_splits.columns else cleaning.measure(all_splits)
    kept = measured.filter(F.col("token_counts") >= min_tokens)
    one = dedup.keep_first(kept, ["clean_text", label], "id")
    return splits.grouped_split(dedup.drop_all_copies(one, ["clean_text"], "id").drop("split"), "id")


def company_answers(raw: DataFrame, text: str = "text", company: str = "Company Name") -> DataFrame:
    """Raw answers cleaned, without texts that occur twice, plus the text without the company's name."""
    cleaned = cleaning.computed_once(raw, "__clean", clean_text(text)).drop(text).withColumnRenamed("__clean", text)
    once = dedup.drop_all_copies(cleaned, [text], "id")
    return once.withColumn("cleaned_text", normalise_hard(remove_phrase(text, company)))


# Which recipe makes which task (fixed assignment).
RECIPES: dict[str, Callable] = {
    **dict.fromkeys(["netzero_reduction", "esgbert_e", "esgbert_s", "esgbert_g", "esgbert_action500", "green_claims", "green_claims_3"], random_split),
    **dict.fromkeys(
        ["climate_specificity", "climate_sentiment", "climate_commitments_actions", "climate_detection", "climate_tcfd_recommendations", "climateBUG_data"],
        coded_classes,
    ),
    **dict.fromkeys(["climatext", "climatext_wiki", "environmental_claims", "ClimaTOPIC", "climateEng", "climateStance", "ClimaINS"], given_splits),
    **dict.fromkeys(["climatext_10k", "climatext_claim"], united_train),
    **dict.fromkeys(
        ["esgbert_category_water", "esgbert_category_forest", "esgbert_category_biodiversity", "esgbert_category_nature"], one_task_per_column
    ),
    "climateFEVER_claim": claims,
    "climateFEVER_evidence": claim_evidences,
    "climateFEVER_evidence_climabench": lambda raw: claim_evidences(raw, "evidence"),
    "sciDCC": by_time,
    "contrarian_claims": drop_empty_test,
    "lobbymap_pages": policy_pages,
    "lobbymap_query": policy_page_queries,
    "lobbymap_stance": policy_page_stances,
    "sustainable_signals_review": annotators,
    "gw_stance_detection": held_out_annotators,
    "logicClimate": listed_labels,
    "ClimaINS_ours": rebuilt_single_label,
    "climaQA": question_answers,
    "climaQA_published": conflict_free_pairs,
    "climateEng_Reddit": two_annotators,
    "climateStance_Reddit": two_annotators,
}


def prepare(
    df: DataFrame, spec: catalog.TaskSpec, key: str, max_size: int = splits.TRAIN_CAP, min_tokens: int | None = None
) -> DataFrame:
    """Clean, length filter, de-duplicate per split, balance and cap: the path of every task before training."""
    low = min_tokens or (cleaning.MIN_TOKENS if not spec.name.startswith("lobbymap") else 40)
    # the texts are cleaned once; all that follows reads what is written here, and sizes are counted on the way
    kept = cut_lineage(cleaning.length_filter(cleaning.measure(df), low))
    seen = Observation()
    unique = dedup.keep_first(kept, ["split", *spec.inputs, spec.label], key)
    if spec.name == "climateFEVER_evidence":
        train = splits.downsample_class(unique.filter("split = 'train'"), key, *splits.EVIDENCE_DOWNSAMPLE)
        unique = train.unionByName(unique.filter("split <> 'train'"))
    if spec.kind == "multilabel":
        return unique
    counted = unique.observe(seen, *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev")])
    unique = cut_lineage(counted)
    return splits.truncate(unique, key, max_size, spec.balance, spec.stratify_on or spec.label, sizes=seen.get)


def annotate_and_write(df: DataFrame, dataset: str, key: str, profiles: DataFrame, path: str) -> DataFrame:
    """Clean, count, label language and gibberish, write; returns the counts of both labels."""
    annotated = detect(cleaning.measure(df), profiles, key, "clean_text")
    write_splits(annotated, path, dataset)
    written = df.sparkSession.read.parquet(path).filter(F.col("dataset") == dataset)
    return value_counts(written, "language").withColumnRenamed("language", "value").unionByName(
        value_counts(written, "gibberish").withColumnRenamed("gibberish", "value")
    )


def _of(predictions: DataFrame, tasks: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    voting.check_tasks(tasks, allowed)
    return predictions.filter(F.col("task").isin(*tasks))


def _yes_no(predictions: DataFrame, key: str, tasks: Sequence[str], allowed: Sequence[str], mode: str, name: str) -> DataFrame:
    rows = _of(predictions, tasks, allowed)
    return voting.vote(voting.positive_flags(rows, catalog.positives(predictions.sparkSession, tasks)), key, mode, name=name)


def climate_related(predictions: DataFrame, key: str, tasks: Sequence[str] = catalog.CLIMATE_TASKS, mode: str = "majority") -> DataFrame:
    """Is the text about climate? Vote of the climate classifiers."""
    return _yes_no(predictions, key, tasks, catalog.CLIMATE_TASKS, mode, "climate")


def green_claims(predictions: DataFrame, key: str, tasks: Sequence[str] = catalog.CLAIM_TASKS, mode: str = "majority") -> DataFrame:
    """Does the text make an environmental claim?"""
    return _yes_no(predictions, key, tasks, catalog.CLAIM_TASKS, mode, "environmental_claim")


def topics(predictions: DataFrame, key: str, tasks: Sequence[str] = catalog.TOPIC_TASKS) -> DataFrame:
    """One readable label column per topic task."""
    rows = _of(predictions, tasks, catalog.TOPIC_TASKS)
    return voting.label_columns(rows, key, tasks, catalog.readable_labels(predictions.sparkSession))


def characteristics(predictions: DataFrame, key: str, tasks: Sequence[str] = catalog.CHARACTERISTIC_TASKS[:5]) -> DataFrame:
    """One readable label column per characteristic task."""
    rows = _of(predictions, tasks, catalog.CHARACTERISTIC_TASKS)
    return voting.label_columns(rows, key, tasks, catalog.readable_labels(predictions.sparkSession))


def stance(predictions: DataFrame, key: str, tasks: Sequence[str] = catalog.STANCE_TASKS, mode: str = "majority") -> DataFrame:
    """Support, Denies or Neutral."""
    return voting.stance_vote(_of(predictions, tasks, catalog.STANCE_TASKS), key, catalog.stance_labels(predictions.sparkSession), mode)


def single_task(predictions: DataFrame, key: str, task: str) -> DataFrame:
    """The readable label of one task."""
    return voting.label_columns(_of(predictions, [task], [task]), key, [task], catalog.readable_labels(predictions.sparkSession))


def train_cascade(pages: DataFrame, key: str, **settings) -> dict:
    """Fits for the page, query and stance steps from (key, text, query, stance) page rows, null query = no evidence.

    Returns the page baseline, a function page rows -> query lists, and the stance baseline.
    """
    flagged = pages.groupBy(key, "text").agg(F.bool_or(F.col("query").isNotNull()).cast("string").alias("label"))
    found = pages.filter(F.col("query").isNotNull())
    listed = nested.collect_labels(found, [key, "text"], "query", repeats=False)
    return {
        "page": baselines.fit_baseline(flagged, **settings),
        "query": lambda test: baselines.predict_multilabel(listed, test, key, **settings),
        "stance": baselines.fit_baseline(found, "stance", query="query", query_kind="onehot", **settings),
    }


def run_cascade(models: dict, pages: DataFrame, key: str) -> DataFrame:
    """Page, queries and stances of unseen (key, text) pages: each step scores only what the one before let through."""
    flagged = models["page"].predict(pages, "said").select(key, "text", (F.col("said") == "true").alias("hit"))
    queried = models["query"](flagged.filter("hit").select(key, "text")).withColumnRenamed("y_pred", "queries")
    pairs = flagged.filter("hit").join(queried, key).select(key, "text", F.explode("queries").alias("query"))
    stances = models["stance"].predict(pairs, "stance").select(key, "query", "stance")
    return voting.cascade(flagged.join(queried, key, "left"), key, "hit", "queries", stances)


def report_columns(paragraphs: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Paragraphs with the columns of the report: climate vote, topics, claims, characteristics, stance.

    ``predictions(key, task, y_pred)`` holds every classifier's label for every paragraph, of all files at once.
    """
    spark = paragraphs.sparkSession
    flags = {"climate": catalog.CLIMATE_TASKS, "environmental_claim": ["environmental_claims"]}
    named = catalog.TOPIC_TASKS + catalog.CHARACTERISTIC_TASKS[1:5]
    used = sorted({*catalog.CLIMATE_TASKS, "environmental_claims", *named, *catalog.STANCE_TASKS})
    rows = voting.positive_flags(_of(predictions, used, used), catalog.positives(spark, [t for tasks in flags.values() for t in tasks]))
    rows = attach_small(rows, catalog.readable_labels(spark), ["task", "y_pred"])
    rows = attach_small(rows, catalog.stance_labels(spark), ["task", "y_pred"])
    rows = rows.withColumn("__label", F.when(F.col("task").isin(*named), F.coalesce("value", F.col("y_pred").cast("string")))).drop("value", "y_pred")
    codes = _label_codes(rows, "__label")
    if codes is not None:
        rows = null_safe_join(rows, F.broadcast(codes), ["__label"], "left").drop("__label").withColumnRenamed("__code", "__label")
    columns = [voting.majority_of(F.col("task").isin(*tasks)).alias(name) for name, tasks in flags.items()]
    columns += [F.min(F.when(F.col("task") == task, F.col("__label"))).alias(task) for task in named]
    columns.append(voting.stance_of(F.col("task").isin(*catalog.STANCE_TASKS)).alias("stance"))
    # one grouping of the predictions makes all columns
    made = rows.groupBy(key).agg(*columns)
    if codes is not None:
        for task in named:
            label = codes.select(F.col("__label").alias("__name"), F.col("__code").alias(task))
            made = made.join(F.broadcast(label), task, "left").drop(task).withColumnRenamed("__name", task)
        made = made.select(key, *flags, *named, "stance")
    return paragraphs.join(made, key, "left")


def _label_codes(rows: DataFrame, label: str) -> DataFrame | None:
    """(label, __code) of all labels, numbered in their order, or ``None`` when they are many.

    A group's least label is that of the least code; a grouping whose results are all numbers needn't sort its rows.
    """
    found = small_table(rows.select(label).filter(F.col(label).isNotNull()).distinct())
    if found is None:
        return None
    names = sorted((r[0] for r in found.collect()), key=lambda x: x.encode())  # bounded by small_table
    return rows.sparkSession.createDataFrame(pa.table({label: pa.array(names, pa.string()), "__code": pa.array(range(len(names)), pa.int32())}))


def report_pages(paragraphs: DataFrame, order: str) -> DataFrame:
    """Pages of all reports, for the policy cascade."""
    return nested.join_ordered(paragraphs, ["filename", "page_number"], [order], "text", "\n")
