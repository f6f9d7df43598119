"""Copies against brute force, and the physical plans the queries must have."""

import itertools

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelforge.plans import registry
from labelforge.operators import dedup, errors

FOLDER = "/root/testdata/sf0.001"


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_distance_pairs_are_complete(spark, k):
    words = ["", "a", "ab", "abc", "kitten", "sitting", "kitchen", "mitten", "bitten", "aaaa", "aaaaaa", "abab", "baba", "abcabc", "bcabca", "mittens", "smitten"]
    data = [(g * 100 + i, g, w) for g in (1, 2) for i, w in enumerate(words)] + [(999, 1, "kitten")]
    df = spark.createDataFrame(data, "id int, g int, t string")
    want = {(g * 100 + i, g * 100 + j, distance(a, b)) for g in (1, 2) for (i, a), (j, b) in itertools.combinations(enumerate(words), 2) if distance(a, b) <= k}
    got = dedup.edit_distance_pairs(df, "g", "id", "t", k)
    assert {(r.a, r.b, r.distance) for r in got.collect()} == want
    assert got.filter("a = 104").select("copies_a").distinct().collect()[0][0] == 2


def test_conflict_rules(spark):
    df = spark.createDataFrame([(1, "q", "t", 1), (2, "q", "t", 0), (3, "q", "u", 0), (4, "q", "v", 0), (5, "q", "v", 0)], "doc_id int, query string, text string, label int")
    assert [r.doc_id for r in dedup.drop_conflicting_negatives(df, ["query", "text"]).orderBy("doc_id").collect()] == [1, 3]
    assert [r.doc_id for r in dedup.drop_all_copies(df, ["query", "text"], "doc_id").collect()] == [3]


def test_hot_copies(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"), (F.col("id") % 2).alias("s"))
    assert dedup.keep_first(df, ["t"], "id").count() == 5000 - 1667 + 1
    split = df.withColumn("split", F.when(F.col("s") == 0, "train").otherwise("test"))
    r = dedup.leakage_matrix(split, "t").first()
    assert (r.texts, r.row_pairs) == (1, 834 * 833)


def test_common_rows_match_null_keys(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("x",), (None,), (None,), ("z",)], "k string")
    r = dedup.common_rows(a, b, ["k"]).first()
    assert (r.inner_pairs, r.outer_pairs, r.inner_keys, r.outer_keys) == (4, 6, 2, 4)


def test_taxonomy(spark):
    data = [("error: x",), (" wrong ,error",), ("multi, close",), ("close: y",), ("odd",)]
    df = spark.createDataFrame(data, "comment string")
    assert sorted(r.error for r in errors.taxonomy(df).collect()) == ["Actual Error", "Debatable Error", "Mislabeled", "Multilabel"]
    assert [r.error_type for r in errors.relaxed_class(df).collect()] == ["error", "wrong", "multi", "debatable", "debatable"]


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql_or_a_test():
    missing = (set(entry.queries()) - set(entry.oracle_sql())) & set(registry.QUERIES)
    assert missing == {"bootstrap_f1_multinomial", "text_baseline", "query_onehot_baseline", "pair_baseline", "multilabel_baseline"}


@pytest.mark.parametrize("name", ["stratified_split", "time_split", "water_filling_sample", "prepared_label_shares", "clean_and_count", "keep_first_copy",
    "classification_report", "overlap_scores", "detect_language", "negative_answers", "report_columns", "near_copy_paragraphs"])
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["stratified_split", "time_split", "hash_bucket_split"])
def test_splits_do_not_sort_groups(spark, name):
    """Rows meet their thresholds in a broadcast join: no window and no sort over the big table."""
    text = plan(spark, name)
    assert "Window" not in text and "SortMergeJoin" not in text


def test_scan_reads_two_columns(spark):
    text = plan(spark, "claim_verdict")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in text
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan(spark, "responses_in_set")


def test_near_copies_with_a_template_piece(spark):
    """A third of all texts share their first half, and most of these their length: pieces alone would pair them all."""
    import random

    rng = random.Random(4)
    letters = "abcdeinorst"
    texts = ["template of all notices " + "".join(rng.choices(letters, k=rng.choice([8, 9]))) for _ in range(90)]
    texts += ["".join(rng.choices(letters, k=rng.choice([20, 33]))) for _ in range(90)]
    for base in texts[::3]:
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice(letters) + base[at + rng.choice([0, 1, 2]) :])
    texts = sorted(set(texts))
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "id int, g int, t string")
    for k in (1, 2):
        want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if abs(len(a) - len(b)) <= k and distance(a, b) <= k}
        for hot in (8, 10_000):
            got = dedup.edit_distance_pairs(df, "g", "id", "t", k, hot=hot)
            assert {(r.a, r.b) for r in got.select("a", "b").collect()} == want
    assert len(want) > 20


def test_near_copies_need_few_probes(spark):
    """A text within k edits is found under few shifts: 12 keys of one piece and 27 of two, for two edits."""
    df = spark.createDataFrame([("g", 1, "abcdefghijklmnopqrst", 20, 0)], "g string, id int, t string, len int, letters long")
    assert dedup._piece_probes(df, 3, 1, 2).count() == 12
    assert dedup._piece_probes(df, 4, 2, 2).count() == 27


def test_near_copies_of_short_and_repetitive_texts(spark):
    """All texts of up to six of two letters, against brute force, with and without crowded pieces."""
    texts = ["".join(x) for n in range(7) for x in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "id int, g int, t string")
    near = {(i, j): distance(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if abs(len(a) - len(b)) <= 3}
    for k in (1, 2, 3):
        for hot in (4, 10_000):
            got = dedup.edit_distance_pairs(df, "g", "id", "t", k, hot=hot)
            assert {(r.a, r.b): r.distance for r in got.collect()} == {p: d for p, d in near.items() if d <= k}


def test_near_copies_normalise_once_and_sort_no_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dedup, "cut_lineage", lambda df, cut=dedup.cut_lineage: seen.append(df) or cut(df))
    entry.queries()["near_copy_paragraphs"](spark, FOLDER)
    text = seen[0]._jdf.queryExecution().executedPlan().toString()
    text = text.split("Initial Plan")[-1]
    assert text.count("lower(") == 1 and "SortAggregate" not in text


def test_hot_digests_are_spread(spark, monkeypatch):
    from labelforge.operators import attach

    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise((F.col("id") % 9000).cast("string")).alias("t"), F.lit(None).cast("string").alias("p"))
    got = dedup.entity_blind_copies(df, "t", "p", "id")
    assert got.filter("n_copies = 10000").count() == 10_000 and got.count() == 30_000
    keys = df.select(F.col("t").alias("k"), "id")
    assert attach.frequent_keys(keys, ["k"]) == [spark.sql("select xxhash64('same')").first()[0]]
    small = keys.select("k").distinct().withColumn("n", F.length("k"))
    joined = attach.spread_join(keys, small, ["k"], salts=16).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 0.45 * 30_000
    assert attach.spread_join(keys.limit(0), small, ["k"]).collect() == []


def test_catalogue_in_parts(spark):
    from labelforge.operators import attach, ranking

    df = spark.range(30).select(F.col("id").alias("doc"), F.lit("q7").alias("query"))
    values = spark.range(100).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("candidate"))
    near = rows(attach.with_catalogue(df, values, "candidate"))
    assert rows(attach.with_catalogue(df, values, "candidate", together=10, salts=3)) == near and len(near) == 3000
    scored = attach.with_catalogue(df, values, "candidate").withColumn("label", (F.xxhash64("doc", "candidate") % 2).cast("int") % 2 * -1).withColumn("score", (F.abs(F.xxhash64("candidate", "doc")) % 5) / 5)
    local = scored.collect()
    ranks = ranking.gold_ranks(spark.createDataFrame(local), "doc")
    assert "collect_list" not in ranks._jdf.queryExecution().executedPlan().toString()
    place = lambda r: (-r.label, -(1 - r.score if r.label == 0 else r.score), r.candidate)
    want = {d: sum(place(r) <= place(next(x for x in local if x.doc == d and x.candidate == "q7")) for r in local if r.doc == d) for d in range(30)}
    assert {r.doc: r["rank"] for r in ranks.collect()} == want


@pytest.mark.parametrize("many", [False, True])
def test_report_columns_group_numbers(spark, monkeypatch, many):
    """Labels beyond the catalogue, repeated rows of a task, texts without predictions; and no sort of all predictions."""
    from labelforge.plans import catalog, recipes

    if many:
        monkeypatch.setattr(recipes, "small_table", lambda df: None)
    named = catalog.TOPIC_TASKS + catalog.CHARACTERISTIC_TASKS[1:5]
    said = [(1, named[0], "zz"), (1, named[0], "\u00e9"), (1, named[0], None), (2, named[0], "\uffff"), (2, named[0], "\U0001f600"), (2, named[1], "own"), (3, "climate_detection", "yes")]
    predictions = spark.createDataFrame(said, "key long, task string, y_pred string")
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(1, 5)], "key long, text string")
    found = recipes.report_columns(texts, predictions, "key")
    assert found.columns == ["key", "text", "climate", "environmental_claim", *named, "stance"]
    got = {r.key: (r.text, r[named[0]], r[named[1]], r.climate) for r in found.collect()}
    assert got == {1: ("t1", "zz", None, None), 2: ("t2", "\uffff", "own", None), 3: ("t3", None, None, True), 4: ("t4", None, None, None)}
    if not many:
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
