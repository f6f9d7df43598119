"""Splits and samples against brute force, with one class far larger than the others."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from labelforge.operators import attach, cuts, splits


def h(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    data = [(i, "hot" if i % 10 < 7 else f"c{i % 3}") for i in range(3000)] + [(9001, None), (9002, None)]
    return spark.createDataFrame(data, "id bigint, label string").repartition(5).cache()


def brute_rank(df):
    groups = {}
    for i, label in rows(df.select("id", "label"), "id"):
        groups.setdefault(label, []).append(i)
    return {label: sorted(ids, key=lambda k: (h(k), k)) for label, ids in groups.items()}


@pytest.mark.parametrize("prefix", [1, 2, 4])
def test_thresholds_are_exact(skewed, prefix):
    want = {(label, ids[k - 1]) for label, ids in brute_rank(skewed).items() for k in [max(1, len(ids) // 3)]}
    got = cuts.rank_thresholds(skewed, ["label"], "id", {"k": lambda n: F.greatest(F.lit(1), F.floor(n / 3))}, prefix=prefix)
    assert {(r.label, r.k["k"]) for r in got.collect()} == want


def test_stratified_split_matches_brute_force(skewed):
    want = {}
    for ids in brute_rank(skewed).values():
        a = int(len(ids) * 0.8)
        c = int((len(ids) - a) * 0.5)
        for place, i in enumerate(ids):
            want[i] = "train" if place < a else "test" if place < len(ids) - c else "dev"
    assert dict(rows(splits.stratified_split(skewed, "id").select("id", "split"))) == want


@pytest.mark.parametrize("n, want", [(4, (3, 1, 0)), (5, (4, 1, 0)), (10, (8, 1, 1)), (11, (8, 2, 1)), (15, (12, 2, 1))])
def test_time_split_sizes(spark, n, want):
    df = spark.createDataFrame([(i, f"2020-01-{i + 1:02d}", "x") for i in range(n)], "id int, Date string, label string")
    out = splits.time_split(df.withColumn("Date", F.to_timestamp("Date")), "id")
    got = {r["split"]: sorted(x.id for x in out.collect() if x["split"] == r["split"]) for r in out.collect()}
    assert tuple(len(got.get(s, [])) for s in ("train", "test", "dev")) == want
    order = got.get("train", []) + got.get("test", []) + got.get("dev", [])
    assert order == sorted(order)


@pytest.mark.parametrize("counts, want", [((2, 5, 20), (2, 5, 5)), ((2, 3, 20), (2, 3, 7))])
def test_water_filling(spark, counts, want):
    table = spark.createDataFrame(list(zip("abc", counts)), "label string, n bigint")
    assert [r.k for r in splits.water_filling_quotas(table, "label", 12).orderBy("label").collect()] == list(want)


def test_samples_sum_up(skewed):
    assert splits.resize(skewed, "id", 500).count() == 500
    assert splits.resize(skewed, "id", 50_000).count() == skewed.count()
    assert splits.water_filling_sample(skewed, "id", 100).count() <= 100
    sizes = dict(rows(splits.undersample(skewed, "id").groupBy("label").count()))
    assert set(sizes.values()) == {2}
    down = dict(rows(splits.downsample_class(skewed, "id", "hot", 10).groupBy("label").count()))
    assert down["hot"] == 10 and down[None] == 2


def test_grouped_split_keeps_groups_together(spark):
    df = spark.createDataFrame([(i, i % 50) for i in range(1000)], "id int, claim int")
    out = splits.grouped_split(df, "claim")
    assert out.groupBy("claim").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert dict(rows(out.select("claim", "split").distinct().groupBy("split").count())) == {"train": 40, "test": 5, "dev": 5}


def test_carve_dev_leaves_test_alone(skewed):
    df = skewed.withColumn("split", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    out = splits.carve_dev(df, "id")
    assert rows(out.filter("split = 'test'").select("id")) == rows(df.filter("split = 'test'").select("id"))
    assert out.count() == df.count()


def test_truncate_policies(skewed):
    df = splits.stratified_split(skewed.filter("label is not null"), "id")
    for policy in ("balanced", "random", "weighted"):
        out = splits.truncate(df, "id", 200, policy)
        sizes = dict(rows(out.groupBy("split").count()))
        assert sizes["train"] <= 200 and sizes["dev"] <= 200 and sizes["test"] == df.filter("split = 'test'").count()


def test_negative_answers_are_never_true(spark):
    data = [(i, "hot" if i % 3 == 0 else f"q{i}", f"a{i % 40}") for i in range(600)]
    df = spark.createDataFrame(data, "id int, question string, answer string")
    known = {(q, a) for _, q, a in data}
    for r in splits.negative_answers(df, "id", buckets=8).collect():
        assert (r.question, r.false_answer) not in known
        assert (r.false_answer is None) == (r.question == "hot")  # that question owns all 40 answers
    assert splits.negative_answers(df, "id", buckets=8).count() == 600


def test_attach_beyond_the_bound_is_the_same(skewed, spark):
    small = spark.createDataFrame([("hot", 1), ("c0", 2), (None, 3)], "label string, v int")
    near = attach.attach_small(skewed, small, ["label"])
    far = attach.attach_small(skewed, small, ["label"], max_rows=1, salts=4)
    assert rows(near) == rows(far) and near.filter("v = 3").count() == 2
    assert rows(attach.attach_small(skewed, small, ["label"], "inner", max_rows=1, salts=4)) == rows(near.filter("v is not null"))


def test_quotas_over_three_hundred_thousand_classes(spark):
    """Against the loops that the quotas stand for."""
    sizes = spark.range(300_000).select(F.col("id").alias("label"), (1 + F.col("id") * 7919 % 13).alias("n"))
    listed = sorted((r.n, r.label) for r in sizes.collect())
    left, want = 1_000_003, {}
    for i, (n, label) in enumerate(listed):
        want[label] = min(left // (len(listed) - i), n)
        left -= want[label]
    assert {r.label: r.k for r in splits.water_filling_quotas(sizes, "label", 1_000_003).collect()} == want
    total = sum(n for n, _ in listed)
    exact = {label: n * 1_000_003 / total for n, label in listed}
    rest = sorted(exact, key=lambda x: (-round(exact[x] - int(exact[x]), 9), x))
    short = 1_000_003 - sum(map(int, exact.values()))
    up = set(rest[:short])
    got = {r.label: r.k for r in splits.proportional_quotas(sizes, "label", 1_000_003).collect()}
    assert got == {label: min(n, int(exact[label]) + (label in up)) for n, label in listed}


def test_sample_of_very_many_classes_is_not_refused(spark):
    df = spark.range(450_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("label"))
    assert splits.undersample(df, "id").count() == 300_001
    assert splits.water_filling_sample(df, "id", 300_100).count() == 300_100
