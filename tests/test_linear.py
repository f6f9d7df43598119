"""The linear models against single fits, numeric gradients and the library's own regression."""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from labelforge.operators import baselines, features, linear


def sparse_rows(spark, n, width, classes, one, seed=1):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=(width, classes))
    data, dense, y = [], np.zeros((n, width)), []
    for r in range(n):
        at = np.sort(rng.choice(width, rng.integers(0, 5), replace=False))
        dense[r, at] = rng.random(len(at))
        m = dense[r] @ truth + rng.normal(size=classes) * 0.3
        y.append([int(np.argmax(m))] if one else np.flatnonzero(m > 0.2).tolist())
        data.append((at.tolist(), dense[r, at].tolist(), y[-1]))
    return spark.createDataFrame(data, "i array<int>, v array<double>, y array<int>").repartition(3).cache(), dense, y


def test_gradient_is_the_numeric_one(spark):
    for one in (True, False):
        rows, dense, _ = sparse_rows(spark, 60, 7, 3, one)
        rng = np.random.default_rng(3)
        targets = linear.Targets(3, one, np.array([1.0, 2.0, 0.5]), np.array([0.7, 1.0, 1.5]))
        w = rng.normal(size=(8, 3))
        loss, slope = linear._evaluate(rows, w, targets)
        for at in ((0, 0), (6, 2), (7, 1)):
            step = np.zeros_like(w)
            step[at] = 1e-5
            numeric = (linear._evaluate(rows, w + step, targets)[0] - linear._evaluate(rows, w - step, targets)[0]) / 2e-5
            assert abs(numeric - slope[at]) < 1e-4 * max(1, abs(numeric))


def test_all_labels_in_one_fit_equal_single_fits(spark):
    rows, dense, y = sparse_rows(spark, 200, 12, 4, False, seed=5)
    ones = np.array([sum(k in x for x in y) for k in range(4)], float)
    pos, neg = 200 / (2 * ones), 200 / (2 * (200 - ones))
    joint = linear.fit_linear(rows, 12, linear.Targets(4, False, pos, neg), 200, 1 / 200, 1000, 1e-6)
    for k in range(4):
        own = rows.withColumn("y", F.when(F.array_contains("y", k), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
        single = linear.fit_linear(own, 12, linear.Targets(1, False, pos[k : k + 1], neg[k : k + 1]), 200, 1 / 200, 1000, 1e-6)
        assert np.max(np.abs(joint[:, k] - single[:, 0])) < 2e-3


def test_classes_agree_with_the_library(spark):
    from pyspark.ml.linalg import Vectors

    rows, dense, y = sparse_rows(spark, 200, 6, 2, True, seed=6)
    w = linear.fit_linear(rows, 6, linear.Targets(2, True, np.ones(2), np.ones(2)), 200, 0.01, 1000, 1e-7)
    df = spark.createDataFrame([(Vectors.dense(d), float(c[0])) for d, c in zip(dense, y)], ["features", "label"])
    model = LogisticRegression(regParam=0.01, standardization=False, family="multinomial", maxIter=1000, tol=1e-12).fit(df)
    other = model.coefficientMatrix.toArray()
    assert np.max(np.abs((w[:-1, 1] - w[:-1, 0]) - (other[1] - other[0]))) < 1e-3
    assert abs((w[-1, 1] - w[-1, 0]) - (model.interceptVector[1] - model.interceptVector[0])) < 1e-3


def test_gradients_of_many_tasks_are_summed_in_two_steps(spark, monkeypatch):
    rows, _, _ = sparse_rows(spark, 100, 9, 2, True)
    targets = linear.Targets(2, True, np.ones(2), np.ones(2))
    w = np.random.default_rng(0).normal(size=(10, 2))
    loss, slope = linear._evaluate(rows, w, targets)
    monkeypatch.setattr(linear, "TOGETHER", 2)
    monkeypatch.setattr(linear, "SLICE", 6)
    again = linear._evaluate(rows, w, targets)
    assert abs(loss - again[0]) < 1e-9 and np.allclose(slope, again[1])


def test_multilabel_fit_and_dummies(spark):
    data = [(i, ["red apple", "blue sea", "red sea", ""][i % 4], [["a"], ["b"], ["a", "b"], None][i % 4]) for i in range(80)]
    df = spark.createDataFrame(data, "id long, text string, label array<string>")
    got = {r.id: r.y_pred for r in baselines.predict_multilabel(df, df, "id").collect()}
    assert [got[i] for i in range(3)] == [["a"], ["b"], ["a", "b"]]
    always = df.withColumn("label", F.array(F.lit("z")))
    assert {tuple(r.y_pred) for r in baselines.predict_multilabel(always, df, "id").collect()} == {("z",)}
    assert {tuple(r.y_pred) for r in baselines.majority_multilabel_dummy(df, df).collect()} == {()}
    more = df.withColumn("label", F.when(F.col("id") % 4 < 3, F.array(F.lit("m"), F.lit("m"))))
    assert {tuple(r.y_pred) for r in baselines.majority_multilabel_dummy(more, df).collect()} == {("m",)}
    drawn = [r.y_pred for r in baselines.uniform_multilabel_dummy(df, df, "id").collect()]
    assert len(drawn) == 80 and 20 < sum("a" in x for x in drawn) < 60
    assert {tuple(r.y_pred) for r in baselines.uniform_multilabel_dummy(always, df, "id").collect()} == {("z",)}


def test_dense_and_sparse_vectors_read_alike(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([0.0, 2.0, 1.0]),), (Vectors.sparse(3, [1], [2.0]),), (Vectors.sparse(3, [], []),)], ["x"])
    assert [(r[0], r[1]) for r in df.select(*linear.sparse_parts("x")).collect()] == [([0, 1, 2], [0.0, 2.0, 1.0]), ([1], [2.0]), ([], [])]


def test_hashed_features_are_the_weights_of_the_relation(spark):
    data = [(1, "a cat sat on the mat", "q"), (2, "the cat the", None), (3, "dogs and the cats, and Çats", "r"), (4, None, "q"), (5, "", "q")]
    df = spark.createDataFrame(data, "id int, text string, query string").repartition(2).cache()
    spaces = [features.fit_space(df, "text", 5), features.fit_space(df, "query", 5, whole=True)]
    got = {r.id: dict(zip(r.x.i, r.x.v)) for r in df.select("id", features.feature_column(spark, spaces).alias("x")).collect()}
    first, place = len(spaces[0].terms), {}
    for r in df.select("id", "query", F.xxhash64("query").alias("h")).collect():
        at = first + int(np.searchsorted(spaces[1].terms, r.h))
        assert got[r.id].pop(at) == 1.0
        assert place.setdefault(r.query, at) == at
    assert len(set(place.values())) == 3 and got[4] == got[5] == {}
    for r in baselines.tfidf_weights(df, "id").withColumn("h", F.xxhash64("term")).collect():
        assert abs(got[r.id].pop(int(np.searchsorted(spaces[0].terms, r.h))) - r.weight) < 1e-12
    assert not any(got.values())
    unseen = spark.createDataFrame([("zebra cat", "new")], "text string, query string")
    x = unseen.select(features.feature_column(spark, spaces).alias("x")).first().x
    assert len(x.i) == 1 and x.v == [1.0] and x.i[0] < first
    assert df.limit(0).select(features.feature_column(spark, spaces).alias("x")).collect() == []
    none = features.fit_space(df.limit(0), "text", 0)
    assert unseen.select(features.margin_column(spark, [none], np.array([[1.0, 2.0]])).alias("m")).first().m == [1.0, 2.0]


def test_margins_in_small_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 40)))) for i in range(50)]
    df = spark.createDataFrame(data, "id int, text string").coalesce(1)
    spaces = [features.fit_space(df, "text", 50)]
    w = rng.normal(size=(features.width(spaces) + 1, 3))
    rows = df.select("id", features.feature_column(spark, spaces).alias("x"), features.margin_column(spark, spaces, w).alias("m")).collect()
    for r in rows:
        assert np.allclose(np.array(r.x.v) @ w[r.x.i] + w[-1] if r.x.i else w[-1], r.m)
    monkeypatch.setattr(linear, "CELLS", 60)
    again = list(features._in_pieces([pa.array([[1] * (k % 50) for k in range(40)])]))
    assert len(again) > 5 and sum(len(c[0]) for c in again) == 40


def test_the_driver_gets_one_gradient_whatever_the_tasks(spark, monkeypatch):
    """It got one of every task; the sums are those of a single task, and the same again."""
    rows, _, _ = sparse_rows(spark, 60, 7, 3, True)
    targets, w, got = linear.Targets(3, True, np.ones(3), np.ones(3)), np.ones((8, 3)), []
    frame = type(rows)
    fetch = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: got.append(fetch(df)) or got[-1])
    results = [linear._evaluate(rows.repartition(k), w, targets) for k in (1, 3, 3, 20)]
    assert [t.num_rows for t in got] == [1, 1, 1, 1]
    for loss, slope in results[1:]:
        assert abs(loss - results[0][0]) < 1e-9 and np.max(np.abs(slope - results[0][1])) < 1e-9


def test_lone_features_are_fitted_as_one(spark, monkeypatch):
    """A row's features that no other row has share one weight; the model is that of all features."""
    rng, data = np.random.default_rng(4), []
    for r in range(90):
        at = np.concatenate([np.sort(rng.choice(8, rng.integers(0, 4), replace=False)), 8 + 3 * r + np.arange(r % 4)])
        data.append((at.tolist(), (rng.random(len(at)) + 0.1).tolist(), np.flatnonzero(rng.random(3) < 0.5).tolist()))
    rows, width = spark.createDataFrame(data, "i array<int>, v array<double>, y array<int>").repartition(3).cache(), 300
    alone = np.bincount([x for r in data for x in r[0]], minlength=width) == 1
    targets = linear.Targets(3, False, np.ones(3), np.full(3, 0.7))
    plain = linear.fit_linear(rows, width, targets, 90, 1 / 90, 1000, 1e-4)
    blocks = linear.pack(rows, linear.CELLS // 20, alone)  # small blocks
    assert len(blocks.parts) == 3 and sum(len(sizes) for _, sizes in blocks.parts) > 6 and len(blocks.lone["lone"]) == alone.sum()
    assert sorted((p, k) for t in blocks.deal(2).tasks for p, ks in t.items() for k in ks) == sorted((p, k) for p, sizes in blocks.parts for k in range(len(sizes)))
    sizes, evaluate = [], linear._evaluate
    monkeypatch.setattr(linear, "_evaluate", lambda rows, w, *more: sizes.append(len(w)) or evaluate(rows, w, *more))
    joint = linear.fit_linear(blocks, width, targets, 90, 1 / 90, 1000, 1e-4)
    assert np.max(np.abs(joint - plain)) < 1e-6 and np.any(joint[:-1][alone] != 0)
    assert set(sizes) == {width - alone.sum() + sum(r % 4 > 0 for r in range(90)) + 1}
    folder = linear.pafs.FileSystem.from_uri(blocks.folder)
    blocks.drop()
    assert folder[0].get_file_info(folder[1]).type == linear.pafs.FileType.NotFound


def test_regression_queries_learn_from_all_train_rows(spark, monkeypatch):
    """They learned from 10 000 rows at most."""
    from types import SimpleNamespace

    from labelforge.operators.splits import hash_bucket_split
    from labelforge.plans import models_queries

    docs = spark.range(13_000).withColumnRenamed("id", "doc_id")
    docs = docs.select("doc_id", F.format_string("word number %d", F.col("doc_id") % 7).alias("text"), F.lit("here").alias("source"))
    task = docs.withColumn("label", (F.col("doc_id") % 2).cast("string"))
    tables = SimpleNamespace(texts=docs, v_task=task, v_multi=task.select("doc_id", F.array("label").alias("label")))
    rows, fit, many = [], baselines.fit_baseline, baselines.predict_multilabel
    monkeypatch.setattr(baselines, "fit_baseline", lambda train, *a, **b: rows.append(train.count()) or fit(train, *a, **b, max_iter=1))
    monkeypatch.setattr(baselines, "predict_multilabel", lambda train, *a, **b: rows.append(train.count()) or many(train, *a, **b, max_iter=1))
    assert models_queries.multilabel_baseline(tables).count() == 2 and models_queries.query_onehot_baseline(tables).count() == 1
    train = hash_bucket_split(docs, "doc_id").filter("split = 'train'").count()
    assert train > 10_000 and rows == [train, train]
