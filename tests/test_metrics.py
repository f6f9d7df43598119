"""Reports, agreement, bootstrap, ranks and evidence scores on hand-sized tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from labelforge.operators import baselines, evidence, metrics, ranking, stats, voting

PAIRS = list(zip("aaabbc", ["a", "a", "b", "b", "b", "zz"]))


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame(PAIRS, "y_true string, y_pred string")


def test_report(pred):
    report = {r.label: r.f1 for r in metrics.classification_report(pred).collect()}
    assert report == {"a": pytest.approx(0.8), "b": pytest.approx(0.8), "c": 0.0, "zz": 0.0}
    means = metrics.averages(metrics.classification_report(pred)).first()
    assert means.macro_f1 == pytest.approx(0.4) and means.weighted_f1 == pytest.approx(2 / 3) and means.accuracy == pytest.approx(5 / 6 - 1 / 6)


def test_missing_prediction_is_a_class(spark):
    df = spark.createDataFrame([("a", None), ("a", "a")], "y_true string, y_pred string")
    assert {r.label for r in metrics.classification_report(df).collect()} == {"a", metrics.UNPARSED}


def test_properties(spark):
    df = spark.range(2000).select((F.col("id") % 7).cast("string").alias("y_true"), (F.col("id") * 31 % 5).cast("string").alias("y_pred"))
    for r in metrics.classification_report(df).collect():
        assert 0 <= r.precision <= 1 and 0 <= r.recall <= 1 and r.f1 <= (r.precision + r.recall) / 2 + 1e-9


def test_kappa(spark):
    a = ["error", "error", "wrong", "multi", "debatable", "error"]
    b = ["error", "wrong", "wrong", "multi", "error", "error"]
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    r = metrics.cohen_kappa(df, "a", "b", ["error", "wrong", "multi", "debatable"]).first()
    assert (r.observed, r.chance, r.kappa) == (pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(0.5))


def test_bootstrap_ways_agree(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("string").alias("y_true"), F.when(F.col("id") % 5 == 0, "0").otherwise((F.col("id") % 3).cast("string")).alias("y_pred"))
    a = metrics.bootstrap_f1(df, draws=400, method="resample").first()
    b = metrics.bootstrap_f1(df, draws=400, method="multinomial").first()
    assert a.draws == b.draws == 400 and abs(a.lower - b.lower) < 0.02 and abs(a.upper - b.upper) < 0.02
    assert rows(metrics.bootstrap_f1(df, draws=50, method="multinomial")) == rows(metrics.bootstrap_f1(df, draws=50, method="multinomial"))


def test_ranks(spark):
    scored = spark.createDataFrame(
        [(1, "q1", "q1", 1, 0.6), (1, "q1", "q2", 1, 0.9), (1, "q1", "q3", 0, 0.99), (2, "q3", "q1", 0, 0.9), (2, "q3", "q2", 0, 0.8), (2, "q3", "q3", 0, 0.7)],
        "id int, query string, candidate string, label int, score double",
    )
    ranks = ranking.gold_ranks(scored, "id")
    assert rows(ranks) == [(1, 2), (2, 1)]
    assert ranking.mean_reciprocal_rank(ranks).first().mrr == pytest.approx(0.75)
    ci = ranking.bootstrap_mrr(ranks, draws=200).first()
    assert ci.lower == 0.5 and ci.upper == 1.0


@pytest.fixture(scope="module")
def tuples(spark):
    schema = "document_id string, query string, stance string, pages array<int>"
    gold = spark.createDataFrame([("d", "q1", "sup", [1, 2])], schema)
    pred = spark.createDataFrame([("d", "q1", "sup", [2, 3]), ("d", "q2", "opp", [1])], schema)
    return gold, pred


def test_evidence_scores(tuples):
    got = {(r.metric, r.facet): (r.p, r.r, r.f) for r in evidence.all_scores(*tuples).collect()}
    assert got[("overlap", "page")] == (75.0, 50.0, 60.0)
    assert got[("overlap", "query")] == got[("overlap", "stance")] == (25.0, 50.0, 33.3)
    assert got[("document", "page")] == (66.6, 100.0, 80.0) and got[("document", "query")] == (50.0, 100.0, 66.6)
    assert got[("strict", "page")] == (0.0, 0.0, 0.0)
    row = evidence.score_row(evidence.all_scores(*tuples)).first()
    assert row.overlap_page == 60.0 and row.document_page == 80.0


def test_evidence_without_pages_fails(spark):
    bad = spark.createDataFrame([("d", "q", "s", [])], "document_id string, query string, stance string, pages array<int>")
    with pytest.raises(Exception, match="no page in d"):
        evidence.overlap_scores(bad, bad).collect()


def test_chance_levels(spark):
    shares = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.3, 0.3), ("c", 0.2, 0.2)], "label string, train double, test double")
    r = stats.chance_f1(shares).first()
    assert r.uniform == pytest.approx(0.3219298245614035) and r.majority == pytest.approx(0.2222222222222222)


def test_cartography(spark):
    import math

    data = [(1, e, [math.log(p / (1 - p)), 0.0], 0) for e, p in enumerate((0.2, 0.6, 0.7))]
    r = baselines.cartography(spark.createDataFrame(data, "id int, epoch int, logits array<double>, label int"), "id").first()
    assert r.mean_probs == pytest.approx(0.5) and r.variability == pytest.approx(0.21602468994692864) and r.correctness == pytest.approx(2 / 3)


def test_votes(spark):
    rows_ = [(1, "x", True), (1, "y", False), (2, "x", True), (3, "x", False)]
    df = spark.createDataFrame(rows_, "id int, task string, is_positive boolean")
    assert rows(voting.vote(df, "id")) == [(1, False), (2, True), (3, False)]
    assert rows(voting.vote(df, "id", "any")) == [(1, True), (2, True), (3, False)]
    with pytest.raises(ValueError):
        voting.vote(df, "id", "most")
    with pytest.raises(ValueError):
        voting.check_tasks(["nope"], ["yes"])


def test_verdicts(spark):
    data = [(1, "SUPPORTS"), (1, "REFUTES"), (2, "SUPPORTS"), (2, "NOT_ENOUGH_INFO"), (3, "NOT_ENOUGH_INFO"), (4, "REFUTES"), (5, None)]
    got = dict(rows(voting.claim_verdict(spark.createDataFrame(data, "c int, label string"), ["c"])))
    assert got == {1: "DISPUTED", 2: "SUPPORTS", 3: "NOT_ENOUGH_INFO", 4: "REFUTES", 5: "NOT_ENOUGH_INFO"}


def test_tfidf_forms_agree(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "a cat sat on the mat"), (2, "the cat"), (3, "dogs and the cats, and Çats")], "id int, text string")
    long = baselines.tfidf_weights(df, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.round("weight", 9))).alias("w"))
    vec = baselines.fit_tfidf(df, "text", "v").transform(baselines.with_text(df, "text", "v_raw"))
    wide = vec.select("id", F.sort_array(F.transform(F.filter(vector_to_array("v"), lambda x: x > 0), lambda x: F.round(x, 9))).alias("w"))
    assert rows(long) == rows(wide)


def test_text_baseline_beats_majority(spark):
    data = [(i, "sun warm beach sand " * 3 if i % 3 else "snow cold ice frost " * 3, "hot" if i % 3 else "cold") for i in range(60)]
    df = spark.createDataFrame(data, "id int, text string, label string")
    model = baselines.fit_baseline(df.filter("id < 40"), max_iter=30)
    assert model.predict(df.filter("id >= 40")).filter("label <> y_pred").count() == 0
    lists = df.withColumn("label", F.array("label"))
    got = baselines.predict_multilabel(lists.filter("id < 40"), lists.filter("id >= 40"), "id", max_iter=30)
    assert got.join(lists, "id").filter("label <> y_pred").count() == 0


def test_drawn_numbers_find_their_cells(spark):
    """Array with guide table and join agree with counting rows, whatever the sizes of the cells."""
    from labelforge.operators import metrics

    for sizes in ([1], [5, 1, 0, 7], [1000] + [1] * 300, [1] * 200 + [5000, 3]):
        cells = spark.createDataFrame([(f"c{i:04d}", "x", n) for i, n in enumerate(sizes)], "y_true string, y_pred string, n bigint")
        total = sum(sizes)
        owner = [i for i, n in enumerate(sizes) for _ in range(n)]
        drawn = metrics.drawn_rows(cells, 7, total, 3).collect()
        want = {}
        for r in drawn:
            want[r.draw, f"c{owner[r.row]:04d}"] = want.get((r.draw, f"c{owner[r.row]:04d}"), 0) + 1
        for most in (10**6, 0):
            got = metrics.drawn_counts(cells, ["y_true", "y_pred"], 7, 3, most).collect()
            assert {(r.draw, r.y_true): r.n for r in got} == want
        plan = metrics.drawn_counts(cells, ["y_true", "y_pred"], 7, 3)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "aggregate(" not in plan
    assert metrics.drawn_counts(cells.limit(0), ["y_true", "y_pred"], 7, 3).collect() == []


def test_running_totals(spark):
    from labelforge.operators.running import running_totals

    rows = [(i * 7 % 1000, i % 5) for i in range(1000)]
    got = running_totals(spark.createDataFrame(rows, "k bigint, v bigint").repartition(9), ["k"], upto="v").orderBy("k").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.upto == total
    assert running_totals(spark.createDataFrame([], "k bigint, v bigint"), ["k"], upto="v").collect() == []


def test_overlap_of_a_document_with_ten_thousand_tuples(spark):
    """Against a loop over sets; one document holds nearly all tuples, and its pages fill several words."""
    import random

    from labelforge.operators import evidence

    rng = random.Random(8)
    def side(n):
        hot = [("hot", rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), sorted(rng.sample(range(300), rng.choice([1, 2, 5])))) for _ in range(n)]
        return hot + [(f"d{i}", rng.choice(["a", "b"]), rng.choice(["x", "y"]), [i % 3, i % 3, 70]) for i in range(50)]

    gold, pred = side(10_000), side(3000)
    schema = "document_id string, query string, stance string, pages array<int>"
    got = {r.facet: r for r in evidence.overlap_scores(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).collect()}
    for facet, columns in evidence.OVERLAP_FACETS.items():
        key = lambda q, s: (q if "query" in columns else "_", s if "stance" in columns else "_")
        a, b = ({(d, *key(q, s), frozenset(p)) for d, q, s, p in rows} for rows in (gold, pred))
        def weight(mine, theirs):
            sets, same = {}, {}
            for d, q, s, p in theirs:
                sets.setdefault(d, set()).add(p)
                same.setdefault((d, q, s), set()).update(p)
            best = {}
            total = 0.0
            for d, q, s, p in mine:
                if None in (q, s) or not p & same.get((d, q, s), set()):
                    continue
                if (d, p) not in best:
                    best[d, p] = max(len(p & o) / len(p) for o in sets[d])
                total += best[d, p]
            return total
        assert (got[facet].g, got[facet].s) == (len(a), len(b))
        assert abs(got[facet].r - 100 * weight(a, b) / len(a)) <= 0.1 and abs(got[facet].p - 100 * weight(b, a) / len(b)) <= 0.1


def test_evidence_scores_are_the_same_by_document_and_spread(spark, monkeypatch):
    """Both ways on the same tuples, with nulls and repeats; the tuples of a document are dealt out once, not once a facet."""
    import random

    rng = random.Random(3)
    def side(n):
        return [(rng.choice(["a", "b", "c", None]), rng.choice(["q", "r", None]), rng.choice(["x", "y"]), [rng.choice([0, 1, 2, 70, 70]) for _ in range(rng.choice([1, 2, 3]))]) for _ in range(n)]

    schema = "document_id string, query string, stance string, pages array<int>"
    gold, pred = spark.createDataFrame(side(40), schema), spark.createDataFrame(side(30), schema)
    order = lambda: evidence.all_scores(gold, pred).orderBy("metric", "facet").collect()
    whole = order()
    monkeypatch.setattr(evidence, "DOCUMENT_TUPLES", 0)
    spread = order()
    assert len(whole) == 10
    for a, b in zip(whole, spread):
        assert a[:5] == b[:5] and all(abs(x - y) <= 0.1 for x, y in zip(a[5:], b[5:]))


def test_tuples_of_evidence_are_made_once(spark):
    """Sizes and sums each made all tuples again, and counted documents in the tasks that made them."""
    flat = spark.range(200).selectExpr("id % 50 as document_id", "'q' as query", "'s' as stance", "array(int(id)) as pages")
    scores = evidence.document_scores(flat, flat.filter("document_id < 40"))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "LogicalRDD" in plan
    assert [tuple(r)[1:5] for r in scores.orderBy("facet").collect()] == [("page", 200, 160, 160), ("query", 50, 40, 40), ("stance", 50, 40, 40)]


@pytest.mark.parametrize("most", [64, 1, 0])
def test_document_scores_of_odd_tuples(spark, monkeypatch, most):
    """Null documents, values and pages are values, repeated tuples count once, tuples without pages don't; spread or not."""
    monkeypatch.setattr(evidence, "DOCUMENT_TUPLES", most)
    schema = "document_id string, query string, stance string, pages array<int>"
    g = [("a", "q", "s", [1, 2]), ("a", "q", "s", [1, 2]), ("a", None, "s", [2, None]), ("b", "q", None, []), ("c", "q", "t", None), (None, "q", "s", [3])]
    p = [("a", "q", "t", [2, 2]), (None, "q", "s", [3]), (None, None, None, [4]), ("d", "q", "s", [1])]
    sets = lambda rows, f: {(d, x) for d, q, s, pages in rows if pages for x in {"page": pages, "query": [q], "stance": [s]}[f]}
    scores = evidence.document_scores(spark.createDataFrame(g, schema), spark.createDataFrame(p, schema))
    for r in scores.collect():
        x, y = sets(g, r.facet), sets(p, r.facet)
        assert (r.g, r.s, r.c) == (len(x), len(y), len(x & y)), r.facet


def test_tuples_of_evidence_go_to_more_tasks_as_they_grow(spark, monkeypatch):
    """A fixed number of partitions let the memory of a task grow with the table."""
    monkeypatch.setattr(evidence, "TUPLES_A_TASK", 10)
    flat = spark.range(1000).selectExpr("cast(id as string) as document_id", "'q' as query", "'s' as stance", "array(1, 2) as pages")
    scores = evidence.strict_scores(flat, flat)
    assert "RepartitionByExpression [document_id" in scores._jdf.queryExecution().toString()
    assert scores.filter("facet = 'all'").first().c == 1000


def test_term_weights_go_to_more_tasks_as_texts_grow(spark, monkeypatch):
    """A fixed number of partitions let the memory of a task grow with the texts; the weights stay the same."""
    df = spark.range(60).selectExpr("id", "concat('alpha beta word', id % 7, ' word', id % 11) as text")
    rows = lambda: sorted((r.id, r.term, r.tf, r.df, round(r.weight, 9)) for r in baselines.tfidf_weights(df, "id").collect())
    before = rows()
    monkeypatch.setattr(baselines, "LETTERS_A_TASK", 50)
    monkeypatch.setattr(baselines, "TERMS_A_TASK", 10)
    assert rows() == before and len(before) > 200
    # the terms' tables are checkpoints whose partitions are those of the texts dealt out
    dealt = baselines._dealt(df, 23.5, "id")
    assert dealt.rdd.getNumPartitions() == max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))
