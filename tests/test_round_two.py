"""Complete negative draws, vocabulary-wide scores, quoted lists, partition overwrites, and plans without sorted texts."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.functions import text as tx
from labelforge.operators import baselines, dedup, metrics, nested, splits
from labelforge.operators.language import detect, fit_profiles
from labelforge.sources import writers


def test_negative_answers_are_complete_when_one_answer_is_nearly_all(spark):
    rows = [(i, f"q{i % 3}", "a" if i % 50 else f"b{i % 7}") for i in range(1500)] + [(9000, "lone", None), (9001, None, "a")]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    got = {r.id: r.false_answer for r in splits.negative_answers(df, "id", buckets=16).collect()}
    known = {}
    for _, q, a in rows:
        known.setdefault(q, set()).add(a)
    every = {a for _, _, a in rows if a is not None}
    for i, q, _ in rows:
        assert (got[i] is None) == (not every - known[q])
        assert got[i] is None or got[i] in every - known[q]


def test_negative_answers_follow_the_answers_frequencies(spark):
    rows = [(i, f"q{i % 40}", f"a{i % 40 // 4}") for i in range(2000)] + [(5000 + i, f"x{i}", "often") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    got = splits.negative_answers(df, "id").filter("id < 2000").groupBy("false_answer").count().collect()
    often = sum(r["count"] for r in got if r.false_answer == "often") / 2000
    assert 0.47 < often < 0.58  # 2000 of the 3800 rows with another answer


def test_no_answer_left(spark):
    df = spark.createDataFrame([(1, "q", "a"), (2, "q", "b")], "id long, question string, answer string")
    assert {r.false_answer for r in splits.negative_answers(df, "id").collect()} == {None}
    assert splits.stack_answers(splits.negative_answers(df, "id"), "question", "answer", "false_answer").count() == 2
    assert splits.negative_answers(df.limit(0), "id").count() == 0


def test_multilabel_scores_over_the_vocabulary(spark):
    df = spark.createDataFrame([(1, ["a"], ["a"]), (2, ["a"], ["a", "b"]), (3, ["z"], ["z"])], "id long, y_true array<string>, y_pred array<string>")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    report = {r.label: (r.tp, r.support, r.f1) for r in metrics.multilabel_report(df, classes=classes).collect()}
    assert report == {"a": (2, 2, 1.0), "b": (0, 0, 0.0), "c": (0, 0, 0.0)}
    assert {r.label for r in metrics.multilabel_report(df).collect()} == {"a", "b", "z"}
    got = metrics.bootstrap_multilabel_f1(df, "id", classes=classes).first()
    assert got.upper <= 1 / 3 + 1e-9 and got.draws < 100  # draws of one gold list are left out


def test_multilabel_bootstrap_of_odd_rows(spark):
    """Null keys and lists, empty lists, repeated keys and labels, against the same sums in Python."""
    rows = [(i, ["a", "b"][: i % 3], ["b", "c", "b"][: i % 4]) for i in range(12)]
    rows += [(3, ["a"], ["a"]), (3, ["a"], ["a"]), (None, ["d"], ["d", None]), (50, None, ["a"]), (51, ["b", "a"], None), (52, [], [])]
    steps, known, scores = metrics.poisson_steps(), ["a", "b", "c", "d"], []
    for draw in range(40):
        sums, golds = {x: [0, 0] for x in known}, set()
        for key, t, p in rows:
            name = f"42|{draw}" if key is None else f"42|{draw}|{key}"
            w = sum(int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32 >= e for e in steps)
            golds |= {tuple(sorted({*t}))} if w and t is not None else set()
            for x in known if t is not None and p is not None else ():
                sums[x][0] += 2 * w * (x in t and x in p)
                sums[x][1] += w * ((x in t) + (x in p))
        if len(golds) > 1:
            scores.append(sum(a / b for a, b in sums.values() if b) / len(known))
    df = spark.createDataFrame(rows, "id long, y_true array<string>, y_pred array<string>")
    got = metrics.bootstrap_multilabel_f1(df, "id", draws=40).first()
    want = np.quantile(scores, [0.025, 0.975])
    assert got.draws == len(scores) and abs(got.lower - want[0]) < 1e-9 and abs(got.upper - want[1]) < 1e-9


def test_multilabel_bootstrap_makes_its_hashes_in_one_pass(spark):
    """A filter of rows by their weight made twelve hashes of each, and the check of gold lists made all of them again."""
    df = spark.range(60).selectExpr("id", "array(string(id % 3)) as y_true", "array(string(id % 4)) as y_pred")
    interval = metrics.bootstrap_multilabel_f1(df, "id", draws=20)
    interval.collect()
    plan = interval._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    filters = [x.count("md5(") for x in plan.splitlines() if "Filter" in x and "md5(" in x]
    assert filters == [1] and "ReusedExchange [draw" in plan


def test_bootstrap_in_parts_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 2], "abb"[i % 3]) for i in range(90)], "id long, y_true string, y_pred string")
    whole = metrics.bootstrap_f1(df, draws=60).first()
    monkeypatch.setattr(metrics, "DRAWN_TOGETHER", 7)
    assert metrics.bootstrap_f1(df, draws=60).first() == whole
    other = metrics.bootstrap_f1(df, draws=400, method="multinomial").first()
    assert abs(other.lower - whole.lower) < 0.06 and abs(other.upper - whole.upper) < 0.06


@pytest.mark.parametrize("text, want", [
    ("['a', 'b']", ["a", "b"]), ("[\"don't\", 'x']", ["don't", "x"]), ("['say \"hi\"']", ['say "hi"']), ("[]", []), ("no list", None),
    ("['a', None, 3]", ["a", None, "3"]), (r"['it\'s']", ["it's"]), (None, None), ("['a, b', 'c]d']", ["a, b", "c]d"]),
])
def test_string_lists(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.parse_string_list("t").alias("x")).first().x == want


def test_evidence_tuples_with_apostrophes(spark):
    raw = """[("don't delay", 'supporting', [1, 2]), ('plain', "it's", 3)]"""
    got = spark.createDataFrame([(raw,)], "t string").select(nested.as_evidence_list("t").alias("x")).first().x
    assert [(r.query, r.stance, r.page_indices) for r in got] == [("don't delay", "supporting", [1, 2]), ("plain", "it's", [3])]


def test_overwriting_one_dataset_keeps_the_others(spark, tmp_path):
    rows = spark.createDataFrame([("t", "train"), ("u", "test")], "text string, split string")
    for name in ("one", "two", "one"):
        writers.write_splits(rows, str(tmp_path / "out"), name)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in got} == {"one": 2, "two": 2}


def test_duplicates_are_found_without_sorting_texts(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 1), (3, "y", 0), (4, None, 0), (5, None, 0)], "doc_id long, text string, label int")
    assert sorted(r.doc_id for r in dedup.keep_first(df, ["text"], "doc_id").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in dedup.drop_all_copies(df, ["text"], "doc_id").collect()) == [3]
    assert sorted(r.doc_id for r in dedup.drop_conflicting_negatives(df, ["text"]).collect()) == [2, 3]
    plan = dedup._per_key(df, ["text"], "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    counts = {r.definition: (r.n_rows, r.with_copy, r.surplus) for r in dedup.duplicate_counts(df, {"t": [F.col("text")], "l": [F.col("label")]}).collect()}
    assert counts == {"t": (5, 4, 2), "l": (5, 4, 3)}


@pytest.mark.parametrize("most", [200_000, 0])
def test_term_weights_of_odd_rows(spark, monkeypatch, most):
    """Null keys are one document, rows of one key are one, null and empty texts only count; with and without common terms apart."""
    small = baselines.small_table
    monkeypatch.setattr(baselines, "small_table", lambda df: small(df, most))
    rows = [(i, f"all {'even' if i % 2 == 0 else 'odd'} word{i // 2} word{i // 2} own{i}") for i in range(1500)]
    rows += [(3, "all again own3"), (None, "all null own1"), (None, "null"), (7000, None), (7001, ""), (7002, "a . !"), (7003, "all")]
    words = {}
    for key, text in rows:
        for w in (text or "").split():
            if len(w) > 1:
                words.setdefault(key, {}).setdefault(w, 0)
                words[key][w] += 1
    df_of = {}
    for terms in words.values():
        for w in terms:
            df_of[w] = df_of.get(w, 0) + 1
    want = []
    for key, terms in words.items():
        w = {t: tf * (math.log((1 + len(rows)) / (1 + df_of[t])) + 1) for t, tf in terms.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        want += [(key, t, tf, df_of[t], round(w[t] / length, 9)) for t, tf in terms.items()]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [(r.id, r.term, r.tf, r.df, round(r.weight, 9)) for r in baselines.tfidf_weights(df, "id").collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_term_rows_stay_with_their_documents(spark, monkeypatch):
    """All rows of terms were shuffled by document at the end, and those of all but common terms by term before."""
    monkeypatch.setattr(baselines, "LETTERS_A_TASK", 2000)
    df = spark.range(3000).selectExpr("id", "concat('all rare', id div 3, ' own', id) as text")
    weights = baselines.tfidf_weights(df, "id")
    assert weights.filter("term like 'rare%' and df = 3").count() == 3000
    whole = weights._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange shufflepartitionidpassthrough") == 1 and "Exchange hashpartitioning" not in whole
    written = baselines.cut_lineage(df.repartition(4, "id"), placed=True).groupBy("id").count()
    assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_words_of_other_scripts(spark):
    df = spark.createDataFrame([(1, "Привет мир привет", "ru"), (2, "hello world", "en"), (3, "мир", "ru")], "doc_id long, text string, lang string")
    terms = {(r.doc_id, r.term) for r in baselines.tfidf_weights(df, "doc_id").collect()}
    assert terms == {(1, "привет"), (1, "мир"), (2, "hello"), (2, "world"), (3, "мир")}
    found = {r.doc_id: (r.language, r.gibberish) for r in detect(df.select("doc_id", "text"), fit_profiles(df), "doc_id").collect()}
    assert found == {1: ("ru", "clean"), 2: ("en", "clean"), 3: ("ru", "clean")}
