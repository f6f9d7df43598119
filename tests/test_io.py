"""Readers, writers, merges and the incremental job."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from labelforge.functions.text import clean_text
from labelforge.operators import requests
from labelforge.operators.nested import DOCUMENT_SCHEMA, claim_evidence_rows, labelled_pages, page_queries, sentence_membership
from labelforge.plans import catalog, recipes
from labelforge.sources import readers, writers
from labelforge.streaming import ingest


def test_csv_with_line_breaks_and_renaming(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body,y\n1,"two\nlines, ""quoted""",x\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, body string, y string", {"body": "text", "y": "label"})
    assert rows(df) == [('two\nlines, "quoted"', "x")]
    (tmp_path / "b.tsv").write_text("id\tbody\n1\ta b\n")
    assert rows(readers.read_tsv(spark, str(tmp_path / "b.tsv"), "id int, body string")) == [(1, "a b")]


def test_bad_lines_are_reported(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2\n\n{"a": 3}\n')
    good, bad = readers.read_tolerant_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 3] and [r.value for r in bad.collect()] == ['{"a": 2']


def test_question_files(spark, tmp_path):
    for i, name in ((2, "x"), (7, "y")):
        (tmp_path / f"{name}.csv").write_text(f"Year,Company Name,Question {i}\n2020,ACME,{name} text\n")
    df = readers.read_question_files(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")])
    assert rows(df, "label") == [("x text", 2, 2020, "ACME"), ("y text", 7, 2020, "ACME")]


def test_a_thousand_question_files_are_no_job_each(spark, tmp_path):
    for k in range(1000):
        extra = "Note," if k % 4 == 0 else ""
        (tmp_path / f"f {k}.csv").write_text(f'{extra}Year,Company Name,Question {k % 3}\n' + ("x," if extra else "") + f'2020,"A, {k}","two\nlines {k}"\n')
    tracker, group = spark.sparkContext.statusTracker(), "question-files"
    spark.sparkContext.setJobGroup(group, group)
    df = readers.read_question_files(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 14  # headers, and listings of the files of six headers
    got = rows(df, "Company Name")
    assert len(got) == 1000 and sorted(got)[0][1] in (0, 1, 2)
    assert {(r[0], r[1], r[3]) for r in got} == {(f"two\nlines {k}", k % 3, f"A, {k}") for k in range(1000)}


def test_split_table_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id int, label string, split string")
    for name in ("one", "two"):
        writers.write_splits(df, str(tmp_path / "t"), name, mode="append")
    back = readers.read_splits(spark, str(tmp_path / "t"), "one").filter("split = 'train'")
    assert back.count() == 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "split" in plan


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    merged, clashes = writers.insert_only(old, new, "k")
    assert rows(merged) == [("a", 1), ("b", 2), ("c", 3)] and rows(clashes) == [("b", 9)]
    assert rows(writers.upsert(old, new, "k")) == [("a", 1), ("b", 9), ("c", 3)]
    writers.write_if_absent(old, str(tmp_path / "j"))
    writers.write_if_absent(new, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.write_csv(old.withColumn("l", F.array("k")), str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), "k string, v int, l string")
    assert rows(back) == [("a", 1, '["a"]'), ("b", 2, '["b"]')]


def test_log_and_resume(spark, tmp_path):
    row = spark.createDataFrame([("d1", "m", 0.5, "f1_score", 2, 42, 0.6, 0.4, None, 0.5, 0.5, 0.5, 0.5)], ", ".join(
        f"{c} {'string' if c in ('dataset_name', 'model_type', 'performance_type') else 'int' if c in ('n_labels', 'seed', 'n_epoch') else 'double'}" for c in writers.LOG_COLUMNS))
    writers.append_log(row, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    todo = spark.createDataFrame([("d1",), ("d2",)], "dataset_name string")
    assert rows(writers.remaining(todo, log, 42)) == [("d2",)]
    assert writers.remaining(todo, log, 7).count() == 2 and writers.remaining(todo, log).count() == 1
    assert catalog.to_run(catalog.catalogue(spark), log, 42).count() == 39


def test_json_inside_json(spark):
    talk = {"ds": [[{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "yes"}]]}
    df = spark.createDataFrame([(json.dumps(json.dumps(talk)),)], "value string")
    inner = readers.unwrap_json(df, "value", requests.TRANSCRIPT_TYPE)
    assert inner.first().value["ds"][0][2].content == "yes"
    plain = spark.createDataFrame([(json.dumps(talk),)], "value string")
    assert rows(requests.transcript_answers(plain)) == [("ds", 0, "yes")]


def test_nested_documents(spark, tmp_path):
    doc = {
        "document_id": "d", "sentences": [
            {"page_idx": 0, "sentence_id": "a", "block_idx": 1, "block_sentence_idx": 0, "text": "B"},
            {"page_idx": 0, "sentence_id": "b", "block_idx": 0, "block_sentence_idx": 0, "text": "A1"},
            {"page_idx": 0, "sentence_id": "c", "block_idx": 0, "block_sentence_idx": 1, "text": "A2"},
            {"page_idx": 1, "sentence_id": "d", "block_idx": 2, "block_sentence_idx": 0, "text": "C"}],
        "evidences": [{"query": "q", "stance": "s", "page_indices": [0], "comment": ""}, {"query": "p", "stance": "s", "page_indices": [0], "comment": ""}],
        "meta": {"evidences": [[{"sentence_ids": ["a"]}, {"sentence_ids": ["d"]}]]},
    }
    (tmp_path / "d.jsonl").write_text(json.dumps(doc))
    docs = readers.read_json_lines(spark, str(tmp_path / "d.jsonl"), DOCUMENT_SCHEMA)
    assert rows(labelled_pages(docs).select("page_idx", "text", "label")) == [(0, "A1A2\\nB", 1), (1, "C", 0)]
    assert rows(page_queries(docs)) == [("d", 0, ["p", "q"])]
    assert dict(rows(sentence_membership(docs).select("sentence_id", "y"))) == {"a": 1, "b": 0, "c": 0, "d": 0}
    assert recipes.policy_page_relations(docs).count() == 2 and recipes.policy_page_stances(docs).count() == 2


def test_stream_takes_only_new_files(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    page = lambda n: spark.createDataFrame([(1, f"f{n}", "NarrativeText", "Mail me at a@b.org now please", 6), (1, f"f{n}", "Title", "Top of page here", 4)], ingest.PARAGRAPH_SCHEMA)
    seen = []
    for n in (1, 2):
        page(n).write.mode("append").parquet(folder)
        ingest.process_new_files(spark, folder, out, checkpoint, lambda df: df.withColumn("seen", F.lit(n))).awaitTermination()
        seen.append(spark.read.parquet(out).count())
    assert seen == [1, 2]
    got = spark.read.parquet(out).orderBy("seen").collect()
    assert [r.seen for r in got] == [1, 2] and got[0].clean_text == "Mail me at <EMAIL> now please"


def test_recipes(spark):
    raw = spark.createDataFrame([(i, f"text number {i % 90} is here", str(i % 3)) for i in range(300)], "id bigint, text string, label string")
    out = recipes.rebuilt_single_label(raw)
    assert out.select("clean_text").distinct().count() == out.count() == 90
    spec = catalog.specs(["climate_detection"])[0]
    ready = recipes.prepare(recipes.random_split(raw), spec, "id", max_size=30)
    assert ready.filter("split = 'train'").count() == 30
    claims = spark.createDataFrame([(str(c), f"c{c}", "SUPPORTS", [("a", 0.1, f"e{c}{k}", f"{c}:{k}", "SUPPORTS", ["SUPPORTS"]) for k in range(3)]) for c in range(40)],
        "claim_id string, claim string, claim_label string, evidences array<struct<article:string,entropy:double,evidence:string,evidence_id:string,evidence_label:string,votes:array<string>>>")
    assert claim_evidence_rows(claims).count() == 120
    parts = recipes.claim_evidences(claims)
    assert parts.groupBy("claim_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    qa = spark.createDataFrame([(i, f"q{i % 20}", f"a{i % 50}") for i in range(200)], "id bigint, q string, a string")
    pairs = recipes.question_answers(qa, qa.select(F.col("a").alias("answer")), "q", "a")
    assert pairs.filter("label = 1").count() == pairs.filter("label = 0").count()
    assert set(catalog.NAMES) <= set(recipes.RECIPES)


def test_cascade_trains_and_runs(spark):
    data = []
    for i in range(60):
        query, stance = (("carbon", "for") if i % 4 == 0 else ("land", "against")) if i % 2 == 0 else (None, None)
        word = {"carbon": "carbon tax price", "land": "forest land soil"}.get(query, "lunch menu music")
        data.append((i, f"{word} {word} number {i}", query, stance))
    pages = spark.createDataFrame(data, "page bigint, text string, query string, stance string")
    models = recipes.train_cascade(pages.filter("page < 40"), "page", max_iter=20)
    got = recipes.run_cascade(models, pages.filter("page >= 40").select("page", "text"), "page").orderBy("page").collect()
    assert [(r.label, r.queries, r.stances) for r in got[:4]] == [(1, ["carbon"], ["for"]), (0, None, None), (1, ["land"], ["against"]), (0, None, None)]


def test_catalogue():
    specs = {s.name: s for s in catalog.specs()}
    assert len(specs) == 39 and specs["climaQA"].balance == "random" and specs["climaQA"].stratify_on == "query"
    assert specs["ClimaTOPIC"].balance == "weighted" and specs["sciDCC"].weighted_loss and not specs["climatext"].weighted_loss
    assert [s.name for s in catalog.specs(["sciDCC", "none"])] == ["sciDCC"] and catalog.inputs_of("lobbymap_stance") == ("text", "query")
    assert catalog.specs(["climatext"], {"climatext": {"balance": "random"}})[0].balance == "random"


def test_positive_labels_are_checked_against_the_data(spark):
    predictions = spark.createDataFrame([("green_claims", "green_claim"), ("climate_detection", "no")], "task string, y_pred string")
    wanted = catalog.positives(spark, ["green_claims", "climate_detection"])
    assert rows(catalog.unseen_positives(predictions, wanted)) == [("climate_detection", "yes")]
    with pytest.raises(ValueError):
        catalog.positives(spark, ["sciDCC"])
