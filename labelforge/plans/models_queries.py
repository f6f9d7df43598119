"""Bag-of-words, dummy, training-dynamics and model-application queries."""

import pandas as pd
from pyspark.sql import functions as F

from labelforge.functions.arrays import argmax, softmax, true_label_probability
from labelforge.operators import baselines as op
from labelforge.operators import metrics
from labelforge.operators.scoring import Models, score_with
from labelforge.operators.splits import TRAIN_CAP, hash_bucket_split, resize
from labelforge.plans.registry import query, sql_hash_int



def _split(t, df):
    parts = hash_bucket_split(df, "doc_id")
    return parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")


def _capped(train, key="doc_id", label="y_true"):
    """At most the train cap of the evaluation, stratified by the label: the vocabulary is the cap's."""
    return resize(train, key, TRAIN_CAP, label)


_TF = f"""w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents), tf as (select doc_id, term, count(*) as tf from w group by all),
d as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from documents),
x as (select doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) as w from tf join d using (term), n)"""


@query("tfidf_weights", f"with {_TF} select doc_id, term, tf, df, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from x")
def tfidf_weights(t):
    return op.tfidf_weights(t.texts, "doc_id").withColumn("weight", F.round("weight", 6))


def _report(df):
    means = metrics.averages(metrics.classification_report(df))
    return means.select(*[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1", "accuracy")], "support")


@query("text_baseline")
def text_baseline(t):
    """Balanced regression on TF-IDF: language of a document from its text."""
    train, test = _split(t, t.texts.select("doc_id", "text", F.col("lang").alias("y_true")))
    model = op.fit_baseline(_capped(train, label="y_true"), "y_true")
    return _report(model.predict(test))


@query("query_onehot_baseline")
def query_onehot_baseline(t):
    """Quality of a document from its text and its source, learned from all train rows."""
    df = t.v_task.select("doc_id", "text", F.col("source").alias("query"), F.col("label").alias("y_true"))
    train, test = _split(t, df)
    return _report(op.fit_baseline(train, "y_true", query="query", query_kind="onehot").predict(test))


@query("pair_baseline")
def pair_baseline(t):
    """Does the text answer the query? Two TF-IDF spaces side by side."""
    from labelforge.operators.splits import negative_answers, stack_answers

    pairs = t.v_pairs.withColumnsRenamed({"query": "question", "text": "answer", "pair_id": "doc_id"})
    drawn = hash_bucket_split(negative_answers(pairs, "doc_id"), "doc_id").filter("false_answer is not null")
    stacked = lambda s: stack_answers(drawn.filter(F.col("split") == s), "question", "answer", "false_answer").withColumn("y_true", F.col("label").cast("string")).drop("label")
    train = stacked("train")
    both = train.withColumn("row", F.xxhash64("query", "text", "y_true"))
    return _report(op.fit_baseline(_capped(both, "row", "y_true").drop("row"), "y_true", query="query").predict(stacked("test")))


@query("multilabel_baseline")
def multilabel_baseline(t):
    """Label lists from the text, one regression per label, learned from all train rows."""
    df = t.texts.select("doc_id", "text").join(t.v_multi, "doc_id")
    train, test = _split(t, df)
    predicted = op.predict_multilabel(train, test, "doc_id")
    both = test.select("doc_id", F.col("label").alias("y_true")).join(predicted, "doc_id")
    report = metrics.multilabel_report(both, classes=train.select(F.explode("label").alias("label")))
    return report.select("label", "tp", "support", "predicted", F.round("f1", 6).alias("f1"))


_S = f"s as (select doc_id, lang, case when {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE < 0.8::DOUBLE then 'train' when {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE < 0.9::DOUBLE then 'test' else 'dev' end as split from documents)"


@query("majority_dummy", f"with {_S} select doc_id, lang as label, (select lang from s where split = 'train' group by 1 order by count(*) desc, 1 limit 1) as y_pred from s where split = 'test'")
def majority_dummy(t):
    return op.majority_dummy(*_split(t, t.v_lang.select("doc_id", "label")))


@query("uniform_dummy", f"with {_S}, l as (select list_sort(list(distinct lang)) as l from s where split = 'train') select doc_id, lang as label, l[({sql_hash_int('doc_id')} % len(l)) + 1] as y_pred from s, l where split = 'test'")
def uniform_dummy(t):
    train, test = _split(t, t.v_lang.select("doc_id", "label"))
    return op.uniform_dummy(train, test, "doc_id")


_MS = f"""s as (select doc_id, label, case when {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE < 0.8::DOUBLE then 'train' when {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE < 0.9::DOUBLE then 'test' else 'dev' end as split from v_multi),
tr as (select * from s where split = 'train'), n as (select count(*) as total from tr),
l as (select name, count(*) as n from (select doc_id, unnest(list_distinct(label)) as name from tr) group by 1)"""


@query("majority_multilabel_dummy", f"with {_MS} select doc_id, array_to_string(coalesce((select list(name order by name) from l, n where n > total / 2.0), []), '|') as y_pred from s where split = 'test'", ("v_multi",))
def majority_multilabel_dummy(t):
    out = op.majority_multilabel_dummy(*_split(t, t.v_multi))
    return out.select("doc_id", F.array_join("y_pred", "|").alias("y_pred"))


@query("uniform_multilabel_dummy", f"""with {_MS}, d as (select doc_id, name from s, l, n where split = 'test' and (l.n = total or {sql_hash_int('doc_id', 'name')} % 2 = 0))
select doc_id, array_to_string(coalesce(list(name order by name) filter (name is not null), []), '|') as y_pred from (select doc_id from s where split = 'test') left join d using (doc_id) group by 1""", ("v_multi",))
def uniform_multilabel_dummy(t):
    train, test = _split(t, t.v_multi)
    return op.uniform_multilabel_dummy(train, test, "doc_id").select("doc_id", F.array_join("y_pred", "|").alias("y_pred"))


_P = "exp(logits[label + 1]) / list_sum(list_transform(logits, lambda x: exp(x)))"


@query("label_probabilities", f"select doc_id, epoch::INTEGER as epoch, round({_P}, 6) as p, (list_position(logits, list_max(logits)) - 1)::INTEGER as predicted, round(list_max(list_transform(logits, lambda x: exp(x))) / list_sum(list_transform(logits, lambda x: exp(x))), 6) as top from v_carto", ("v_carto",))
def label_probabilities(t):
    return t.v_carto.select(
        "doc_id", "epoch", F.round(true_label_probability("logits", "label"), 6).alias("p"), argmax("logits").alias("predicted"), F.round(F.array_max(softmax("logits")), 6).alias("top")
    )


@query("cartography", f"""select doc_id, round(avg({_P}), 6) as mean_probs, round(stddev_pop({_P}), 6) as variability,
 round(avg(case when list_position(logits, list_max(logits)) - 1 = label then 1.0::DOUBLE else 0 end), 6) as correctness from v_carto group by doc_id""", ("v_carto",))
def cartography(t):
    out = op.cartography(t.v_carto, "doc_id")
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("mean_probs", "variability", "correctness")])


def load_keyword_scorer(task: str):
    """A caller-supplied model: labels by how often a letter occurs."""
    def load():
        letter, limit = {"many_e": ("e", 50), "many_a": ("a", 40)}[task]

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            n = batch["text"].str.count(letter)
            return pd.DataFrame({"y_pred": (n >= limit).map({True: "yes", False: "no"})})

        return score

    return load


@query("external_scores", "select doc_id, case when len(text) - len(replace(text, 'e', '')) >= 50 then 'yes' else 'no' end as y_pred from documents")
def external_scores(t):
    models = Models()
    models.register("keywords", "classification", load_keyword_scorer)
    return models.predict(t.texts.select("doc_id", "text"), "keywords", "many_e").select("doc_id", "y_pred")


@query("external_pair_scores", "select pair_id, case when contains(text, string_split(query, ' ')[1]) then 'yes' else 'no' end as y_pred from v_pairs", ("v_pairs",))
def external_pair_scores(t):
    def load():
        def score(batch):
            hits = [q.split(" ")[0] in x for x, q in zip(batch["text"], batch["query"])]
            return pd.DataFrame({"y_pred": ["yes" if h else "no" for h in hits]})

        return score

    return score_with(t.v_pairs, load, ["text", "query"], "y_pred string").select("pair_id", "y_pred")


@query("external_multilabel_scores", "select doc_id, array_to_string(list_filter(['a', 'e', 'q'], lambda x: contains(text, x)), ',') as y_pred from documents")
def external_multilabel_scores(t):
    models = Models()

    def loader(task):
        def load():
            return lambda batch: pd.DataFrame({"y_pred": [[c for c in "aeq" if c in x] for x in batch["text"]]})

        return load

    models.register("keywords", "multilabel", loader)
    scored = models.predict(t.texts.select("doc_id", "text"), "keywords", "letters", mode="multilabel")
    return scored.select("doc_id", F.array_join("y_pred", ",").alias("y_pred"))
