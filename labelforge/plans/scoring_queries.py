"""Classification reports, confusion, agreement, bootstrap and ranking queries."""

from functools import reduce

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.operators import metrics as op
from labelforge.operators import ranking
from labelforge.operators.splits import hash_bucket_split
from labelforge.operators.stats import mean_interval
from labelforge.operators.voting import claim_verdict
from labelforge.plans.registry import query, sql_hash_int
from labelforge.plans.views import READABLE

WORKERS = [f"worker_{k}" for k in range(8)]
HUMANS = [WORKERS[i] for i in (0, 1, 2, 4)]  # fixed values: annotators 1, 2, 3 and 5 take part


def _cells(view, by="", true="y_true", pred="coalesce(y_pred, '<unparsed>')"):
    b = f"{by}, " if by else ""
    return f"""cells as (select {b}{true} as y_true, {pred} as y_pred, count(*) as n from {view} group by all),
sides as (select {b}y_true as label, case when y_true = y_pred then n else 0 end as tp, n as support, 0 as predicted from cells union all select {b}y_pred, 0, 0, n from cells),
sums as (select {b}label, sum(tp)::BIGINT as tp, sum(support)::BIGINT as support, sum(predicted)::BIGINT as predicted from sides group by all),
rep as (select *, case when predicted > 0 then tp / predicted else 0 end as p, case when support > 0 then tp / support else 0 end as r, 2 * tp / (support + predicted) as f from sums)"""


def rounded(df, *names):
    """Doubles to six digits."""
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


_REPORT_COLUMNS = "round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1"


@query("classification_report", f"with {_cells('v_pred')} select label, tp, support, predicted, {_REPORT_COLUMNS} from rep", ("v_pred",))
def classification_report(t):
    return rounded(op.classification_report(t.v_pred), "precision", "recall", "f1")


_AVERAGES = """round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(avg(f), 6) as macro_f1, round(sum(p * support) / sum(support), 6) as weighted_precision,
 round(sum(r * support) / sum(support), 6) as weighted_recall, round(sum(f * support) / sum(support), 6) as weighted_f1, round(sum(tp) / sum(support), 6) as accuracy, sum(support)::BIGINT as support, count(*) as n_labels"""
_MEANS = ("macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1", "accuracy")


@query("report_averages", f"with {_cells('v_pred')} select {_AVERAGES} from rep", ("v_pred",))
def report_averages(t):
    return rounded(op.averages(op.classification_report(t.v_pred)), *_MEANS)


@query("report_averages_by_source", f"with {_cells('v_pred', 'source')} select source, {_AVERAGES} from rep group by source", ("v_pred",))
def report_averages_by_source(t):
    return rounded(op.averages(op.classification_report(t.v_pred, ["source"]), ["source"]), *_MEANS)


_MULTI = """l as (select distinct label from (select unnest(label) as label from v_multi union all select 'never_given')),
m as (select label, count(*) filter (list_contains(y_true, label) and list_contains(y_pred, label)) as tp, count(*) filter (list_contains(y_true, label)) as support,
 count(*) filter (list_contains(y_pred, label)) as predicted from v_multi_pred cross join l group by label),
rep as (select *, case when predicted > 0 then tp / predicted else 0 end as p, case when support > 0 then tp / support else 0 end as r, case when support + predicted > 0 then 2 * tp / (support + predicted) else 0 end as f from m)"""


@query("multilabel_report", f"with {_MULTI} select label, tp, support, predicted, {_REPORT_COLUMNS} from rep", ("v_multi", "v_multi_pred"))
def multilabel_report(t):
    """Over the labels of the labelled table and one that no row has."""
    classes = t.v_multi.select(F.explode("label").alias("label")).union(t.spark.createDataFrame([("never_given",)], "label string"))
    return rounded(op.multilabel_report(t.v_multi_pred, classes=classes), "precision", "recall", "f1")


@query("samples_average", """with k as (select list(distinct label) as known from (select unnest(list_concat(y_true, y_pred)) as label from v_multi_pred)),
s as (select len(y_true) as t, len(list_intersect(y_pred, known)) as p, len(list_intersect(list_intersect(y_pred, known), y_true)) as c from v_multi_pred, k)
select round(avg(case when p > 0 then c / p else 0 end), 6) as samples_precision, round(avg(case when t > 0 then c / t else 0 end), 6) as samples_recall, round(avg(case when t + p > 0 then 2 * c / (t + p) else 0 end), 6) as samples_f1 from s""", ("v_multi_pred",))
def samples_average(t):
    return rounded(op.samples_average(t.v_multi_pred), "samples_precision", "samples_recall", "samples_f1")


@query("logits_report", f"with q as (select ['a','b','c','d'][label + 1] as y_true, ['a','b','c','d'][list_position(logits, list_max(logits))] as y_pred from v_carto where epoch = 4), {_cells('q')} select {_AVERAGES} from rep", ("v_carto",))
def logits_report(t):
    from labelforge.functions.arrays import argmax

    names = F.array(*[F.lit(x) for x in "abcd"])
    last = t.v_carto.filter("epoch = 4").select(F.get(names, F.col("label")).alias("y_true"), F.get(names, argmax("logits")).alias("y_pred"))
    return rounded(op.averages(op.classification_report(last)), *_MEANS)


@query("sigmoid_report", """with s as (select doc_id, unnest(['a','b','c','d']) as label, unnest(list_transform(logits, lambda x: 1 / (1 + exp(-(x - 2.5::DOUBLE))) > 0.5::DOUBLE)) as said, ['a','b','c','d'][label + 1] as gold, epoch from v_carto),
m as (select epoch, label, count(*) filter (said and gold = label) as tp, count(*) filter (gold = label) as support, count(*) filter (said) as predicted from s group by epoch, label)
select epoch, label, tp, support, predicted, round(case when predicted > 0 then tp / predicted else 0 end, 6) as precision, round(case when support > 0 then tp / support else 0 end, 6) as recall, round(case when support + predicted > 0 then 2 * tp / (support + predicted) else 0 end, 6) as f1 from m""", ("v_carto",))
def sigmoid_report(t):
    from labelforge.functions.arrays import sigmoid_flags

    names = F.array(*[F.lit(x) for x in "abcd"])
    flags = sigmoid_flags(F.transform("logits", lambda x: x - 2.5))
    said = F.transform(F.filter(F.arrays_zip(names.alias("n"), flags.alias("f")), lambda z: z["f"] == 1), lambda z: z["n"])
    rows = t.v_carto.select("epoch", F.array(F.get(names, F.col("label"))).alias("y_true"), said.alias("y_pred"))
    classes = t.spark.createDataFrame([(x,) for x in "abcd"], "label string")
    epochs = [r[0] for r in rows.select("epoch").distinct().orderBy("epoch").collect()]  # the epochs of one training run
    parts = [op.multilabel_report(rows.filter(F.col("epoch") == e), classes=classes).withColumn("epoch", F.lit(e)) for e in epochs]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), "precision", "recall", "f1")


@query("confusion_matrix", f"""with {_cells('v_pred')}, l as (select distinct label from rep) select a.label as y_true, b.label as y_pred, coalesce(n, 0) as n,
 round(case when sum(n) over (partition by a.label) > 0 then round_even(coalesce(n, 0) / sum(n) over (partition by a.label), 2) else 0 end, 6) as share from l a cross join l b left join cells on y_true = a.label and y_pred = b.label""", ("v_pred",))
def confusion_matrix(t):
    return op.confusion_matrix(t.v_pred)


_NAMED = f"""q as (select case y_true {' '.join(f"when '{a}' then '{b}'" for a, b in READABLE.items())} end as y_true, case y_pred {' '.join(f"when '{a}' then '{b}'" for a, b in READABLE.items())} end as y_pred from v_pred)"""


def _named(t):
    table = F.create_map(*[F.lit(x) for pair in READABLE.items() for x in pair])
    return t.v_pred.select(table[F.col("y_true")].alias("y_true"), table[F.col("y_pred")].alias("y_pred"))


@query("confusion_by_category", f"with {_NAMED} select string_split(y_true, ',')[1] as y_true, string_split(coalesce(y_pred, '<unparsed>'), ',')[1] as y_pred, count(*) as n from q group by all", ("v_pred",))
def confusion_by_category(t):
    return op.confusion_by_category(_named(t))


@query("category_ranges", f"with {_NAMED}, l as (select distinct y_true as label, string_split(y_true, ',')[1] as category from q), i as (select *, row_number() over (order by category, label) - 1 as i from l) select category, min(i)::INTEGER as first, max(i)::INTEGER as last from i group by 1", ("v_pred",))
def category_ranges(t):
    return op.category_ranges(_named(t).select(F.col("y_true").alias("label")).distinct())


@query("slices_by_source", f"with {_cells('v_pred', 'source')} select source, sum(support)::BIGINT as size, round(avg(f), 6) as macro_f1, round(coalesce(max(p) filter (label = 'fr'), 0), 6) as precision, round(coalesce(max(r) filter (label = 'fr'), 0), 6) as recall from rep group by source", ("v_pred",))
def slices_by_source(t):
    return rounded(op.slices(t.v_pred, "source", "fr"), "macro_f1", "precision", "recall")


@query("replace_unknown", "with m as (select y_true as mode from v_pred group by 1 order by count(*) desc, 1 limit 1) select doc_id, case when y_pred in (select y_true from v_pred) then y_pred else mode end as y_pred from v_pred, m", ("v_pred",))
def replace_unknown(t):
    return op.replace_unknown(t.v_pred).select("doc_id", "y_pred")


_DRAW = lambda draws: f"""o as (select y_true, y_pred, n, sum(n) over (order by y_true, y_pred) as hi from c), tot as (select sum(n)::BIGINT as total from c),
d as (select draw, i, {sql_hash_int('draw', 'i')} % total as row from tot, range({draws}) a(draw), range(0, (select total from tot)) b(i)),
e as (select draw, y_true, y_pred, count(*) as n from d join o on row < hi and row >= hi - o.n group by all),
sides as (select draw, y_true as label, case when y_true = y_pred then n else 0 end as tp, n as support, 0 as predicted from e union all select draw, y_pred, 0, 0, n from e),
sums as (select draw, label, sum(tp) as tp, sum(support) as support, sum(predicted) as predicted from sides group by all),
f as (select draw, avg(2 * tp / (support + predicted)::DOUBLE) as macro_f1 from sums group by draw having count(*) filter (support > 0) > 1)"""


@query("bootstrap_f1", f"""with c as (select y_true, coalesce(y_pred, '<unparsed>') as y_pred, count(*) as n from v_pred group by all), {_DRAW(1000)}
select round(quantile_cont(macro_f1, 0.025), 6) as lower, round(quantile_cont(macro_f1, 0.975), 6) as upper, count(*) as draws from f""", ("v_pred",))
def bootstrap_f1(t):
    return rounded(op.bootstrap_f1(t.v_pred), "lower", "upper")


@query("bootstrap_f1_multinomial")
def bootstrap_f1_multinomial(t):
    """The way of large tables: cell counts of a draw at once. Checked against the hashed draws in the tests."""
    return rounded(op.bootstrap_f1(t.v_pred, method="multinomial"), "lower", "upper")


@query("bootstrap_multilabel_f1", f"""with w as (select y_true as t, y_pred as p, draw, len(list_filter({op.poisson_steps()}::DOUBLE[], lambda x: x <= {sql_hash_int('draw', 'doc_id')} / 4294967296.0::DOUBLE)) as w
 from v_multi_pred cross join range({op.N_DRAWS_MULTILABEL}) r(draw)), l as (select draw, w, t, p, unnest(list_distinct(list_concat(t, p))) as label from w where w > 0),
m as (select draw, label, sum(case when list_contains(t, label) and list_contains(p, label) then w else 0 end) as tp, sum(case when list_contains(t, label) then w else 0 end) as support, sum(case when list_contains(p, label) then w else 0 end) as predicted from l group by all),
f as (select draw, sum(2 * tp / (support + predicted)::DOUBLE) / (select count(distinct label) from (select unnest(list_concat(y_true, y_pred)) as label from v_multi_pred)) as f
 from m where draw in (select draw from w where w > 0 group by draw having count(distinct list_sort(t)::VARCHAR) > 1) group by draw)
select round(quantile_cont(f, 0.025), 6) as lower, round(quantile_cont(f, 0.975), 6) as upper, count(*) as draws from f""", ("v_multi_pred",))
def bootstrap_multilabel_f1(t):
    return rounded(op.bootstrap_multilabel_f1(t.v_multi_pred, "doc_id"), "lower", "upper")


@query("result_row", f"""with {_cells('v_pred').replace('sides as', 'sides0 as').replace('from sides ', 'from sides0 ').replace('sums as', 'sums0 as').replace('from sums)', 'from sums0)')},
c as (select * from cells), {_DRAW(100)}, ci as (select quantile_cont(macro_f1, 0.025) as lower, quantile_cont(macro_f1, 0.975) as upper from f)
select 'documents' as dataset_name, 'noisy' as model_type, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(rep.f), 6) as performance, 'f1_score' as performance_type, 4 as n_labels, 42 as seed,
 round(max(upper), 6) as f1_upper, round(max(lower), 6) as f1_lower, round(sum(rep.f * support) / sum(support), 6) as weighted_f1, round(sum(tp) / sum(support), 6) as accuracy from rep, ci""", ("v_pred",))
def result_row(t):
    row = op.result_row(t.v_pred, "documents", "noisy", 4, draws=100).drop("n_epoch")
    return rounded(row, "performance", "f1_upper", "f1_lower", "precision", "recall", "weighted_f1", "accuracy")


@query("cohen_kappa", """with p as (select worker_0 as a, worker_1 as b from v_votes where worker_0 is not null and worker_1 is not null and worker_0 in ('de', 'en', 'fr') and worker_1 in ('de', 'en', 'fr')),
o as (select count(*) as n, avg((a = b)::INTEGER) as observed from p), ma as (select a as l, count(*) as na from p group by 1), mb as (select b as l, count(*) as nb from p group by 1),
e as (select sum(na * nb)::DOUBLE as s from ma join mb using (l)) select n, round(observed, 6) as observed, round(s / (n * n), 6) as chance, round((observed - s / (n * n)) / (1 - s / (n * n)), 6) as kappa from o, e""", ("v_votes",))
def cohen_kappa(t):
    return rounded(op.cohen_kappa(t.v_votes, "worker_0", "worker_1", ["de", "en", "fr"]), "observed", "chance", "kappa")


_HUMAN = f"h as (select * from v_votes_long where annotator in ({', '.join(repr(w) for w in HUMANS)}))"


@query("annotator_f1", f"with {_HUMAN}, {_cells('h', 'annotator', pred='vote')} select annotator, round(avg(f), 6) as macro_f1, sum(support)::BIGINT as n from rep group by annotator", ("v_votes_long",))
def annotator_f1(t):
    return rounded(op.annotator_f1(t.v_votes.select("doc_id", "y_true", *HUMANS), HUMANS, key=["doc_id"]), "macro_f1")


@query("human_baseline", f"""with {_HUMAN}, {_cells('h', 'annotator', pred='vote')}, a as (select annotator, avg(f) as f from rep group by annotator), s as (select avg(f) as mean, stddev_samp(f) as std, count(*) as n from a)
select round(mean, 6) as mean, round(std, 6) as std, n, round(std / sqrt(n), 6) as sem, round(mean - 1.959963984540054::DOUBLE * std / sqrt(n), 6) as lower, round(mean + 1.959963984540054::DOUBLE * std / sqrt(n), 6) as upper from s""", ("v_votes_long",))
def human_baseline(t):
    scores = op.annotator_f1(t.v_votes.select("doc_id", "y_true", *HUMANS), HUMANS, key=["doc_id"])
    return rounded(mean_interval(scores, "macro_f1"), "mean", "std", "sem", "lower", "upper")


_V = """case when bool_or(label = 'SUPPORTS') and bool_or(label = 'REFUTES') then 'DISPUTED' when bool_or(label = 'SUPPORTS') then 'SUPPORTS' when bool_or(label = 'REFUTES') then 'REFUTES' else 'NOT_ENOUGH_INFO' end"""


@query("claim_level_report", f"with q as (select claim_id, claim_label as y_true, {_V} as y_pred from v_claims group by all), {_cells('q')} select {_AVERAGES} from rep", ("v_claims",))
def claim_level_report(t):
    verdicts = claim_verdict(t.v_claims, ["claim_id", "claim_label"], name="y_pred").withColumnRenamed("claim_label", "y_true")
    return rounded(op.averages(op.classification_report(verdicts)), *_MEANS)


_GRID = f"""q as (select distinct source as candidate from documents),
g as (select doc_id, source as query, candidate, {sql_hash_int('doc_id', 'candidate', seed='gl')} % 3 = 0 as pos, ({sql_hash_int('doc_id', 'candidate', seed='gs')} % 1000) / 1000.0::DOUBLE as s from documents cross join q),
p as (select *, case when pos then s else 1 - s end as score from g),
r as (select doc_id, query, candidate, row_number() over (partition by doc_id order by pos desc, score desc, candidate) as rank from p),
ranks as (select doc_id, rank from r where query = candidate)"""


def _ranks(t):
    grid = ranking.score_grid(t.documents.select("doc_id", F.col("source").alias("query")), t.documents.select(F.col("source").alias("query")))
    scored = grid.withColumn("label", (hash_int("doc_id", "candidate", seed="gl") % 3 == 0).cast("int")).withColumn(
        "score", (hash_int("doc_id", "candidate", seed="gs") % 1000) / F.lit(1000.0)
    )
    return ranking.gold_ranks(scored, "doc_id")


@query("gold_ranks", f"with {_GRID} select * from ranks")
def gold_ranks(t):
    return _ranks(t)


@query("mean_reciprocal_rank", f"with {_GRID} select round(avg(1 / rank), 6) as mrr, count(*) as n from ranks")
def mean_reciprocal_rank(t):
    return rounded(ranking.mean_reciprocal_rank(_ranks(t)), "mrr")


_TRAIN = f"""s as (select doc_id, source, case when u < 0.8::DOUBLE then 'train' when u < 0.9::DOUBLE then 'test' else 'dev' end as split from (select *, {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE as u from documents))"""


def _train_test(t):
    df = hash_bucket_split(t.documents.select("doc_id", F.col("source").alias("query")), "doc_id")
    return df.filter("split = 'train'"), df.filter("split = 'test'")


@query("frequency_mrr", f"with {_TRAIN}, o as (select source, row_number() over (order by count(*) desc, source) as rank from s where split = 'train' group by source) select round(avg(1 / rank), 6) as mrr, count(*) as n from s join o using (source) where split = 'test'")
def frequency_mrr(t):
    train, test = _train_test(t)
    return rounded(ranking.mean_reciprocal_rank(ranking.frequency_ranks(train, test, "doc_id")), "mrr")


@query("random_mrr", f"with {_TRAIN}, k as (select count(distinct source) as k from s where split = 'test') select round(avg(1 / ({sql_hash_int('doc_id')} % k + 1)), 6) as mrr, count(*) as n from s, k where split = 'test'")
def random_mrr(t):
    _, test = _train_test(t)
    return rounded(ranking.mean_reciprocal_rank(ranking.random_ranks(test, "doc_id")), "mrr")


@query("bootstrap_mrr", f"""with {_GRID}, o as (select rank, count(*) as n, sum(count(*)) over (order by rank) as hi from ranks group by rank), tot as (select sum(n)::BIGINT as total from o),
d as (select draw, {sql_hash_int('draw', 'i')} % total as row from tot, range(1000) a(draw), range(0, (select total from tot)) b(i)),
m as (select draw, avg(1 / rank::DOUBLE) as mrr from d join o on row < hi and row >= hi - o.n group by draw)
select round(quantile_cont(mrr, 0.025), 6) as lower, round(quantile_cont(mrr, 0.975), 6) as upper, count(*) as draws from m""")
def bootstrap_mrr(t):
    return rounded(ranking.bootstrap_mrr(_ranks(t)), "lower", "upper")
