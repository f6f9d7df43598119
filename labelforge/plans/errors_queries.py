"""Error tables, sheets, tags, taxonomy, overlap and agreement queries."""

from pyspark.sql import functions as F

from labelforge.operators import errors as op
from labelforge.operators.metrics import cohen_kappa
from labelforge.plans.registry import query, sql_rank, sql_strip

_WRONG = "y_pred is distinct from y_true"


@query("error_rows", f"select doc_id, y_true, y_pred from v_pred where {_WRONG}", ("v_pred",))
def error_rows(t):
    return op.error_rows(t.v_pred).select("doc_id", "y_true", "y_pred")


@query("error_sheets", f"""with e as (select doc_id, y_true, y_pred, case y_pred when 'en' then 'fn' when 'fr' then 'fp' end as side from v_pred where {_WRONG})
select doc_id, case y_true when 'de' then 'German' when 'es' then 'Spanish' else y_true end as label, y_pred, side, '' as comment from e where side is not null qualify {sql_rank('side', 'doc_id')} <= 10""", ("v_pred",))
def error_sheets(t):
    readable = t.spark.createDataFrame([("de", "German"), ("es", "Spanish")], "key string, value string")
    df = t.v_pred.select("doc_id", F.col("y_true").alias("label"), "y_pred")
    return op.error_sheets(df, "doc_id", "en", "fr", readable)


_TAGS = lambda c: f"list_transform(string_split(string_split({c}, ':')[1], ','), lambda x: {sql_strip('x')})"


@query("tag_counts", f"""with g as (select dataset, doc_id, unnest(list_distinct({_TAGS('comment')})) as tag from v_sheets), t as (select dataset, count(*) as total from v_sheets group by 1)
select g.dataset, tag, count(*) as n, total, round(count(*) / total, 6) as share from g join t on g.dataset = t.dataset group by g.dataset, tag, total""", ("v_sheets",))
def tag_counts(t):
    return op.tag_counts(t.v_sheets, ["dataset"]).withColumn("share", F.round("share", 6))


def _class(comment, names, default):
    has = lambda wanted: f"list_has_any({_TAGS(comment)}, [{', '.join(repr(w) for w in wanted)}])"
    return f"""case when {has(op.MISLABELED_TAGS)} then '{names[0]}' when {has(op.ACTUAL_TAGS)} then '{names[1]}' when {has(op.MULTI_TAGS)} then '{names[2]}' when {has(op.DEBATABLE_TAGS)} then '{names[3]}' else {default} end"""


_LONG = ("Mislabeled", "Actual Error", "Multilabel", "Debatable Error")
_SHORT = ("wrong", "error", "multi", "debatable")


@query("error_taxonomy", f"select doc_id, error from (select doc_id, {_class('comment', _LONG, 'null')} as error from v_sheets) where error is not null", ("v_sheets",))
def error_taxonomy(t):
    return op.taxonomy(t.v_sheets).select("doc_id", "error")


@query("relaxed_classes", f"select doc_id, {_class('comment', _SHORT, repr('debatable'))} as error_type from v_sheets", ("v_sheets",))
def relaxed_classes(t):
    return op.relaxed_class(t.v_sheets).select("doc_id", "error_type")


@query("taxonomy_counts", f"""with c as (select dataset, {_class('comment', _LONG, 'null')} as error from v_sheets), n as (select source as dataset, count(*) as errors from documents group by 1),
w as (select dataset, count(*) filter (error = 'Actual Error') as actual_error, count(*) filter (error = 'Debatable Error') as debatable_error, count(*) filter (error = 'Mislabeled') as mislabeled, count(*) filter (error = 'Multilabel') as multilabel from c where error is not null group by 1)
select w.*, errors - actual_error - debatable_error - mislabeled - multilabel as not_annotated, errors as total from w left join n using (dataset)""", ("v_sheets",))
def taxonomy_counts(t):
    totals = t.documents.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("errors"))
    return op.taxonomy_counts(op.taxonomy(t.v_sheets), totals)


@query("collect_sheets", """select comment, string_split(f, '_f')[1] as dataset from (select comment, dataset || case doc_id % 5 when 0 then '_old' else '' end || case when doc_id % 2 = 0 then '_fn.json' else '_fp.json' end as f from v_sheets) where f not like '%_old%'""", ("v_sheets",))
def collect_sheets(t):
    old = F.when(F.col("doc_id") % 5 == 0, "_old").otherwise("")
    name = F.concat("dataset", old, F.when(F.col("doc_id") % 2 == 0, "_fn.json").otherwise("_fp.json"))
    return op.collect_sheets(t.v_sheets.select("comment", name.alias("file_name")))


@query("annotator_pairs", f"select doc_id, {_class('comment', _SHORT, repr('debatable'))} as error_type_1, case when doc_id % 3 > 0 then {_class('comment_b', _SHORT, repr('debatable'))} end as error_type_2 from v_sheets", ("v_sheets",))
def annotator_pairs(t):
    return _pairs(t)


def _pairs(t):
    first = op.relaxed_class(t.v_sheets)
    second = op.relaxed_class(t.v_sheets.filter("doc_id % 3 > 0"), "comment_b")
    return op.annotator_pairs(first, second, ["doc_id"])


@query("error_kappa", f"""with p as (select {_class('comment', _SHORT, repr('debatable'))} as a, {_class('comment_b', _SHORT, repr('debatable'))} as b from v_sheets where doc_id % 3 > 0),
o as (select count(*) as n, avg((a = b)::INTEGER) as observed from p), ma as (select a as l, count(*) as na from p group by 1), mb as (select b as l, count(*) as nb from p group by 1),
e as (select sum(na * nb)::DOUBLE as s from ma join mb using (l)) select n, round(observed, 6) as observed, round(s / (n * n), 6) as chance, round((observed - s / (n * n)) / (1 - s / (n * n)), 6) as kappa from o, e""", ("v_sheets",))
def error_kappa(t):
    out = cohen_kappa(_pairs(t), "error_type_1", "error_type_2", list(_SHORT))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "chance", "kappa")])


def _error(view):
    return f"(select doc_id, source from {view} where {_WRONG})"


@query("shared_error_rate", f"""select round_even(100.0::DOUBLE * (select count(*) from {_error('v_pred')}) / (select count(*) from v_pred), 2) as error_a, round_even(100.0::DOUBLE * (select count(*) from {_error('v_pred2')}) / (select count(*) from v_pred2), 2) as error_b,
 round_even(100.0::DOUBLE * (select count(*) from {_error('v_pred')} a join {_error('v_pred2')} b using (doc_id)) / (select count(*) from {_error('v_pred')} a full join {_error('v_pred2')} b using (doc_id)), 2) as common""", ("v_pred", "v_pred2"))
def shared_error_rate(t):
    n = F.lit(t.v_pred.count())
    return op.shared_errors(op.error_rows(t.v_pred), op.error_rows(t.v_pred_of("p2")), ["doc_id"], n, n)


@query("shared_error_pairs", f"""select round_even(100.0::DOUBLE * (select count(*) from {_error('v_pred')}) / (select count(*) from v_pred), 2) as error_a, round_even(100.0::DOUBLE * (select count(*) from {_error('v_pred2')}) / (select count(*) from v_pred2), 2) as error_b,
 round_even(100.0::DOUBLE * (select count(*) from {_error('v_pred')} a join {_error('v_pred2')} b using (source)) / (select count(*) from {_error('v_pred')} a full join {_error('v_pred2')} b using (source)), 2) as common""", ("v_pred", "v_pred2"))
def shared_error_pairs(t):
    n = F.lit(t.v_pred.count())
    return op.shared_errors(op.error_rows(t.v_pred), op.error_rows(t.v_pred_of("p2")), ["source"], n, n, mode="pairs")


def _models(t):
    parts = [t.v_pred_of(s).select("doc_id", "source", F.lit(m).alias("model"), (~F.col("y_pred").eqNullSafe(F.col("y_true"))).alias("wrong")) for m, s in (("a", "p1"), ("b", "p2"), ("c", "p3"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_WIDE = f"w as (select a.doc_id, a.source, a.{_WRONG.replace('y_true', 'a.y_true')} as a, b.{_WRONG.replace('y_true', 'b.y_true')} as b, c.{_WRONG.replace('y_true', 'c.y_true')} as c from v_pred a join v_pred2 b using (doc_id) join v_pred3 c using (doc_id))"
_P = lambda x: f"round_even(100.0::DOUBLE * {x}, 2)"
_C = lambda x: f"count(*) filter ({x})"


@query("error_rates", f"""with {_WIDE} select source, {', '.join(f"{_P(f'{_C(m)} / count(*)')} as {m}_error" for m in 'abc')}, {', '.join(f"{_P(f'{_C(f'a and {m}')} / {_C(f'a or {m}')}')} as a_{m}_common" for m in 'bc')} from w group by source""", ("v_pred", "v_pred2", "v_pred3"))
def error_rates(t):
    return op.error_rates(_models(t), ["doc_id"], "source", ["a", "b", "c"])


@query("error_overlap", f"""with {_WIDE}, x as (select *, doc_id % 4 = 0 and a as marked from w) select source, {_C('marked')} as annotated, {_C('a')} as a_errors, {', '.join(f"{_C(m)} as {m}_errors, {_C(f'{m} and a')} as {m}_common, {_C(f'{m} and marked')} as {m}_annotated" for m in 'bc')} from x group by rollup (source)""", ("v_pred", "v_pred2", "v_pred3"))
def error_overlap(t):
    marked = op.error_rows(t.v_pred).filter("doc_id % 4 = 0").select("source", "doc_id")
    return op.error_overlap(_models(t), marked, ["doc_id"], "source", "a", ["b", "c"])


@query("prompt_comparison", f"""with a as (select source, y_true from v_pred where {_WRONG}), b as (select source, y_true from v_pred2 where {_WRONG}), ca as (select source, y_true, count(*) as a from a group by all), cb as (select source, y_true, count(*) as b from b group by all)
select coalesce(sum(a) filter (b is null), 0)::BIGINT as fixed_by_second, coalesce(sum(b) filter (a is null), 0)::BIGINT as broken_by_second, coalesce(sum(a * b), 0)::BIGINT as in_both from ca full join cb using (source, y_true)""", ("v_pred", "v_pred2"))
def prompt_comparison(t):
    return op.prompt_comparison(op.error_rows(t.v_pred), op.error_rows(t.v_pred_of("p2")), ["source", "y_true"])
