"""Size, distribution, noise, weight and chance-level queries."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.functions.text import count_tokens
from labelforge.operators import stats as op
from labelforge.operators.splits import hash_bucket_split
from labelforge.plans.registry import query, sql_hash_int, sql_tokens

_S = f"""s as (select *, case when u < 0.8::DOUBLE then 'train' when u < 0.9::DOUBLE then 'test' else 'dev' end as split from (select *, {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE as u from documents))"""


def _split(t):
    return hash_bucket_split(t.documents, "doc_id")


_COUNTS = "count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) filter (split = 'dev') as dev"


@query("sizes", f"with {_S} select source as dataset, {_COUNTS}, count(*) as total from s group by rollup (source)")
def sizes(t):
    return op.sizes(_split(t).select(F.col("source").alias("dataset"), "split"))


@query("sizes_and_longest", f"with {_S} select source as dataset, {_COUNTS}, max({sql_tokens('text')}) as max_tokens from s group by source")
def sizes_and_longest(t):
    return op.sizes_and_longest(_split(t).select(F.col("source").alias("dataset"), "split", count_tokens("text").alias("token_counts")))


_SHARES = f"""{_S}, c as (select lang as label, {_COUNTS} from s group by lang),
sh as (select label, train / sum(train) over () as train, test / sum(test) over () as test, dev / sum(dev) over () as dev from c)"""


@query("label_shares", f"with {_SHARES} select label, round(train, 6) as train, round(test, 6) as test, round(dev, 6) as dev from sh")
def label_shares(t):
    shares = op.label_shares(_split(t).select(F.col("lang").alias("label"), "split"))
    return shares.select("label", *[F.round(c, 6).alias(c) for c in op.SPLITS])


@query("chance_f1", f"""with {_SHARES}, k as (select count(*) as k from sh), m as (select test as d from sh order by train desc, label limit 1)
select round((select sum(2 * test / (test * k + 1)) / max(k) from sh, k), 6) as uniform, round(2 * d / (1 + d) / k, 6) as majority from m, k""")
def chance_f1(t):
    shares = op.label_shares(_split(t).select(F.col("lang").alias("label"), "split"))
    return op.chance_f1(shares).select(F.round("uniform", 6).alias("uniform"), F.round("majority", 6).alias("majority"))


@query("imbalance", "with c as (select source, lang, count(*) as n from documents group by all) select source, round(max(n) / min(n), 6) as imbalance, count(*) as n_labels from c group by source")
def imbalance(t):
    return op.imbalance(t.documents, "lang", ["source"]).withColumn("imbalance", F.round("imbalance", 6))


@query("imbalance_multilabel", "with e as (select unnest(case when len(label) = 0 then [null] else label end) as label from v_multi), c as (select label, count(*) as n from e group by label) select round(max(n) / min(n), 6) as imbalance, count(*) as n_labels from c", ("v_multi",))
def imbalance_multilabel(t):
    return op.imbalance_multilabel(t.v_multi).withColumn("imbalance", F.round("imbalance", 6))


@query("noise_report", f"""with n as (select source, lang as language, case {sql_hash_int('doc_id', seed='gi')} % 8 when 0 then 'noise' when 1 then 'word salad' when 2 then 'mild gibberish' else 'clean' end as g from documents)
select source, round_even(100 * avg(case when language <> 'en' then 1.0::DOUBLE else 0 end), 2) as not_english, round_even(100 * avg(case when g <> 'clean' then 1.0::DOUBLE else 0 end), 2) as not_clean,
 round_even(100 * avg(case when g = 'noise' then 1.0::DOUBLE else 0 end), 2) as noise, round_even(100 * avg(case when g = 'word salad' then 1.0::DOUBLE else 0 end), 2) as word_salad from n group by source""")
def noise_report(t):
    h = hash_int("doc_id", seed="gi") % 8
    kind = F.when(h == 0, "noise").when(h == 1, "word salad").when(h == 2, "mild gibberish").otherwise("clean")
    return op.noise_report(t.documents.select("source", F.col("lang").alias("language"), kind.alias("gibberish")), ["source"])


@query("value_counts", "select lang, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by lang")
def value_counts(t):
    return op.value_counts(t.documents, "lang").withColumn("share", F.round("share", 6))


_YEARS = """c as (select year("Date")::INTEGER as year, label, count(*) as n from v_time group by all), s as (select *, n / sum(n) over (partition by year) as share from c),
r as (select *, sum(share) over (partition by year order by label) as cumulative from s)"""


@query("labels_by_year", f"with {_YEARS} select year, label, n, round(share, 6) as share, round(cumulative, 6) as cumulative from r", ("v_time",))
def labels_by_year(t):
    return op.labels_by_year(t.v_time).select("year", "label", "n", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("peak_years", f"with {_YEARS} select label, year, round(share, 6) as share, round(cumulative - share / 2, 6) as middle from r qualify row_number() over (partition by label order by share desc, year) = 1", ("v_time",))
def peak_years(t):
    peaks = op.peak_years(op.labels_by_year(t.v_time))
    return peaks.select("label", "year", F.round("share", 6).alias("share"), F.round("middle", 6).alias("middle"))


@query("page_detection", f"select doc_id, page_number, (sum(case when {sql_hash_int('doc_id', 'pos', seed='y')} % 3 = 0 then 1 else 0 end) > 1)::INTEGER as detected from v_para group by all", ("v_para",))
def page_detection(t):
    rows = t.v_para.select("doc_id", "page_number", (hash_int("doc_id", "pos", seed="y") % 3 == 0).cast("int").alias("y"))
    return op.page_detection(rows, ["doc_id", "page_number"])


@query("class_weights", """with c as (select label, count(*) as n from v_lang group by label), w as (select label, n, sum(n) over () / (count(*) over () * n) as weight from c)
select label, n, round(weight, 6) as weight, round(weight / sum(weight) over (), 6) as normalised from w""", ("v_lang",))
def class_weights(t):
    return op.class_weights(t.v_lang).select("label", "n", F.round("weight", 6).alias("weight"), F.round("normalised", 6).alias("normalised"))


@query("multilabel_weights", """with c as (select unnest(label) as label, count(*) as n from v_multi group by 1)
select label, n, round(max(n) over () / n, 6) as weight from c union all select 'absent', 0, 0.0""", ("v_multi",))
def multilabel_weights(t):
    return op.multilabel_weights(t.v_multi, classes=["quality", "toxic", "long", "absent"]).withColumn("weight", F.round("weight", 6))


@query("most_frequent_label", "select source, lang as mode from (select source, lang, count(*) as n from documents group by all) qualify row_number() over (partition by source order by n desc, lang) = 1")
def most_frequent_label(t):
    return op.most_frequent(t.documents, "lang", ["source"])


@query("mean_interval", """with s as (select o_orderpriority, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as std, count(*) as n from orders group by 1)
select o_orderpriority, round(mean, 4) as mean, round(std, 4) as std, n, round(std / sqrt(n), 4) as sem, round(mean - 1.959963984540054::DOUBLE * std / sqrt(n), 4) as lower, round(mean + 1.959963984540054::DOUBLE * std / sqrt(n), 4) as upper from s""")
def mean_interval(t):
    out = op.mean_interval(t.orders, "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "sem", "lower", "upper")])
