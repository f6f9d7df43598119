"""Split, sample and balance queries; the SQL ranks whole groups in hash order."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.operators import splits as op
from labelforge.plans.registry import query, sql_hash, sql_hash_int, sql_rank

_A = "floor(n * (1 - 0.2::DOUBLE))"
_B = f"n - floor((n - {_A}) * 0.5::DOUBLE)"
_SPLIT = f"case when rn <= {_A} then 'train' when rn <= {_B} then 'test' else 'dev' end as split"


def _ranked(view, group, key, lead="", cols="*"):
    return f"(select {cols}, {sql_rank(group, key, lead)} as rn, count(*) over (partition by {group}) as n from {view})"


@query("stratified_split", f"select doc_id, label, {_SPLIT} from {_ranked('v_lang', 'label', 'doc_id')}", ("v_lang",))
def stratified_split(t):
    return op.stratified_split(t.v_lang.select("doc_id", "label"), "doc_id")


@query("carve_dev", f"""with b as (select doc_id, label, case when {sql_hash_int('doc_id', seed='tt')} % 10 < 2 then 'test' else 'train' end as split from v_lang),
r as {_ranked("b where split = 'train'", 'label', 'doc_id')}
select doc_id, label, case when rn <= {_A} then 'train' else 'dev' end as split from r union all select doc_id, label, split from b where split = 'test'""", ("v_lang",))
def carve_dev(t):
    given = F.when(hash_int("doc_id", seed="tt") % 10 < 2, "test").otherwise("train")
    return op.carve_dev(t.v_lang.select("doc_id", "label", given.alias("split")), "doc_id")


@query("held_out_split", f"""with b as (select doc_id, label, {sql_hash_int('doc_id', seed='ho')} % 5 = 0 as held from v_lang),
r as {_ranked("b where not held", 'label', 'doc_id')}
select doc_id, label, case when rn <= floor(n * (1 - 0.1::DOUBLE)) then 'train' else 'dev' end as split from r union all select doc_id, label, 'test' from b where held""", ("v_lang",))
def held_out_split(t):
    df = t.v_lang.select("doc_id", "label", (hash_int("doc_id", seed="ho") % 5 == 0).alias("held"))
    return op.held_out_split(df, "held", "doc_id").drop("held")


@query("claim_level_split", f"""with k as (select distinct claim_id, 1 as one from v_claims), r as {_ranked('k', 'one', 'claim_id')},
s as (select claim_id, {_SPLIT} from r) select o_orderkey, claim_id, label, split from v_claims join s using (claim_id)""", ("v_claims",))
def claim_level_split(t):
    return op.grouped_split(t.v_claims.drop("claim_label"), "claim_id")


@query("evidence_level_split", f"with r as {_ranked('(select *, 1 as one from v_claims)', 'one', 'o_orderkey')} select o_orderkey, claim_id, {_SPLIT} from r", ("v_claims",))
def evidence_level_split(t):
    return op.grouped_split(t.v_claims.select("o_orderkey", "claim_id"), "o_orderkey")


@query("hash_bucket_split", f"""select claim_id, case when u < 0.8::DOUBLE then 'train' when u < 0.9::DOUBLE then 'test' else 'dev' end as split, count(*) as n
 from (select claim_id, {sql_hash_int('claim_id')} / 4294967296.0::DOUBLE as u from v_claims) group by all""", ("v_claims",))
def hash_bucket_split(t):
    return op.hash_bucket_split(t.v_claims.select("claim_id"), "claim_id").groupBy("claim_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("time_split", f"""select o_orderkey, label, {_SPLIT} from {_ranked('v_time', 'label', 'o_orderkey', lead='"Date"::DATE')}""", ("v_time",))
def time_split(t):
    return op.time_split(t.v_time, "o_orderkey").drop("Date")


@query("undersample", f"""with r as {_ranked('v_lang', 'label', 'doc_id')} select doc_id, label from r where rn <= (select min(n) from r)""", ("v_lang",))
def undersample(t):
    return op.undersample(t.v_lang.select("doc_id", "label"), "doc_id")


_WATER = lambda view, n: f"""c as (select label, count(*) as n, row_number() over (order by count(*), label) as i, count(*) over () as m from {view} group by label),
w as (select label, i, m, least(n, {n} // m) as k, {n} - least(n, {n} // m) as rest from c where i = 1
 union all select c.label, c.i, c.m, least(c.n, w.rest // (c.m - c.i + 1)), w.rest - least(c.n, w.rest // (c.m - c.i + 1)) from w join c on c.i = w.i + 1)"""


@query("water_filling_sample", f"""with recursive b as (select doc_id, label from v_lang), {_WATER('b', 500)}, r as {_ranked('b', 'label', 'doc_id')}
select doc_id, label from r join w using (label) where rn <= k""", ("v_lang",))
def water_filling_sample(t):
    return op.water_filling_sample(t.v_lang.select("doc_id", "label"), "doc_id", 500)


_LARGEST = lambda view, size: f"""c as (select label, count(*) as n from {view} group by label), q as (select label, n, n * {size} / sum(n) over ()::DOUBLE as x from c),
f as (select label, n, floor(x) as q, row_number() over (order by round(x - floor(x), 9) desc, label) as i, {size} - sum(floor(x)) over () as short from q),
k as (select label, case when i <= short then q + 1 else q end as k from f)"""


@query("resize", f"with {_LARGEST('v_lang', 300)}, r as {_ranked('v_lang', 'label', 'doc_id')} select doc_id, label from r join k using (label) where rn <= k.k", ("v_lang",))
def resize(t):
    return op.resize(t.v_lang.select("doc_id", "label"), "doc_id", 300)


_BASE = f"b as (select doc_id, label, {_SPLIT} from {_ranked('v_lang', 'label', 'doc_id')})"


def _split_lang(t):
    return op.stratified_split(t.v_lang.select("doc_id", "label"), "doc_id")


def _cut(*parts):
    """Train and dev cut alike, each by its own query, and the other rows as they are."""
    return " union all ".join([*(f"select * from ({p})" for p in parts), "select doc_id, label, split from b where split not in ('train', 'dev')"])


_PART = lambda part: f"one as (select * from b where split = '{part}')"


def _balanced(part):
    return f"with {_PART(part)}, {_LARGEST('one', 60)}, r as {_ranked('one', 'label', 'doc_id')} select doc_id, label, split from r join k using (label) where rn <= k.k"


def _random(part):
    return f"""with {_PART(part)}, u as (select doc_id, label, split from {_ranked('one', 'label', 'doc_id')} r where rn <= (select min(n) from (select count(*) as n from one group by label))),
{_LARGEST('u', 60)}, r as {_ranked('u', 'label', 'doc_id')} select doc_id, label, split from r join k using (label) where rn <= k.k"""


def _weighted(part):
    return f"with recursive {_PART(part)}, {_WATER('one', 60)}, r as {_ranked('one', 'label', 'doc_id')} select doc_id, label, split from r join w using (label) where rn <= k"


@query("truncate_balanced", f"with {_BASE} {_cut(_balanced('train'), _balanced('dev'))}", ("v_lang",))
def truncate_balanced(t):
    return op.truncate(_split_lang(t), "doc_id", 60)


@query("truncate_random", f"with {_BASE} {_cut(_random('train'), _random('dev'))}", ("v_lang",))
def truncate_random(t):
    return op.truncate(_split_lang(t), "doc_id", 60, "random")


@query("truncate_weighted", f"with {_BASE} {_cut(_weighted('train'), _weighted('dev'))}", ("v_lang",))
def truncate_weighted(t):
    return op.truncate(_split_lang(t), "doc_id", 60, "weighted")


@query("downsample_class", f"select o_orderkey, label from (select o_orderkey, label, {sql_rank('label', 'o_orderkey')} as rn from v_claims) where label <> 'NOT_ENOUGH_INFO' or rn <= 1539", ("v_claims",))
def downsample_class(t):
    return op.downsample_class(t.v_claims.select("o_orderkey", "label"), "o_orderkey", *op.EVIDENCE_DOWNSAMPLE)


@query("evaluation_subset", f"""with recursive b as (select o_orderkey, label from v_time), {_WATER('b', 1000)}, r as {_ranked('b', 'label', 'o_orderkey')}
select o_orderkey, label from r join w using (label) where rn <= k""", ("v_time",))
def evaluation_subset(t):
    return op.evaluation_subset(t.v_time.select("o_orderkey", "label"), "o_orderkey")


@query("documents_per_query", f"""with e as (select *, case when {sql_hash_int('document_id', 'query', seed='q')} % 9 = 0 then null else query end as q from v_evid_gold),
p as (select distinct q, document_id from e), c as (select document_id from p qualify row_number() over (partition by q order by {sql_hash('document_id')}, document_id) <= 10)
select document_id, q as query, stance from e where document_id in (select document_id from c)""", ("v_evid_gold",))
def documents_per_query(t):
    query_or_null = F.when(hash_int("document_id", "query", seed="q") % 9 == 0, F.lit(None)).otherwise(F.col("query"))
    return op.sample_documents_per_query(t.v_evid_gold.select("document_id", query_or_null.alias("query"), "stance"))


@query("sample_per_group", f"select doc_id, source from documents qualify {sql_rank('source', 'doc_id')} <= 10")
def sample_per_group(t):
    return op.take_up_to(t.documents.select("doc_id", "source"), ["source"], "doc_id", 10)


@query("first_positives", "select doc_id, label from v_dup where label = 1 order by doc_id limit 100", ("v_dup",))
def first_positives(t):
    return op.head(t.v_dup.select("doc_id", "label").filter("label = 1"), 100, "doc_id")


_DRAWN = f"""p as (select pair_id as id, query, text, sha256(query) as q, sha256(text) as a from v_pairs),
an as (select a, count(*) as n, min(id) as drawn from p group by a),
s as (select *, coalesce(sum(n) over (order by a rows between unbounded preceding and 1 preceding), 0) as start from an),
k as (select q, n, start - coalesce(sum(n) over (partition by q order by start rows between unbounded preceding and 1 preceding), 0) as d from (select distinct q, a from p) join s using (a)),
o as (select q, (select sum(n) from an) - sum(n) as free from k group by q),
r as (select id, p.q, ('0x' || substr({sql_hash('id')}, 1, 15))::BIGINT % free::BIGINT as j from p join o using (q) where free > 0),
h as (select id, j + coalesce(sum(n) filter (d <= j), 0) as pos from r left join k using (q) group by id, j),
w as (select h.id, s.drawn from h asof join s on h.pos >= s.start),
f as (select w.id, p.text as false_answer from w join p on p.id = w.drawn)"""


@query("negative_answers", f"with {_DRAWN} select pair_id, false_answer from v_pairs left join f on id = pair_id", ("v_pairs",))
def negative_answers(t):
    pairs = t.v_pairs.withColumnsRenamed({"query": "question", "text": "answer"})
    return op.negative_answers(pairs, "pair_id").select("pair_id", "false_answer")


@query("answer_pairs", f"with {_DRAWN} select query, text, 1 as label from v_pairs union all select v.query, false_answer, 0 from v_pairs v join f on id = pair_id", ("v_pairs",))
def answer_pairs(t):
    pairs = t.v_pairs.withColumnsRenamed({"query": "question", "text": "answer"})
    return op.stack_answers(op.negative_answers(pairs, "pair_id"), "question", "answer", "false_answer")
