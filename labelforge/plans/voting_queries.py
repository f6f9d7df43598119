"""Consensus, voting and cascade queries."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.operators import nested, voting as op
from labelforge.plans.registry import query, sql_hash_int

WORKERS = [f"worker_{k}" for k in range(8)]
TASKS = ["climate_detection", "climatext", "climateBUG_data", "sustainable_signals_review"]  # fixed values: task names
POSITIVE = {"climate_detection": "yes", "climatext": "1", "climateBUG_data": "climate", "sustainable_signals_review": "Relevant"}
NEGATIVE = {"climate_detection": "no", "climatext": "0", "climateBUG_data": "non-climate", "sustainable_signals_review": "Irrelevant"}


@query("annotator_consensus", """select doc_id, vote as label from (select doc_id, vote, count(*) as n from v_votes_long group by all) qualify row_number() over (partition by doc_id order by n desc, vote) = 1
union all select doc_id, null from v_votes where doc_id not in (select doc_id from v_votes_long)""", ("v_votes_long",))
def annotator_consensus(t):
    return op.consensus(t.v_votes, WORKERS).select("doc_id", "label")


_VERDICT = """case when bool_or(label = 'SUPPORTS') and bool_or(label = 'REFUTES') then 'DISPUTED' when bool_or(label = 'SUPPORTS') then 'SUPPORTS'
 when bool_or(label = 'REFUTES') then 'REFUTES' else 'NOT_ENOUGH_INFO' end"""


@query("claim_verdict", f"select claim_id, claim_label, {_VERDICT} as verdict from v_claims group by all", ("v_claims",))
def claim_verdict(t):
    return op.claim_verdict(t.v_claims, ["claim_id", "claim_label"])


def task_predictions(t):
    """One row per document and classifier."""
    task = F.explode(F.array(*[F.lit(x) for x in TASKS])).alias("task")
    rows = t.documents.select("doc_id", task)
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("task")]
    return rows.withColumn("y_pred", F.when(hash_int("doc_id", "task", seed="tp") % 2 == 0, table(POSITIVE)).otherwise(table(NEGATIVE)))


def _positives(t):
    return t.spark.createDataFrame(list(POSITIVE.items()), "task string, positive string")


_P = f"""p as (select doc_id, task, {sql_hash_int('doc_id', 'task', seed='tp')} % 2 = 0 as hit from documents cross join (select unnest([{', '.join(repr(x) for x in TASKS)}]) as task))"""


@query("vote_majority", f"with {_P} select doc_id, (count(*) filter (hit) > count(*) filter (not hit))::INTEGER as vote from p group by 1")
def vote_majority(t):
    flags = op.positive_flags(task_predictions(t), _positives(t))
    return op.vote(flags, "doc_id", "majority").withColumn("vote", F.col("vote").cast("int"))


@query("vote_any", f"with {_P} select doc_id, bool_or(hit)::INTEGER as vote from p group by 1")
def vote_any(t):
    flags = op.positive_flags(task_predictions(t), _positives(t))
    return op.vote(flags, "doc_id", "any").withColumn("vote", F.col("vote").cast("int"))


@query("vote_list", f"with {_P} select doc_id, string_agg(case when hit then 'true' else 'false' end, ',' order by task) as vote from p group by 1")
def vote_list(t):
    flags = op.positive_flags(task_predictions(t), _positives(t))
    return op.vote(flags, "doc_id", "list").withColumn("vote", F.array_join(F.transform("vote", lambda v: v.cast("string")), ","))


@query("stance_majority", f"""with p as (select doc_id, k, (['Support', 'Denies', 'Neutral'])[({sql_hash_int('doc_id', 'k', seed='sv')} % 3) + 1] as stance from documents cross join range(2) r(k)),
c as (select doc_id, count(*) filter (stance = 'Support') as s, count(*) filter (stance = 'Denies') as d, count(*) filter (stance = 'Neutral') as n from p group by 1)
select doc_id, case when s > d and s > n then 'Support' when d > s and d > n then 'Denies' else 'Neutral' end as stance from c""")
def stance_majority(t):
    names = {"0": ("climateStance", ["1", "2", "0"]), "1": ("gw_stance_detection", ["agrees", "disagrees", "neutral"])}
    rows = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    h = (hash_int("doc_id", "k", seed="sv") % 3).cast("int")
    task = F.when(F.col("k") == 0, names["0"][0]).otherwise(names["1"][0])
    label = F.when(F.col("k") == 0, F.get(F.array(*[F.lit(x) for x in names["0"][1]]), h)).otherwise(F.get(F.array(*[F.lit(x) for x in names["1"][1]]), h))
    stances = [(n, v, s) for n, values in names.values() for v, s in zip(values, ["Support", "Denies", "Neutral"])]
    table = t.spark.createDataFrame(stances, "task string, y_pred string, stance string")
    return op.stance_vote(rows.select("doc_id", task.alias("task"), label.alias("y_pred")), "doc_id", table)


@query("label_columns", f"""with {_P} select doc_id, {', '.join(f"max(case when task = '{x}' then case when hit then '{'Climate' if x == 'climatext' else POSITIVE[x]}' else '{NEGATIVE[x]}' end end) as {x}" for x in TASKS)} from p group by 1""")
def label_columns(t):
    readable = t.spark.createDataFrame([("climatext", "1", "Climate")], "task string, y_pred string, value string")
    return op.label_columns(task_predictions(t), "doc_id", TASKS, readable)


def cascaded(t):
    """Pages of documents through page, query and stance predictions."""
    pages = t.v_para.select("doc_id", "page_number").distinct().withColumn("key", F.col("doc_id") * 10000 + F.col("page_number"))
    names = ["carbon_tax", "land_use", "renewable_energy"]  # fixed values: query names
    queries = F.filter(F.array(*[F.lit(n) for n in names]), lambda q: hash_int("key", q, seed="cq") % 2 == 0)
    flagged = pages.withColumn("hit", hash_int("key", seed="cp") % 3 == 0).withColumn("queries", queries)
    stance = flagged.filter("hit").select("key", F.explode("queries").alias("query")).withColumn(
        "stance", F.get(F.array(F.lit("supporting"), F.lit("opposing")), (hash_int("key", "query", seed="cs") % 2).cast("int"))
    )
    return op.cascade(flagged, "key", "hit", "queries", stance)


_CASCADE = f"""p as (select distinct doc_id * 10000 + page_number as key from v_para), q as (select key, query, (['supporting', 'opposing'])[({sql_hash_int('key', 'query', seed='cs')} % 2) + 1] as stance
 from p cross join (select unnest(['carbon_tax', 'land_use', 'renewable_energy']) as query) where {sql_hash_int('key', seed='cp')} % 3 = 0 and {sql_hash_int('key', 'query', seed='cq')} % 2 = 0)"""


@query("policy_cascade", f"""with {_CASCADE} select p.key, ({sql_hash_int('p.key', seed='cp')} % 3 = 0)::INTEGER as label, case when {sql_hash_int('p.key', seed='cp')} % 3 = 0 then coalesce(string_agg(query, '|' order by query), '') end as queries,
 case when {sql_hash_int('p.key', seed='cp')} % 3 = 0 then coalesce(string_agg(stance, '|' order by query), '') end as stances from p left join q on p.key = q.key group by p.key""", ("v_para",))
def policy_cascade(t):
    return cascaded(t).select("key", "label", F.array_join("queries", "|").alias("queries"), F.array_join("stances", "|").alias("stances"))


@query("cascade_documents", f"""with {_CASCADE}, g as (select key // 10000 as document_id, query, stance, list_sort(list(key % 10000)) as pages from q group by all)
select document_id, string_agg(query || ':' || stance || ':' || array_to_string(pages, ','), ';' order by query, stance) as evidences from g group by 1""", ("v_para",))
def cascade_documents(t):
    c = cascaded(t).withColumn("document", F.floor(F.col("key") / 10000)).withColumn("page", (F.col("key") % 10000).cast("int"))
    docs = nested.nest_evidences(op.cascade_triplets(c.filter(F.col("queries").isNotNull()), "document", "page"))
    one = lambda e: F.concat_ws(":", e["query"], e["stance"], F.array_join(e["page_indices"], ","))
    return docs.select("document_id", F.array_join(F.transform("evidences", one), ";").alias("evidences"))


@query("constant_prediction", "select distinct l_orderkey as document_id, 'carbon_tax:supporting:0' as evidence from lineitem")
def constant_prediction(t):
    docs = t.lineitem.select(F.col("l_orderkey").alias("document_id"))
    e = F.col("evidences")[0]
    out = op.constant_prediction(docs, "carbon_tax", "supporting", [0])
    return out.select("document_id", F.concat_ws(":", e["query"], e["stance"], F.array_join(e["page_indices"], ",")).alias("evidence"))
