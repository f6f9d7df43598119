"""Report dashboard numbers."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.operators import reports as op
from labelforge.plans import catalog, recipes
from labelforge.plans.registry import query, sql_hash_int

_V = ("v_scored",)


@query("climate_counts", "select filename, count(*) filter (climate) as climate, count(*) filter (not climate) as non_climate from v_scored group by 1", _V)
def climate_counts(t):
    return op.climate_counts(t.v_scored, ["filename"])


@query("topic_shares", "with c as (select case ClimaTOPIC when 'Governance and Data Management' then 'Gov & Data' else ClimaTOPIC end as label, count(*) as n from v_scored where climate group by 1) select label, n, round(n / sum(n) over (), 6) as share from c", _V)
def topic_shares(t):
    return op.label_share(t.v_scored, "ClimaTOPIC", op.SHORT_TOPICS).withColumn("share", F.round("share", 6))


@query("sentiment_shares", "with c as (select climate_sentiment as label, count(*) filter (climate) as a, count(*) filter (not climate) as b from v_scored group by 1) select label, round(a / sum(a) over (), 6) as climate, round(b / sum(b) over (), 6) as non_climate from c", _V)
def sentiment_shares(t):
    return op.sentiment_shares(t.v_scored).select("label", F.round("climate", 6).alias("climate"), F.round("non_climate", 6).alias("non_climate"))


@query("claim_counts", "select count(*) filter (climate and environmental_claim) as climate, count(*) filter (not climate and environmental_claim) as non_climate from v_scored", _V)
def claim_counts(t):
    return op.claim_counts(t.v_scored)


@query("pillar_percentages", " union all ".join(
    f"select '{name}' as pillar, '{group}' as \"group\", round(100 * count(*) filter ({col} = '{name}') / count(*), 6) as percentage from v_scored where {cond} (esgbert_e = 'Environment' or esgbert_s = 'Social' or esgbert_g = 'Governance')"
    for name, col in op.PILLARS.items() for group, cond in (("Climate ESG", "climate and"), ("Overall ESG", ""))), _V)
def pillar_percentages(t):
    return op.pillar_percentages(t.v_scored).withColumn("percentage", F.round("percentage", 6))


@query("recommendation_shares", "with c as (select climate_tcfd_recommendations as label, count(*) as n from v_scored where climate group by 1) select label, n, round(n / sum(n) over (), 6) as share from c", _V)
def recommendation_shares(t):
    return op.label_share(t.v_scored, "climate_tcfd_recommendations").withColumn("share", F.round("share", 6))


@query("nature_shares", " union all ".join(f"select '{name}' as topic, round(count(*) filter ({col} = '{name}') / count(*), 6) as share from v_scored where climate" for name, col in op.NATURE.items()), _V)
def nature_shares(t):
    return op.nature_shares(t.v_scored).withColumn("share", F.round("share", 6))


@query("commitment_shares", " union all ".join(
    f"select '{m}' as measure, '{g}' as claim_type, round(count(*) filter ({c}) / count(*), 6) as proportion from v_scored where {w}"
    for m, c in (("Commitment/Action", "climate_commitments_actions = 'commitment/action'"), ("Specific Commitment", "climate_commitments_actions = 'commitment/action' and climate_specificity = 'specific'"))
    for g, w in (("Env Claims", "environmental_claim"), ("Non-Env Claims", "not environmental_claim"))), _V)
def commitment_shares(t):
    return op.commitment_shares(t.v_scored).withColumn("proportion", F.round("proportion", 6))


_TASKS = catalog.CLIMATE_TASKS + ["environmental_claims"] + catalog.TOPIC_TASKS + catalog.CHARACTERISTIC_TASKS[1:5] + catalog.STANCE_TASKS
_YES_NO = {task: [catalog.POSITIVE[task], "no-label"] for task in catalog.CLIMATE_TASKS + ["environmental_claims"]}
_LABELS = {
    task: _YES_NO.get(task) or list(catalog.STANCES.get(task) or catalog.READABLE.get(task) or {"low": 0, "mid": 0, "high": 0}) for task in _TASKS
}


def report_predictions(t):
    """(key, task, y_pred) of every classifier for every narrative paragraph."""
    paragraphs = t.v_para.filter("type = 'NarrativeText' and word_count >= 4").select((F.col("doc_id") * 100000 + F.col("pos")).alias("key"), "filename", "page_number")
    names = F.create_map(*[x for task, labels in _LABELS.items() for x in (F.lit(task), F.array(*[F.lit(v) for v in labels]))])
    rows = paragraphs.select("key", F.explode(F.array(*[F.lit(x) for x in _TASKS])).alias("task"))
    place = (hash_int("key", "task", seed="rp") % F.size(names[F.col("task")])).cast("int")
    return paragraphs, rows.withColumn("y_pred", F.get(names[F.col("task")], place))


def _sql_label(task, readable=None):
    labels = [(readable or {}).get(v, v) for v in _LABELS[task]]
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in labels)
    seed = sql_hash_int("key", f"'{task}'", seed="rp")
    return f"([{listed}])[({seed} % {len(labels)}) + 1]"


def _sql_stance():
    one, two = (_sql_label(x, catalog.STANCES[x]) for x in catalog.STANCE_TASKS)
    return f"case when ({one}) = ({two}) then ({one}) else 'Neutral' end"


_HITS = " + ".join(f"(case when {_sql_label(x)} = '{catalog.POSITIVE[x]}' then 1 else 0 end)" for x in catalog.CLIMATE_TASKS)


@query("report_columns", f"""with k as (select doc_id * 100000 + pos as key, filename, page_number from v_para where type = 'NarrativeText' and word_count >= 4)
select key, filename, page_number, ({_HITS} > 3)::INTEGER as climate, ({_sql_label('environmental_claims')} = '1')::INTEGER as environmental_claim,
 {', '.join(f'{_sql_label(x, catalog.READABLE.get(x))} as {x}' for x in ('ClimaTOPIC', 'esgbert_e', 'climateEng', 'climate_commitments_actions'))}, {_sql_stance()} as stance from k""", ("v_para",))
def report_columns(t):
    paragraphs, predictions = report_predictions(t)
    out = recipes.report_columns(paragraphs, predictions, "key")
    return out.select(
        "key", "filename", "page_number", F.col("climate").cast("int").alias("climate"), F.col("environmental_claim").cast("int").alias("environmental_claim"),
        "ClimaTOPIC", "esgbert_e", "climateEng", "climate_commitments_actions", "stance",
    )
