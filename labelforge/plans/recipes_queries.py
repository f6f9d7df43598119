"""The recipes of the catalogue's tasks over the test tables, each with the SQL of its rows."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.plans import catalog, recipes
from labelforge.plans.registry import query, sql_hash_int
from labelforge.plans.cleaning_queries import MEASURED
from labelforge.plans.splitting_queries import _A, _SPLIT, _ranked
from labelforge.operators.splits import hash_bucket_split

_KEPT = "id, label, split"
_GIVEN = f"case when {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE < 0.8::DOUBLE then 'train' when {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE < 0.9::DOUBLE then 'test' else 'dev' end"
_DOCS = "(select doc_id as id, label, text from v_lang)"


def _raw(t):
    return t.v_lang.select(F.col("doc_id").alias("id"), "text", "label")


def _parts(t):
    """Three tables, as a published data set has them."""
    parts = hash_bucket_split(t.v_lang, "doc_id").withColumnRenamed("doc_id", "id")
    return [parts.filter(F.col("split") == s).select("id", "text", "label") for s in ("train", "test", "dev")]


@query("recipe_random_split", f"select {_KEPT} from (select *, {_SPLIT} from {_ranked(_DOCS, 'label', 'id')})", ("v_lang",))
def recipe_random_split(t):
    return recipes.random_split(_raw(t)).select("id", "label", "split")


@query("recipe_coded_classes", f"""with b as (select doc_id as id, (['low', 'high'])[quality + 1] as label, {sql_hash_int('doc_id', seed='tt')} % 10 < 2 as held from labels),
r as {_ranked('b where not held', 'label', 'id')}
select id, label, case when rn <= {_A} then 'train' else 'dev' end as split from r union all select id, label, 'test' from b where held""")
def recipe_coded_classes(t):
    coded = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), (hash_int("doc_id", seed="tt") % 10 < 2).alias("held"))
    parts = [coded.filter(c).drop("held") for c in (~F.col("held"), F.col("held"))]
    return recipes.coded_classes(*parts, ["low", "high"]).select("id", "label", "split")


@query("recipe_given_splits", f"select doc_id as id, label, {_GIVEN} as split from v_lang", ("v_lang",))
def recipe_given_splits(t):
    return recipes.given_splits(*_parts(t)).select("id", "label", "split")


@query("recipe_united_train", f"select doc_id as id, label, case {_GIVEN} when 'dev' then 'train' when 'test' then 'test' else 'train' end as split from v_lang union all select doc_id, label, 'dev' from v_lang where {_GIVEN} = 'dev'", ("v_lang",))
def recipe_united_train(t):
    """Train from two files; the second one is dev, too."""
    train, test, dev = _parts(t)
    return recipes.united_train([train, dev], test, dev).select("id", "label", "split")


@query("recipe_drop_empty_test", f"select id, label, split from (select doc_id as id, label, {_GIVEN} as split, {sql_hash_int('doc_id', seed='n')} % 7 > 0 as there from v_lang) where split <> 'test' or there", ("v_lang",))
def recipe_drop_empty_test(t):
    gaps = [df.withColumn("text", F.when(hash_int("id", seed="n") % 7 > 0, F.col("text"))) for df in _parts(t)]
    return recipes.drop_empty_test(*gaps).select("id", "label", "split")


@query("recipe_claims", f"select id, label, split from (select *, {_SPLIT} from {_ranked('(select o_orderkey as id, claim_label as label from v_claims)', 'label', 'id')})", ("v_claims",))
def recipe_claims(t):
    raw = t.v_claims.select(F.col("o_orderkey").alias("claim_id"), F.lit("claim").alias("claim"), "claim_label")
    return recipes.claims(raw).select("id", "label", "split")


@query("recipe_claim_evidences", f"""with k as (select distinct o_custkey::VARCHAR as claim_id, 1 as one from orders), r as {_ranked('k', 'one', 'claim_id')}, s as (select claim_id, {_SPLIT} from r)
select claim_id || '|' || o_orderkey::VARCHAR as id, label, split from (select o_custkey::VARCHAR as claim_id, o_orderkey, o_orderstatus as label from orders) join s using (claim_id)""")
def recipe_claim_evidences(t):
    one = F.struct(
        F.lit("article").alias("article"), F.lit(0.0).alias("entropy"), F.lit("evidence").alias("evidence"), F.col("o_orderkey").cast("string").alias("evidence_id"),
        F.col("o_orderstatus").alias("evidence_label"), F.array(F.col("o_orderstatus")).alias("votes"),
    )
    nested = t.orders.select(F.col("o_custkey").cast("string").alias("claim_id"), F.lit("claim").alias("claim"), F.lit("SUPPORTS").alias("claim_label"), F.array(one).alias("evidences"))
    return recipes.claim_evidences(nested).select("id", "label", "split")


@query("recipe_by_time", f"""select id, label, split from (select o_orderkey as id, label, {_SPLIT} from {_ranked('v_time', 'label', 'o_orderkey', lead='"Date"::DATE')})""", ("v_time",))
def recipe_by_time(t):
    raw = t.v_time.select(F.col("o_orderkey").alias("id"), "label", F.col("Date").cast("string").alias("Date"))
    return recipes.by_time(raw).select("id", "label", "split")


_WORKERS = [f"worker_{k}" for k in range(8)]
_CONSENSUS = """(select v.doc_id as id, m.vote as label from v_votes v left join (select doc_id, vote from (select doc_id, vote, count(*) as n from v_votes_long group by all)
 qualify row_number() over (partition by doc_id order by n desc, vote) = 1) m using (doc_id))"""


@query("recipe_annotators", f"select id, label, split from (select *, {_SPLIT} from {_ranked(_CONSENSUS, 'label', 'id')})", ("v_votes_long",))
def recipe_annotators(t):
    return recipes.annotators(t.v_votes.withColumnRenamed("doc_id", "id"), _WORKERS).select("id", "label", "split")


@query("recipe_held_out_annotators", f"""with b as (select *, {sql_hash_int('id', seed='ho')} % 5 = 0 as held from {_CONSENSUS}), r as {_ranked('b where not held', 'label', 'id')}
select id, label, case when rn <= floor(n * (1 - 0.1::DOUBLE)) then 'train' else 'dev' end as split from r union all select id, label, 'test' from b where held""", ("v_votes_long",))
def recipe_held_out_annotators(t):
    raw = t.v_votes.withColumnRenamed("doc_id", "id").withColumn("held", hash_int("id", seed="ho") % 5 == 0)
    return recipes.held_out_annotators(raw, _WORKERS, "held").select("id", "label", "split")


_LONG = "(select id, task, label, task || '|' || label as strata from (select doc_id as id, 'quality' as task, quality::VARCHAR as label from labels union all select doc_id, 'toxic', toxic::VARCHAR from labels))"


@query("recipe_one_task_per_column", f"select id, task, label, split from (select *, {_SPLIT} from {_ranked(_LONG, 'strata', 'id')})")
def recipe_one_task_per_column(t):
    raw = t.labels.select(F.col("doc_id").alias("id"), F.lit("").alias("text"), *[F.col(c).cast("string").alias(c) for c in ("quality", "toxic")])
    return recipes.one_task_per_column(raw, ["quality", "toxic"]).select("id", "task", "label", "split")


_AGREED = "(select doc_id as id, worker_0 as label from v_votes where worker_0 = worker_1)"


@query("recipe_two_annotators", f"select id, label, split from (select *, {_SPLIT} from {_ranked(_AGREED, 'label', 'id')})", ("v_votes",))
def recipe_two_annotators(t):
    first, second = (t.v_votes.select("doc_id", F.col(w).alias("label")) for w in ("worker_0", "worker_1"))
    return recipes.two_annotators(first, second, "doc_id").select("id", "label", "split")


@query("recipe_listed_labels", f"""select split, md5(text) as text, string_agg(distinct label, '|' order by label) as label from (select {_GIVEN} as split, text, label from v_lang) where text is not null group by split, text""", ("v_lang",))
def recipe_listed_labels(t):
    rows = hash_bucket_split(t.v_lang, "doc_id").select("split", "text", "label")
    return recipes.listed_labels(rows, "text", "label").select("split", F.md5(F.col("text").cast("binary")).alias("text"), F.array_join("label", "|").alias("label"))


@query("recipe_conflict_free_pairs", f"""select id, split, label from (select *, count(*) over (partition by split, query, text) as n from (select doc_id as id, {_GIVEN} as split, query, text, label from v_dup)) where not (n > 1 and label = 0)""", ("v_dup",))
def recipe_conflict_free_pairs(t):
    raw = hash_bucket_split(t.v_dup, "doc_id").withColumnRenamed("doc_id", "id")
    return recipes.conflict_free_pairs(raw).select("id", "split", "label")


_READY = f"""m as ({MEASURED}), kept as (select *, {_GIVEN} as split from m where token_counts >= 5 and token_counts < 4000),
u as (select min(doc_id) as doc_id, label, split from kept group by split, clean_text, label)"""


@query("recipe_prepare", f"with {_READY} select doc_id, label, split from u", ("v_task",))
def recipe_prepare(t):
    """Preparation without a cut of the train rows: every row that cleaning, length and copies leave."""
    spec = catalog.specs(["climate_detection"])[0]
    df = hash_bucket_split(t.v_task.select("doc_id", "text", "label"), "doc_id")
    return recipes.prepare(df, spec, "doc_id", max_size=1 << 40).select("doc_id", "label", "split")


@query("recipe_prepare_capped", f"""with {_READY}, c as (select split, label, count(*) as n from u group by all)
select split, count(*) as n from u where split = 'test' group by 1
union all select s, case when total <= 200 then total else 200 end from (select split as s, sum(n)::BIGINT as total from c where split in ('train', 'dev') group by 1)
where (select sum(n) from c where split = 'train') > 200
union all select split, sum(n)::BIGINT from c where split in ('train', 'dev') and (select sum(n) from c where split = 'train') <= 200 group by 1""", ("v_task",))
def recipe_prepare_capped(t):
    """Rows per split when train may hold 200."""
    spec = catalog.specs(["climate_detection"])[0]
    df = hash_bucket_split(t.v_task.select("doc_id", "text", "label"), "doc_id")
    return recipes.prepare(df, spec, "doc_id", max_size=200).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _policy_documents(t):
    """Conversations as documents: a turn is a page of one sentence, a user's turn is evidence."""
    sentence = F.struct(
        F.col("turn").cast("int").alias("page_idx"), F.col("turn").cast("string").alias("sentence_id"), F.lit(0).alias("block_idx"), F.lit(0).alias("block_sentence_idx"), "text"
    )
    found = F.struct(F.col("role").alias("query"), F.lit("supporting").alias("stance"), F.array(F.col("turn").cast("int")).alias("page_indices"), F.lit("").alias("comment"))
    return t.conversations.groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(
        F.array_sort(F.collect_list(sentence)).alias("sentences"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", found))).alias("evidences"),
    )


@query("recipe_policy_pages", "select conv_id::VARCHAR as document_id, turn::INTEGER as page_idx, md5(text) as text, (role = 'user')::INTEGER as label from conversations")
def recipe_policy_pages(t):
    return recipes.policy_pages(_policy_documents(t)).select("document_id", "page_idx", F.md5(F.col("text").cast("binary")).alias("text"), "label")


@query("recipe_policy_stances", "select md5(text) as text, role as query, 'supporting' as label from conversations where role = 'user'")
def recipe_policy_stances(t):
    return recipes.policy_page_stances(_policy_documents(t)).select(F.md5(F.col("text").cast("binary")).alias("text"), "query", "label")
