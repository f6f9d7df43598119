"""Duplicate, conflict, leakage and join queries."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.functions.text import ascii_fold, clean_text, normalise_hard
from labelforge.operators import dedup as op
from labelforge.operators.cleaning import computed_once
from labelforge.operators.splits import hash_bucket_split
from labelforge.operators.voting import agreed_rows
from labelforge.plans.registry import query, sql_clean, sql_fold, sql_hash_int, sql_normal


@query("distinct_rows", "select distinct query, text, label from v_dup", ("v_dup",))
def distinct_rows(t):
    return op.distinct_rows(t.v_dup.drop("doc_id"))


@query("keep_first_copy", "select min(doc_id) as doc_id, query, text, label from v_dup group by query, text, label", ("v_dup",))
def keep_first_copy(t):
    return op.keep_first(t.v_dup, ["query", "text", "label"], "doc_id")


@query("keep_first_pair", "select query, text, min(doc_id) as doc_id, arg_min(label, doc_id) as label from v_dup group by query, text", ("v_dup",))
def keep_first_pair(t):
    return op.keep_first(t.v_dup, ["query", "text"], "doc_id")


@query("drop_all_copies", "select * from v_dup qualify count(*) over (partition by text) = 1", ("v_dup",))
def drop_all_copies(t):
    return op.drop_all_copies(t.v_dup, ["text"], "doc_id")


@query("drop_conflicting_negatives", "select * exclude (n) from (select *, count(*) over (partition by query, text) as n from v_dup) where not (n > 1 and label = 0)", ("v_dup",))
def drop_conflicting_negatives(t):
    return op.drop_conflicting_negatives(t.v_dup, ["query", "text"])


@query("duplicate_counts", f"""with k as (select md5(text) as a, md5({sql_clean('text')}) as b, label from v_dup),
g as (select 'text' as definition, count(*) as n from k group by a union all select 'clean_text', count(*) from k group by b union all select 'clean_text+label', count(*) from k group by b, label)
select definition, sum(n)::BIGINT as n_rows, coalesce(sum(n) filter (n > 1), 0)::BIGINT as with_copy, sum(n - 1)::BIGINT as surplus from g group by 1""", ("v_dup",))
def duplicate_counts(t):
    df = t.texts.select(op.digest("text").alias("raw"), op.digest(clean_text("text")).alias("clean"), (hash_int("doc_id", seed="d") % 2).alias("label"))
    return op.duplicate_counts(df, {"text": [F.col("raw")], "clean_text": [F.col("clean")], "clean_text+label": [F.col("clean"), F.col("label")]})


@query("entity_blind_copies", f"""with k as (select doc_id, {sql_normal(r"case when w = '' then f else regexp_replace(f, '(?i)' || regexp_replace(w, '([^A-Za-z0-9 ])', '\\\1', 'g'), '', 'g') end")} as x
 from (select doc_id, f, string_split(f, ' ')[1] as w from (select doc_id, {sql_fold('text')} as f from documents)))
select doc_id, count(*) over (partition by x) as n_copies from k qualify n_copies > 1""")
def entity_blind_copies(t):
    """Copies once every occurrence of a text's own first word is taken out."""
    df = computed_once(t.texts.select("doc_id", "text"), "folded", ascii_fold("text"))
    return op.entity_blind_copies(df.withColumn("phrase", F.element_at(F.split("folded", " "), 1)), "folded", "phrase", "doc_id")


_SPLIT = f"""s as (select doc_id, text, case when u < 0.8::DOUBLE then 'train' when u < 0.9::DOUBLE then 'test' else 'dev' end as split
 from (select *, {sql_hash_int('doc_id')} / 4294967296.0::DOUBLE as u from documents))"""


@query("leakage_matrix", f"""with {_SPLIT}, n as (select text, split, count(*) as n from s group by all)
select a.split as split_a, b.split as split_b, count(*) as texts, sum(a.n * b.n)::BIGINT as row_pairs from n a join n b on a.text = b.text and a.split < b.split group by all""")
def leakage_matrix(t):
    return op.leakage_matrix(hash_bucket_split(t.texts.select("doc_id", "text"), "doc_id"))


@query("leaking_rows", f"with {_SPLIT} select b.doc_id, a.n as n_copies from s b join (select text, count(*) as n from s where split = 'train' group by 1) a using (text) where b.split = 'test'")
def leaking_rows(t):
    return op.leaking_rows(hash_bucket_split(t.documents.select("doc_id", "text"), "doc_id"), "train", "test", "doc_id")


_LINES = lambda table, key: f"select distinct {key}, line from (select {key}, {sql_normal(sql_fold('l'))} as line from (select {key}, unnest(string_split(text, chr(10))) as l from {table})) where length(line) > 0"


@query("benchmark_contamination", f"select doc_id, count(distinct line) as lines, count(*) as item_hits from ({_LINES('documents', 'doc_id')}) a join ({_LINES('benchmark', 'item_id')}) b using (line) group by all")
def benchmark_contamination(t):
    docs = t.texts.select("doc_id", ascii_fold("text").alias("text"))
    return op.contamination(docs, t.benchmark.select("item_id", ascii_fold("text").alias("text")), "doc_id", "item_id")


@query("near_copy_paragraphs", f"""with d as (select filename, min(key) as id, count(*) as copies, t from (select doc_id * 100000 + pos as key, filename, {sql_normal(sql_fold('text'))} as t from v_para) where length(t) > 0 group by filename, t)
select a.filename, a.id as a, b.id as b, a.copies as copies_a, b.copies as copies_b, levenshtein(a.t, b.t)::INTEGER as distance from d a join d b on a.filename = b.filename and a.id < b.id
and abs(length(a.t) - length(b.t)) <= 2 and levenshtein(a.t, b.t) between 1 and 2""", ("v_para",))
def near_copy_paragraphs(t):
    lines = t.v_para.select((F.col("doc_id") * 100000 + F.col("pos")).alias("key"), "filename", "text")
    lines = computed_once(lines, "normal", normalise_hard(ascii_fold("text")))
    return op.edit_distance_pairs(lines.filter(F.length("normal") > 0), "filename", "key", "normal", 2)


@query("agreed_rows", "select a.doc_id, a.worker_0 as label from v_votes a join v_votes b using (doc_id) where a.worker_0 = b.worker_1", ("v_votes",))
def agreed_rows_query(t):
    first = t.v_votes.select("doc_id", F.col("worker_0").alias("label"))
    return agreed_rows(first, t.v_votes.select("doc_id", F.col("worker_1").alias("label")), "doc_id")


@query("responses_in_set", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def responses_in_set(t):
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@query("rows_not_in_set", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def rows_not_in_set(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("common_error_rows", """with a as (select y_true, source, count(*) as n from v_pred where y_true is distinct from y_pred group by all), b as (select y_true, source, count(*) as n from v_pred2 where y_true is distinct from y_pred group by all),
j as (select coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from a full join b using (y_true, source))
select sum(n_a)::BIGINT as rows_a, sum(n_b)::BIGINT as rows_b, sum(n_a * n_b)::BIGINT as inner_pairs, sum(case when n_a * n_b > 0 then n_a * n_b else n_a + n_b end)::BIGINT as outer_pairs,
 count(*) filter (n_a * n_b > 0)::BIGINT as inner_keys, count(*) as outer_keys from j""", ("v_pred", "v_pred2"))
def common_error_rows(t):
    from labelforge.operators.errors import error_rows

    return op.common_rows(error_rows(t.v_pred), error_rows(t.v_pred_of("p2")), ["y_true", "source"])
