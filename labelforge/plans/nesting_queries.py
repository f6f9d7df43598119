"""Nested documents, pages, evidences and reshaping queries."""

from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.operators import nested as op
from labelforge.operators.cleaning import relax_nested_stance
from labelforge.plans.registry import query, sql_hash_int
from labelforge.plans.views import STANCES


def sentence_rows(t):
    """Paragraph lines as sentences of pages and blocks."""
    return t.v_para.select(
        F.col("doc_id").alias("document_id"), F.col("pos"), F.col("page_number").alias("page_idx"),
        F.floor(F.col("pos") / 2).cast("int").alias("block_idx"), (F.col("pos") % 2).cast("int").alias("block_sentence_idx"),
        F.lpad(F.col("pos").cast("string"), 6, "0").alias("sentence_id"), "text",
    )


def policy_documents(t):
    """Nested documents of the reference layout, built from the test tables."""
    s = sentence_rows(t)
    packed = F.array_sort(F.collect_list(F.struct("pos", "page_idx", "sentence_id", "block_idx", "block_sentence_idx", "text")))
    body = s.groupBy("document_id").agg(packed.alias("sentences"))
    ev = t.v_evid_gold.select(
        "document_id", "query", "stance", F.transform("pages", lambda p: p - 1).alias("page_indices"), F.lit("").alias("comment")
    ).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("query", "stance", "page_indices", "comment"))).alias("evidences"))
    none = F.array().cast(dict(ev.dtypes)["evidences"])
    return body.join(ev, "document_id", "left").withColumn("evidences", F.coalesce("evidences", none))


_DOCS = """s as (select doc_id as document_id, pos, page_number as page_idx, pos // 2 as block_idx, text from v_para),
e as (select document_id, query, stance, unnest(list_transform(pages, lambda p: p - 1)) as page_idx from v_evid_gold where document_id in (select doc_id from v_para)),
b as (select document_id, page_idx, block_idx, string_agg(text, '' order by pos) as text from s group by all),
p as (select document_id, page_idx, string_agg(text, '\\n' order by block_idx) as text from b group by all)"""
_V = ("v_para", "v_evid_gold")


@query("pages_by_block", f"with {_DOCS} select document_id, page_idx::INTEGER as page_idx, text from p", _V)
def pages_by_block(t):
    return op.rebuild_pages_by_block(sentence_rows(t))


@query("pages_by_sentence", """select doc_id as document_id, page_number as page_idx, string_agg(text, ' ' order by pos) as text from v_para group by all""", ("v_para",))
def pages_by_sentence(t):
    return op.rebuild_pages_by_sentence(sentence_rows(t))


@query("pages_by_block_place", """select doc_id as document_id, page_number as page_idx, string_agg(text, ' ' order by pos // 2, pos % 2) as text from v_para group by all""", ("v_para",))
def pages_by_block_place(t):
    return op.rebuild_pages_by_sentence(sentence_rows(t), ["block_idx", "block_sentence_idx"])


@query("page_map", """select doc_id as document_id, count(distinct page_number)::INTEGER as pages, string_agg(text, ' ' order by pos) filter (page_number = 0) as first_page from v_para group by all""", ("v_para",))
def page_map(t):
    mapped = op.page_map(op.rebuild_pages_by_sentence(sentence_rows(t)))
    return mapped.select("document_id", F.size("pages").alias("pages"), F.col("pages")[0].alias("first_page"))


@query("paragraphs_to_pages", """select filename, doc_id, page_number, string_agg(text, chr(10) order by pos) as text from v_para where type = 'NarrativeText' group by all""", ("v_para",))
def paragraphs_to_pages(t):
    return op.join_ordered(t.v_para.filter("type = 'NarrativeText'"), ["filename", "doc_id", "page_number"], ["pos"], "text", "\n")


@query("evidence_pages", """select document_id, array_to_string(list_sort(list(distinct page)), '|') as pages from (select document_id, unnest(pages) - 1 as page from v_evid_gold where document_id in (select doc_id from v_para)) group by 1
 union all select distinct doc_id, '' from v_para where doc_id not in (select document_id from v_evid_gold)""", _V)
def evidence_pages(t):
    return policy_documents(t).select("document_id", F.array_join(op.evidence_pages(), "|").alias("pages"))


@query("page_queries", f"with {_DOCS} select document_id, page_idx::INTEGER as page_idx, string_agg(query, '|' order by query) as label from e group by all", _V)
def page_queries(t):
    return op.page_queries(policy_documents(t)).withColumn("label", F.array_join("label", "|"))


@query("page_stances_with_text", f"with {_DOCS} select e.document_id, e.page_idx::INTEGER as page_idx, query, stance, text from e left join p using (document_id, page_idx)", _V)
def page_stances_with_text(t):
    docs = policy_documents(t)
    pages = op.rebuild_pages_by_block(op.sentences(docs.withColumn("sentences", F.transform("sentences", lambda s: s.dropFields("pos")))))
    return op.attach_pages(op.evidence_rows(docs).drop("comment"), pages)


@query("labelled_pages", f"with {_DOCS} select document_id, page_idx::INTEGER as page_idx, text, (exists (select 1 from e where e.document_id = p.document_id and e.page_idx = p.page_idx))::INTEGER as label from p", _V)
def labelled_pages(t):
    docs = policy_documents(t).withColumn("sentences", F.transform("sentences", lambda s: s.dropFields("pos")))
    return op.labelled_pages(docs)


@query("sentence_membership", f"select doc_id as document_id, page_number as page_id, lpad(pos::VARCHAR, 6, '0') as sentence_id, ({sql_hash_int('doc_id', 'pos', seed='sm')} % 4 = 0 )::INTEGER as y from v_para", ("v_para",))
def sentence_membership(t):
    s = sentence_rows(t).withColumn("hit", hash_int("document_id", "pos", seed="sm") % 4 == 0)
    packed = F.array_sort(F.collect_list(F.struct("pos", "page_idx", "sentence_id", "block_idx", "block_sentence_idx", "text")))
    ids = F.collect_list(F.when(F.col("hit"), F.col("sentence_id")))
    docs = s.groupBy("document_id").agg(
        packed.alias("sentences"), F.struct(F.array(F.array(F.struct(ids.alias("sentence_ids")))).alias("evidences")).alias("meta")
    )
    return op.sentence_membership(docs).drop("sentences")


def claim_documents(t):
    """Customers as claims, their orders as evidence."""
    e = F.struct(
        F.lit("a").alias("article"), F.lit(0.5).alias("entropy"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("evidence"),
        F.col("o_orderkey").cast("string").alias("evidence_id"), F.col("label").alias("evidence_label"),
        F.array(F.col("label"), F.lit(None).cast("string")).alias("votes"),
    )
    named = F.concat(F.lit("claim "), F.col("claim_id"))
    return t.v_claims.groupBy("claim_id", named.alias("claim"), "claim_label").agg(F.collect_list(e).alias("evidences"))


@query("claim_evidence_rows", "select claim_id, 'claim ' || claim_id as query, 'order ' || o_orderkey as text, label from v_claims", ("v_claims",))
def claim_evidence_rows(t):
    return op.claim_evidence_rows(claim_documents(t)).select("claim_id", "query", "text", "label")


@query("multilabel_per_text", "select text, string_agg(distinct query || label, '|' order by query || label) as label from v_dup group by text", ("v_dup",))
def multilabel_per_text(t):
    rows = t.v_dup.select("text", F.concat("query", F.col("label").cast("string")).alias("one"))
    return op.collect_labels(rows, ["text"], "one", repeats=False).withColumn("label", F.array_join("label", "|"))


@query("votes_to_columns", "select doc_id, worker_0 as annotator1, worker_1 as annotator2, worker_2 as annotator3, null::VARCHAR as annotator4 from v_votes", ("v_votes",))
def votes_to_columns(t):
    wide = op.array_to_columns(t.v_votes.select("doc_id", F.array("worker_0", "worker_1", "worker_2").alias("votes")), "votes", 4, "annotator")
    return wide.drop("votes")


@query("melt_binary_tasks", "select doc_id, 'quality' as task, quality as label from labels union all select doc_id, 'toxic', toxic from labels")
def melt_binary_tasks(t):
    return op.melt(t.labels, ["doc_id"], ["quality", "toxic"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRIORITIES_SQL = ", ".join(f"""count(*) filter (label = '{p}') as "{p}\"""" for p in _PRIORITIES)


@query("spread_year_counts", f"""select year("Date")::INTEGER as year, {_PRIORITIES_SQL} from v_time group by all""", ("v_time",))
def spread_year_counts(t):
    dated = t.v_time.withColumn("year", F.year("Date"))
    return op.spread_counts(dated, "year", "label", _PRIORITIES)


@query("nest_evidences", """select document_id, string_agg(query || ':' || stance || ':' || array_to_string(pages, ','), ';' order by query, stance) as evidences from v_evid_gold group by 1""", ("v_evid_gold",))
def nest_evidences(t):
    flat = t.lineitem.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("query"), F.col("l_linestatus").alias("stance"),
        F.col("l_linenumber").alias("page"),
    )
    docs = op.nest_evidences(flat)
    one = lambda e: F.concat_ws(":", e["query"], e["stance"], F.array_join(e["page_indices"], ","))
    return docs.select("document_id", F.array_join(F.transform("evidences", one), ";").alias("evidences"))


@query("relax_nested_stance", f"""select document_id, string_agg(query || ':' || s, ';' order by query, stance) as evidences from (select document_id, query, stance,
 (['supporting','supporting','no_position','not_supporting','not_supporting'])[({sql_hash_int('document_id', 'query', 'stance', seed='st')} % 5) + 1] as s from v_evid_gold) group by 1""", ("v_evid_gold",))
def relax_nested_stance_query(t):
    five = F.get(F.array(*[F.lit(s) for s in STANCES]), (hash_int("document_id", "query", "stance", seed="st") % 5).cast("int"))
    docs = t.v_evid_gold.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("query", F.col("stance").alias("raw"), five.alias("stance")))).alias("evidences")
    )
    relaxed = relax_nested_stance(docs)
    return relaxed.select("document_id", F.array_join(F.transform("evidences", lambda e: F.concat_ws(":", e["query"], e["stance"])), ";").alias("evidences"))


@query("parse_evidence_tuples", """select document_id, string_agg(query || ':' || stance || ':' || array_to_string(pages, ','), ';' order by query, stance, pages) as evidences from v_evid_pred group by 1""", ("v_evid_pred",))
def parse_evidence_tuples(t):
    pages = F.when(F.size("pages") == 1, F.col("pages")[0].cast("string")).otherwise(F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]")))
    printed = F.concat(F.lit("('"), F.col("query"), F.lit("', '"), F.col("stance"), F.lit("', "), pages, F.lit(")"))
    texts = t.v_evid_pred.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("query", "stance", "pages", printed.alias("s")))).alias("l"))
    raw = texts.select("document_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["s"]), ", "), F.lit("]")).alias("raw"))
    one = lambda e: F.concat_ws(":", e["query"], e["stance"], F.array_join(e["page_indices"], ","))
    return raw.select("document_id", F.array_join(F.transform(op.as_evidence_list("raw"), one), ";").alias("evidences"))


@query("expand_to_queries", """select d.doc_id, q.query, list_contains(label, q.query)::INTEGER as label from v_multi d cross join (select distinct unnest(label) as query from v_multi) q""", ("v_multi",))
def expand_to_queries(t):
    queries = t.v_multi.select(F.explode("label").alias("query"))
    return op.expand_to_queries(t.v_multi, queries).withColumn("label", F.col("label").cast("int"))


@query("gold_and_first_prediction", """select document_id, string_agg(query || stance, '|' order by query || stance) as gold, arg_min(query || stance, query || stance) as prediction from v_evid_gold group by 1""", ("v_evid_gold",))
def gold_and_first_prediction(t):
    rows = t.v_evid_gold.select("document_id", F.concat("query", "stance").alias("y"))
    return op.gold_and_first_prediction(rows, "document_id", "y", "y", "y").withColumn("gold", F.array_join("gold", "|"))


@query("page_flags", f"with {_DOCS} select document_id, page_idx::INTEGER as page_idx, (count(query) > 0)::INTEGER as label from p left join e using (document_id, page_idx) group by all", _V)
def page_flags(t):
    from labelforge.operators.stats import page_flags as flags

    pages = op.rebuild_pages_by_block(sentence_rows(t))
    marks = t.v_evid_gold.select("document_id", "query", F.explode("pages").alias("p")).select("document_id", "query", (F.col("p") - 1).alias("page_idx"))
    return flags(pages.select("document_id", "page_idx").join(marks, ["document_id", "page_idx"], "left"), ["document_id", "page_idx"])
