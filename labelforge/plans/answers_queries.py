"""Prompt, request, response and keyed-table queries."""

from pyspark.sql import functions as F

from labelforge.functions import answers as fn
from labelforge.functions.hashing import hash_int
from labelforge.functions.text import strip
from labelforge.operators import requests as op
from labelforge.operators.stats import token_usage
from labelforge.plans import catalog
from labelforge.plans.registry import query, sql_hash_int, sql_strip, sql_text
from labelforge.plans.views import READABLE
from labelforge.sources import readers, writers

TEMPLATE = (
    "Some notes.\n[STARTPROMPT]\nClassify the text.\nLabel: [A or B]\nExplanation: why\nQuestion: [[Insert Query Here]]\n"
    "Input text: [[Insert Text Here]]\n[ENDPROMPT]\nMore notes."
)
_T = "'" + TEMPLATE.replace("\n", "' || chr(10) || '") + "'"
_BODY = "'Classify the text.' || chr(10) || 'Label: [A or B]' || chr(10) || 'Explanation: why' || chr(10) || 'Question: ' || query || chr(10) || 'Input text: ' || text"


def _readable(t):
    return t.spark.createDataFrame([(v, k) for k, v in READABLE.items()], "key string, value string")


def _prompts(t):
    return t.spark.createDataFrame([("qa", TEMPLATE)], "task string, prompt string")


def _filled(t):
    return op.fill_prompts(t.v_pairs.withColumn("task", F.lit("qa")), _prompts(t), query="query")


@query("extract_prompts", f"""select conv_id, turn, case when role = 'user' then {sql_strip("'Ask. ' || text")} else '{fn.PROMPT_MISSING}' end as prompt from conversations""")
def extract_prompts(t):
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit("x [STARTPROMPT]\nAsk. "), F.col("text"), F.lit("\n[ENDPROMPT] [ENDPROMPT]"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", fn.extract_prompt(wrapped).alias("prompt"))


@query("fill_prompts", f"select pair_id, {_BODY} as content from v_pairs", ("v_pairs",))
def fill_prompts(t):
    return _filled(t).select("pair_id", "content")


@query("label_blocks", """select source as task, 'description: ' || chr(10) || 'task ' || source || chr(10) || chr(10) || 'Labels: ' || chr(10) || string_agg('- [' || lang || ']: ' || n || ' texts' || chr(10), '' order by lang) as block
 from (select source, lang, count(*) as n from documents group by all) group by source""")
def label_blocks(t):
    c = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    table = c.select(
        F.col("source").alias("task"), F.concat(F.lit("task "), F.col("source")).alias("description"), F.col("lang").alias("position"),
        F.col("lang").alias("label"), F.concat(F.col("n").cast("string"), F.lit(" texts")).alias("definition"),
    )
    return op.label_blocks(table)


@query("think_first_prompts", "select doc_id, 'Explanation: ' || lang || chr(10) || 'Label: ' || source || chr(10) || text as prompt from documents")
def think_first_prompts(t):
    prompt = F.concat(F.lit("Label: "), "source", F.lit("\nExplanation: "), "lang", F.lit("\n"), "text")
    return t.documents.select("doc_id", fn.swap_label_and_explanation(prompt).alias("prompt"))


@query("lint_prompts", """select doc_id::VARCHAR as task, case doc_id % 4 when 0 then 'answer format' when 1 then 'no text slot' when 2 then 'no query slot' end as problem from documents where doc_id % 4 < 3""")
def lint_prompts(t):
    head = F.when(F.col("doc_id") % 4 > 0, F.lit("Explanation: y\nLabel: [x]\n")).otherwise(F.lit("Label: [x]\n"))
    slot = F.when(F.col("doc_id") % 4 != 1, F.lit(fn.TEXT_SLOT)).otherwise(F.lit(""))
    ask = F.when(F.col("doc_id") % 4 == 3, F.lit(fn.QUERY_SLOT)).otherwise(F.lit(""))
    table = t.documents.select(F.col("doc_id").cast("string").alias("task"), F.concat(head, slot, ask, F.translate("text", "[]", "")).alias("prompt"))
    return op.lint_prompts(table, F.lit(True))


@query("batch_requests", f"""select 'task-' || pair_id as custom_id, 'POST' as method, '/v1/chat/completions' as url, 'small' as model, 0.1::DOUBLE as temperature, 42 as seed, 2 as messages, {_BODY} as content from v_pairs""", ("v_pairs",))
def batch_requests(t):
    lines = op.batch_requests(_filled(t), "pair_id", "small")
    at = lambda path: F.get_json_object("value", path)
    return lines.select(
        at("$.custom_id").alias("custom_id"), at("$.method").alias("method"), at("$.url").alias("url"), at("$.body.model").alias("model"),
        at("$.body.temperature").cast("double").alias("temperature"), at("$.body.seed").cast("int").alias("seed"),
        F.json_array_length(at("$.body.messages")).alias("messages"), at("$.body.messages[1].content").alias("content"),
    )


def response_lines(t):
    """Model answers as response records."""
    usage = F.struct(F.length("content").cast("bigint").alias("prompt_tokens"), F.lit(7).cast("bigint").alias("completion_tokens"), (F.length("content") + 7).cast("bigint").alias("total_tokens"))
    message = F.struct(F.lit("assistant").alias("role"), F.col("content"))
    body = F.struct(F.lit("small").alias("model"), F.array(F.struct(F.lit(0).alias("index"), message.alias("message"))).alias("choices"), usage.alias("usage"))
    record = F.struct(F.concat(F.lit("task-"), "item_id").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"))
    return t.v_answers.select(F.to_json(record).alias("value"))


@query("pair_responses", "select item_id, label, content from v_answers", ("v_answers",))
def pair_responses(t):
    return op.pair_responses(t.v_answers.select("item_id", "label"), op.read_responses(response_lines(t)), "item_id")


@query("token_usage", "select count(*) as calls, sum(length(content))::BIGINT as prompt_tokens, (7 * count(*))::BIGINT as completion_tokens, sum(length(content) + 7)::BIGINT as total_tokens from v_answers", ("v_answers",))
def token_usage_query(t):
    return token_usage(op.read_responses(response_lines(t)))


_SAID = "case when said is null then null when kind = 0 then upper(name) else name end"


@query("parse_answers", f"select item_id, {_SAID} as model_label, {sql_strip('text')} as model_explanation from (select *, {sql_hash_int('item_id', seed='k')} % 4 as kind from v_answers)", ("v_answers",))
def parse_answers(t):
    return op.parse_answers(t.v_answers).select("item_id", "model_label", "model_explanation")


@query("answer_ids", "select item_id, said as y_pred from v_answers", ("v_answers",))
def answer_ids(t):
    return op.answer_ids(op.parse_answers(t.v_answers), "model_label", _readable(t)).select("item_id", "y_pred")


@query("answer_ids_hierarchical", "select item_id, said as y_pred from v_answers", ("v_answers",))
def answer_ids_hierarchical(t):
    return op.answer_ids(op.parse_answers(t.v_answers), "model_label", _readable(t), hierarchical=True).select("item_id", "y_pred")


@query("audit_answers", f"""select item_id, content, {_SAID} as model_label, lower({sql_strip("string_split(name, ',')[-1]")}) as matching_key, said as mapped_label,
 case label {' '.join(f"when '{a}' then '{b}'" for a, b in READABLE.items())} end as gold_text from (select *, {sql_hash_int('item_id', seed='k')} % 4 as kind from v_answers)""", ("v_answers",))
def audit_answers(t):
    return op.audit(t.v_answers, _readable(t)).select("item_id", "content", "model_label", "matching_key", "mapped_label", "gold_text")


@query("repair_labels", """select doc_id, coalesce(string_split(replace(case when doc_id % 6 > 0 then 'general ' || lang end, 'general', 'none'), ' ')[1], 'missing') as label from documents""")
def repair_labels(t):
    parsed = F.when(F.col("doc_id") % 6 > 0, F.concat(F.lit("general "), "lang"))
    return t.documents.select("doc_id", fn.repair_label(parsed, {"general": "none"}, first_word=True, default="missing").alias("label"))


@query("parse_evidence_answers", "select document_id, '[(' || query || ', ' || stance || ')]' as label, 'pages ' || array_to_string(pages, ' ') as explanation from v_evid_gold", ("v_evid_gold",))
def parse_evidence_answers(t):
    answer = F.concat(F.lit("Evidences: [("), "query", F.lit(", "), "stance", F.lit(")]\nExplanation:  pages "), F.array_join("pages", " "), F.lit("\n"))
    rows = t.v_evid_gold.select("document_id", answer.alias("a"))
    return rows.select("document_id", fn.parse_evidences("a").alias("label"), fn.parse_explanation("a").alias("explanation"))


@query("split_answers", "select doc_id, array_to_string(list_transform(label, lambda x: upper(x)), '|') as parts, greatest(len(label), 1)::INTEGER as n from v_multi", ("v_multi",))
def split_answers(t):
    answer = F.concat(F.lit("  "), F.array_join(F.transform("label", F.upper), " , "), F.lit("\n"))
    rows = t.v_multi.select("doc_id", fn.split_answer(answer).alias("l"))
    return rows.select("doc_id", F.array_join("l", "|").alias("parts"), F.size("l").alias("n"))


@query("transcript_tails", "select doc_id, replace(text, '*', '') as answer from documents")
def transcript_tails(t):
    raw = F.concat(F.lit("<|start_header_id|>user<|end_header_id|>hi<|start_header_id|>assistant<|end_header_id|>"), "text")
    return t.documents.select("doc_id", fn.transcript_tail(raw).alias("answer"))


@query("transcript_answers", "select conv_id, 'ds' || conv_id % 3 as task, 0 as position, string_agg(text, chr(10) order by turn) as content from conversations group by conv_id")
def transcript_answers(t):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    talks = t.conversations.groupBy("conv_id").agg(joined.alias("content"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    talk = F.array(message("system", F.lit("s")), message("user", F.lit("u")), message("assistant", F.col("content")))
    key = F.concat(F.lit("ds"), (F.col("conv_id") % 3).cast("string"))
    lines = talks.select("conv_id", F.to_json(F.create_map(key, F.array(talk))).alias("value"))
    return op.transcript_answers(lines)


@query("event_properties", "select event_id, cast(json_extract_string(props, '$.k') as INTEGER) as k from events")
def event_properties(t):
    good, _ = readers.split_json_lines(t.events.select("event_id", "props"), "k int", "props")
    return good


@query("rejected_lines", f"select event_id, substr(props, 1, length(props) - 1) as props from events where {sql_hash_int('event_id', seed='bad')} % 50 = 0")
def rejected_lines(t):
    """Lines that lost their last sign are reported and not fatal."""
    broken = F.when(hash_int("event_id", seed="bad") % 50 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    _, bad = readers.split_json_lines(t.events.select("event_id", broken.alias("props")), "k int", "props")
    return bad


@query("question_columns", """select text, (case doc_id % 3 when 0 then 2 when 1 then 5 else 8 end)::INTEGER as label, doc_id::INTEGER as "Year", source as "Company Name" from documents""")
def question_columns(t):
    """Each raw part has one question column; which one is the label."""
    parts = []
    for rest, number in ((0, 2), (1, 5), (2, 8)):
        part = t.documents.filter(F.col("doc_id") % 3 == rest)
        parts.append(readers.question_rows(part.select(F.col("text").alias(f"Question {number}"), F.col("doc_id").alias("Year"), F.col("source").alias("Company Name"))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("merged_question_columns", """select text, (case when doc_id % 2 = 0 then 1 else 4 end)::INTEGER as label, doc_id as "Year", source as "Company Name" from documents""")
def merged_question_columns(t):
    even = F.col("doc_id") % 2 == 0
    raw = t.documents.select(
        F.when(even, F.col("text")).alias("Question 1"), F.when(~even, F.col("text")).alias("Question 4"), F.col("doc_id").alias("Year"), F.col("source").alias("Company Name")
    )
    return readers.merged_question_rows(raw)


@query("insert_only_merge", "select c_custkey as k, 'old' as v from customer where c_custkey % 3 = 0 union all select o_custkey, 'new' from (select distinct o_custkey from orders where o_custkey % 3 > 0 or o_custkey not in (select c_custkey from customer))")
def insert_only_merge(t):
    old = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = t.orders.select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")).distinct()
    return writers.insert_only(old, new, "k")[0]


@query("merge_clashes", "select distinct o_custkey as k from orders where o_custkey in (select c_custkey from customer where c_custkey % 3 = 0)")
def merge_clashes(t):
    old = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return writers.insert_only(old, t.orders.select(F.col("o_custkey").alias("k")).distinct(), "k")[1]


@query("upsert_merge", "select c_custkey as k, case when c_custkey in (select o_custkey from orders) then 'new' else 'old' end as v from customer union all select distinct o_custkey, 'new' from orders where o_custkey not in (select c_custkey from customer)")
def upsert_merge(t):
    old = t.customer.select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return writers.upsert(old, t.orders.select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")).distinct(), "k")


@query("remaining_datasets", "select distinct source as dataset_name from documents where source not in (select source from documents where doc_id % 40 = 1)")
def remaining_datasets(t):
    todo = t.documents.select(F.col("source").alias("dataset_name")).distinct()
    log = t.documents.filter("doc_id % 40 = 1").select(F.col("source").alias("dataset_name"), F.lit(42).alias("seed"))
    return writers.remaining(todo, log, 42)


@query("unseen_files", "select distinct source as file_name from documents where source not in (select source from documents where doc_id % 40 = 2)")
def unseen_files(t):
    listing = t.documents.select(F.col("source").alias("file_name")).distinct()
    return readers.unseen_files(listing, t.documents.filter("doc_id % 40 = 2").select(F.col("source").alias("file_name")))


_SETTINGS = ", ".join(
    "(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else sql_text(v) for v in (c.name, c.kind, c.stratify_on, c.balance, c.weighted_loss)) + ")"
    for c in catalog.specs()
)
_TASKS = "[" + ", ".join(map(sql_text, catalog.NAMES)) + "]"


@query("restricted_catalogue", f"""select name, kind, stratify_on, balance, weighted_loss, n, n_sources from (values {_SETTINGS}) c(name, kind, stratify_on, balance, weighted_loss)
join (select ({_TASKS})[({sql_hash_int('doc_id')} % {len(catalog.NAMES)}) + 1] as name, count(*) as n, count(distinct source) as n_sources from documents group by 1) using (name)""")
def restricted_catalogue(t):
    """Settings of the tasks that documents belong to (by hash), with the documents and sources of each."""
    names = F.array(*[F.lit(n) for n in catalog.NAMES])
    task = F.element_at(names, (hash_int("doc_id") % len(catalog.NAMES) + 1).cast("int")).alias("name")
    counts = t.documents.select(task, "source").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))
    wanted = catalog.catalogue(t.spark).select("name", "kind", "stratify_on", "balance", "weighted_loss")
    return wanted.join(counts, "name")
