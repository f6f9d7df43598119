"""Cleaning, measuring, filtering and mapping queries."""

from pyspark.sql import functions as F

from labelforge.functions import text as tx
from labelforge.operators import cleaning as op
from labelforge.operators import language
from labelforge.operators.dedup import keep_first
from labelforge.operators.splits import stratified_split
from labelforge.operators.stats import label_shares
from labelforge.plans.registry import query, sql_clean, sql_fold, sql_hash_int, sql_normal, sql_rank, sql_strip, sql_text, sql_tokens
from labelforge.session import cut_lineage
from labelforge.plans.views import READABLE, RING, STANCES

MEASURED = f"select *, {sql_tokens('clean_text')} as token_counts from (select *, {sql_clean('text')} as clean_text from v_task)"


@query("prepared_label_shares", f"""
with m as ({MEASURED}), kept as (select * from m where token_counts >= 5 and token_counts < 4000),
f as (select min(doc_id) as doc_id, clean_text, label from kept group by clean_text, label),
r as (select *, {sql_rank('label', 'doc_id')} as rn, count(*) over (partition by label) as n from f),
s as (select *, floor(n * (1 - 0.2::DOUBLE)) as a, n - floor((n - floor(n * (1 - 0.2::DOUBLE))) * 0.5::DOUBLE) as b from r),
t as (select label, case when rn <= a then 'train' when rn <= b then 'test' else 'dev' end as split from s),
c as (select label, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) filter (split = 'dev') as dev from t group by label)
select label, round(train / sum(train) over (), 6) as train, round(test / sum(test) over (), 6) as test, round(dev / sum(dev) over (), 6) as dev from c
""", ("v_task",))
def prepared_label_shares(t):
    """What is the label share per split after cleaning, filtering, de-duplication and splitting?"""
    kept = op.length_filter(op.measure(t.v_task.select("doc_id", "text", "label")))
    # The split reads its input three times: cut the cleaned and de-duplicated ids off the text work.
    unique = cut_lineage(keep_first(kept, ["text", "label"], "doc_id").select("doc_id", "label"))
    split = stratified_split(unique, "doc_id")
    shares = label_shares(split)
    return shares.select("label", *[F.round(c, 6).alias(c) for c in ("train", "test", "dev")])


@query("clean_and_count", f"select doc_id, clean_text, {sql_tokens('clean_text')} as token_counts from (select doc_id, {sql_clean('text')} as clean_text from documents)")
def clean_and_count(t):
    return op.measure(t.texts.select("doc_id", "text")).select("doc_id", "clean_text", "token_counts")


CONTACTS = " see https://a.example.org/x?y=1&z=2 or WWW.Example.net, mail a.b+c@mail.example.com; call +1 555-123-4567 or (555) 123 4567"


@query("mask_contacts", f"select doc_id, {sql_clean(f'(text || {sql_text(CONTACTS)})')} as masked from documents")
def mask_contacts(t):
    return t.texts.select("doc_id", tx.clean_text(F.concat("text", F.lit(CONTACTS))).alias("masked"))


@query("length_filter", f"select doc_id, clean_text as text, label from ({MEASURED}) where token_counts >= 40 and token_counts < 400", ("v_task",))
def length_filter(t):
    return op.length_filter(op.measure(t.v_task.select("doc_id", "text", "label")), 40, 400)


@query("narrative_paragraphs", "select page_number, filename, type, text from v_para where type = 'NarrativeText' and word_count >= 4", ("v_para",))
def narrative_paragraphs(t):
    return op.narrative_paragraphs(t.v_para)


@query("drop_null_text", f"select doc_id, source_article from (select doc_id, case when {sql_hash_int('doc_id', seed='n')} % 7 > 0 then text end as source_article from documents) where source_article is not null")
def drop_null_text(t):
    from labelforge.functions.hashing import hash_int

    raw = t.documents.select("doc_id", F.when(hash_int("doc_id", seed="n") % 7 > 0, F.col("text")).alias("source_article"))
    return op.drop_technical(op.drop_null(raw, "source_article"))


_PHRASE = "string_split(text, ' ')[1]"


@query("remove_row_phrase", f"""select doc_id, {sql_strip(f"regexp_replace(text, '(?i)' || regexp_replace({_PHRASE}, '([^A-Za-z0-9 \\x80-\\x{{10FFFF}}])', '\\\\\\1', 'g'), '', 'g')")} as text from documents where length({_PHRASE}) > 0""")
def remove_row_phrase(t):
    """The first word of every document, of any script, is its phrase."""
    named = t.texts.withColumn("phrase", F.element_at(F.split("text", " "), 1))
    return named.filter(F.length("phrase") > 0).select("doc_id", tx.remove_phrase("text", "phrase").alias("text"))


@query("normalise_hard", f"select doc_id, {sql_normal(sql_fold('text'))} as text from documents")
def normalise_hard(t):
    return t.texts.select("doc_id", tx.normalise_hard(tx.ascii_fold("text")).alias("text"))


def _table(t, pairs):
    return t.spark.createDataFrame(list(pairs), "key string, value string")


@query("map_labels_lenient", "select doc_id, case lang when 'de' then 'German' when 'fr' then 'French' end as label from documents")
def map_labels_lenient(t):
    df = t.documents.select("doc_id", F.col("lang").alias("label"))
    return op.map_values(df, "label", _table(t, [("de", "German"), ("fr", "French")]))


@query("map_names_identity", "select doc_id, case source when 'src1' then 'Source One' when 'src2' then 'Source Two' else source end as source from documents")
def map_names_identity(t):
    df = t.documents.select("doc_id", "source")
    return op.map_values(df, "source", _table(t, [("src1", "Source One"), ("src2", "Source Two")]), mode="identity")


@query("map_labels_strict", f"select doc_id, case lang {' '.join(f'''when '{a}' then '{b}' ''' for a, b in READABLE.items())} end as label from documents")
def map_labels_strict(t):
    df = t.documents.select("doc_id", F.col("lang").alias("label"))
    return op.map_values(df, "label", _table(t, READABLE.items()), mode="strict")


@query("map_by_last_part", f"""with k as (select a.*, {sql_strip("string_split(case when said is null then 'x' else upper(name) end, ',')[-1]")} as raw from v_answers a)
select item_id, case lower(raw) when 'german' then 'de' when 'english' then 'en' when 'spanish' then 'es' when 'french' then 'fr' end as y_pred from k""", ("v_answers",))
def map_by_last_part(t):
    parsed = t.v_answers.select("item_id", F.coalesce(F.upper(F.translate(F.regexp_extract("content", "^Label: (.*)", 1), "[]", "")), F.lit("x")).alias("said"))
    return op.map_by_last_part(parsed, "said", _table(t, [(v, k) for k, v in READABLE.items()]), "y_pred").select("item_id", "y_pred")


@query("class_names_and_flags", "select vec_id, ['zero', 'one', 'two', 'three'][label + 1] as name, (label > 1)::INTEGER as flag from embeddings")
def class_names_and_flags(t):
    named = op.class_names(t.embeddings, "label", ["zero", "one", "two", "three"], "name")
    return named.select("vec_id", "name", (F.col("label") > 1).cast("int").alias("flag"))


_STANCE = f"[{', '.join(repr(s) for s in STANCES)}]"


@query("relax_stance", f"""select o_orderkey, case s when 'strongly_supporting' then 'supporting' when 'supporting' then 'supporting'
 when 'no_position_or_mixed_position' then 'no_position' else 'not_supporting' end as stance
 from (select o_orderkey, ({_STANCE})[substr(o_orderpriority, 1, 1)::INTEGER] as s from orders)""")
def relax_stance(t):
    place = F.substring("o_orderpriority", 1, 1).cast("int")
    df = t.orders.select("o_orderkey", F.element_at(F.array(*[F.lit(s) for s in STANCES]), place).alias("stance"))
    return op.relax_stance(df)


@query("parse_string_list", "select doc_id, array_to_string(label, '|') as label, len(label)::INTEGER as n from v_multi", ("v_multi",))
def parse_string_list(t):
    printed = t.v_multi.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("label", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")).alias("s"))
    return printed.select("doc_id", tx.parse_string_list("s").alias("l")).select("doc_id", F.array_join("l", "|").alias("label"), F.size("l").alias("n"))


@query("parse_votes", "select doc_id, worker_0 as v1, worker_1 as v2, worker_2 as v3 from v_votes", ("v_votes",))
def parse_votes(t):
    quoted = [F.coalesce(F.concat(F.lit("'"), F.col(f"worker_{k}"), F.lit("'")), F.lit("'None'")) for k in range(3)]
    printed = t.v_votes.select("doc_id", F.concat(F.lit("{'entropy': 0.5, 'votes': ["), F.concat_ws(", ", *quoted), F.lit("]}")).alias("s"))
    v = printed.select("doc_id", tx.parse_votes("s").alias("v"))
    return v.select("doc_id", *[F.get("v", F.lit(k)).alias(f"v{k + 1}") for k in range(3)])


@query("orders_by_year", 'select year("Date")::INTEGER as year, count(*) as n from v_time group by all', ("v_time",))
def orders_by_year(t):
    return t.v_time.groupBy(F.year("Date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


_GRAMS = f"""docs as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from documents),
grams as (select doc_id, lang, unnest(list_transform(range(1, len(w) + 1), lambda i: substr('^' || w || '$', i, 3))) as gram from docs),
counts as (select lang, gram, count(*) as n from grams group by all),
prof as (select gram, lang, ln((n + 1) / (sum(n) over (partition by lang) + count(*) over (partition by lang))) as score from counts)"""


@query("language_profiles", f"with {_GRAMS} select gram, lang, round(score, 6) as score from prof")
def language_profiles(t):
    return language.fit_profiles(t.texts).select("gram", "lang", F.round("score", 6).alias("score"))


@query("detect_language", f"""with {_GRAMS},
per as (select doc_id, gram, count(*) as n from grams group by all),
langs as (select distinct lang from prof),
s as (select p.doc_id, l.lang, sum(p.n * coalesce(f.score, -12.0)) / sum(p.n) as score from per p cross join langs l left join prof f on f.gram = p.gram and f.lang = l.lang group by all),
b as (select doc_id, max(score) as score, arg_max(lang, score) as language from s group by doc_id)
select d.doc_id, b.language, case when coalesce(length(regexp_replace(d.text, '[^\\p{{L}}\\s]', '', 'g')) / greatest(length(d.text), 1), 0) < 0.5 then 'noise'
 when coalesce(b.score, -12.0) < -9.5 then 'word salad' else 'clean' end as gibberish from documents d left join b using (doc_id)""")
def detect_language(t):
    docs = t.texts.select("doc_id", "text", "lang")
    return language.detect(docs.select("doc_id", "text"), language.fit_profiles(docs), "doc_id").select("doc_id", "language", "gibberish")
