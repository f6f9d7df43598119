"""The test tables as benchmark material: task tables, predictions, votes, evidences, responses.

Every view exists twice, as a DataFrame and as SQL; derived labels come from the seeded hash of a stable id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions.hashing import hash_int
from labelforge.plans.registry import sql_hash_int as HI

RING = {"de": "en", "en": "es", "es": "fr", "fr": "de"}
STANCES = ["strongly_supporting", "supporting", "no_position_or_mixed_position", "not_supporting", "opposing"]
READABLE = {"de": "Group A, German", "en": "Group A, English", "es": "Group B, Spanish", "fr": "Group B, French"}
N_WORKERS = 8


def next_label(c: Column) -> Column:
    """The following language."""
    return F.create_map(*[F.lit(x) for pair in RING.items() for x in pair])[c]


def perturbed(label: str, key: str, seed: str) -> Column:
    """The label with about 20 % of errors and 1 % missing."""
    h = hash_int(key, seed=seed)
    return F.when(h % 100 == 0, F.lit(None)).when(h % 10 < 8, F.col(label)).otherwise(next_label(F.col(label)))


def sql_next(c: str) -> str:
    """The following language in SQL."""
    return f"(case {c} " + " ".join(f"when '{a}' then '{b}'" for a, b in RING.items()) + " end)"


def sql_perturbed(label: str, key: str, seed: str) -> str:
    """The perturbed label in SQL."""
    h = HI(key, seed=seed)
    return f"(case when {h} % 100 = 0 then null when {h} % 10 < 8 then {label} else {sql_next(label)} end)"


class Tables:
    """The parquet tables of one folder, and the views."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """``documents`` for queries that work hard on every text.

        Where the scan has fewer tasks than the session has cores (a file of one row group is one task), rows are spread
        over the cores first; a table in many files or row groups is not shuffled.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return self.documents.repartition(cores) if self.documents.rdd.getNumPartitions() < cores else self.documents

    @cached_property
    def v_task(self) -> DataFrame:
        labels = self.labels.select("doc_id", F.col("quality").cast("string").alias("label"))
        return self.texts.select("doc_id", "text", "lang", "source").join(labels, "doc_id")

    @cached_property
    def v_lang(self) -> DataFrame:
        return self.documents.select("doc_id", "text", "source", F.col("lang").alias("label"))

    @cached_property
    def v_multi(self) -> DataFrame:
        flags = F.array_compact(F.array(
            F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")),
            F.when(hash_int("doc_id", seed="m") % 3 == 0, F.lit("long")),
        ))
        return self.labels.select("doc_id", flags.alias("label"))

    @cached_property
    def v_multi_pred(self) -> DataFrame:
        keep = F.filter("label", lambda x: hash_int("doc_id", x, seed="mp") % 10 < 7)
        extra = F.when(hash_int("doc_id", seed="mx") % 5 == 0, F.array(F.lit("toxic"))).when(
            hash_int("doc_id", seed="mx") % 5 == 1, F.array(F.lit("unseen"))
        ).otherwise(F.array().cast("array<string>"))
        return self.v_multi.select("doc_id", F.col("label").alias("y_true"), F.array_union(keep, extra).alias("y_pred"))

    def v_pred_of(self, seed: str) -> DataFrame:
        return self.documents.select(
            "doc_id", "source", F.col("lang").alias("y_true"), perturbed("lang", "doc_id", seed).alias("y_pred")
        )

    @cached_property
    def v_pred(self) -> DataFrame:
        return self.v_pred_of("p1")

    @cached_property
    def v_votes(self) -> DataFrame:
        def worker(k: int) -> Column:
            h = hash_int("doc_id", seed=f"w{k}")
            return (
                F.when(h % 10 < 5, F.col("lang")).when(h % 10 < 8, next_label(F.col("lang"))).when(h % 10 < 9, F.lit("en"))
            ).alias(f"worker_{k}")

        return self.documents.select("doc_id", F.col("lang").alias("y_true"), *[worker(k) for k in range(N_WORKERS)])

    @cached_property
    def v_para(self) -> DataFrame:
        lines = self.texts.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        kind = F.when(hash_int("doc_id", "pos", seed="t") % 10 < 8, "NarrativeText").otherwise("Title")
        words = F.size(F.split(F.trim("text"), " +"))
        return lines.select(
            "doc_id", F.col("source").alias("filename"), "pos", F.floor(F.col("pos") / 4).cast("int").alias("page_number"), "text",
            kind.alias("type"), words.cast("int").alias("word_count"),
        )

    @cached_property
    def v_pairs(self) -> DataFrame:
        turn = self.conversations
        ask = turn.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
        answer = turn.filter("role = 'assistant'").select("conv_id", "turn", "text")
        joined = ask.join(answer, ["conv_id", "turn"])
        return joined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "query", "text")

    @cached_property
    def v_dup(self) -> DataFrame:
        return self.documents.select(
            "doc_id", F.col("lang").alias("query"), "text", (hash_int("doc_id", seed="d") % 2).cast("int").alias("label")
        )

    @cached_property
    def v_evid_gold(self) -> DataFrame:
        one = self.lineitem.groupBy(
            F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("query"), F.col("l_linestatus").alias("stance")
        )
        return one.agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages"))

    @cached_property
    def v_evid_pred(self) -> DataFrame:
        h = hash_int("document_id", "query", "stance", seed="e") % 10
        flipped = F.when(F.col("stance") == "F", "O").otherwise("F")
        moved = F.transform("pages", lambda p: p + 1)
        return self.v_evid_gold.withColumn("h", h).filter("h < 9").select(
            "document_id", "query", F.when(F.col("h") >= 7, flipped).otherwise(F.col("stance")).alias("stance"),
            F.when(F.col("h").between(5, 6), moved).otherwise(F.col("pages")).alias("pages"),
        )

    @cached_property
    def v_claims(self) -> DataFrame:
        label = F.create_map(*[F.lit(x) for x in ("F", "SUPPORTS", "O", "REFUTES", "P", "NOT_ENOUGH_INFO")])
        return self.orders.select(
            "o_orderkey", F.col("o_custkey").alias("claim_id"), label[F.col("o_orderstatus")].alias("label"),
            F.when(hash_int("o_custkey", seed="c") % 2 == 0, "DISPUTED").otherwise("SUPPORTS").alias("claim_label"),
        )

    @cached_property
    def v_time(self) -> DataFrame:
        return self.orders.select("o_orderkey", F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("Date"))

    @cached_property
    def v_answers(self) -> DataFrame:
        """Assistant turns as model answers: (item_id, gold, label, content)."""
        readable = F.create_map(*[F.lit(x) for pair in READABLE.items() for x in pair])
        base = self.conversations.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
        gold = F.element_at(F.array(*[F.lit(x) for x in RING]), (hash_int("item_id", seed="g") % 4 + 1).cast("int"))
        rows = base.withColumn("label", gold).withColumn("said", perturbed("label", "item_id", "r1"))
        name = readable[F.col("said")]
        kind = hash_int("item_id", seed="k") % 4
        first = (
            F.when(F.col("said").isNull(), F.lit("No verdict")).when(kind == 0, F.concat(F.lit("Label: "), F.upper(name)))
            .otherwise(F.concat(F.lit("Label: ["), name, F.lit("]")))
        )
        return rows.select("item_id", "label", F.concat(first, F.lit("\nExplanation: "), F.col("text")).alias("content"))

    @cached_property
    def v_carto(self) -> DataFrame:
        logit = lambda j: (hash_int("doc_id", "epoch", seed=f"l{j}") % 1000) / F.lit(200.0)
        epochs = self.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("epoch"))
        return epochs.select(
            "doc_id", "epoch", F.array(*[logit(j) for j in range(4)]).alias("logits"), (hash_int("doc_id", seed="y") % 4).cast("int").alias("label")
        )

    @cached_property
    def v_sheets(self) -> DataFrame:
        """Documents as annotated error sheets."""
        tags = ["error", "wrong", " multi", "debatable", "out-of-context", "implicit", "table,error", "multiple, wrong", "close"]
        pick = lambda seed: F.get(F.array(*[F.lit(t) for t in tags]), (hash_int("doc_id", seed=seed) % len(tags)).cast("int"))
        note = lambda seed: F.concat(pick(seed), F.lit(": see "), F.substring("lang", 1, 2))
        return self.documents.select("doc_id", F.col("source").alias("dataset"), note("s1").alias("comment"), note("s2").alias("comment_b"))

    @cached_property
    def v_scored(self) -> DataFrame:
        """Paragraphs with one column per classifier."""
        h = lambda task, m: hash_int("doc_id", "pos", seed=task) % m
        pick = lambda task, names: F.get(F.array(*[F.lit(n) for n in names]), h(task, len(names)).cast("int"))
        return self.v_para.select(
            "doc_id", "pos", "filename", "page_number", (h("climate", 3) == 0).alias("climate"),
            pick("topic", ["Governance and Data Management", "Energy", "Water", "Waste"]).alias("ClimaTOPIC"),
            pick("sentiment", ["risk", "neutral", "opportunity"]).alias("climate_sentiment"), (h("claim", 4) == 0).alias("environmental_claim"),
            pick("e", ["Environment", "Not-environment", "Not-environment"]).alias("esgbert_e"),
            pick("s", ["Social", "Not-social", "Not-social"]).alias("esgbert_s"),
            pick("g", ["Governance", "Not-governance", "Not-governance"]).alias("esgbert_g"),
            pick("tcfd", ["governance", "metrics", "none", "risk", "strategy"]).alias("climate_tcfd_recommendations"),
            pick("forest", ["Forest", "Not-forest", "Not-forest"]).alias("esgbert_category_forest"),
            pick("bio", ["Biodiversity", "Not-biodiversity"]).alias("esgbert_category_biodiversity"),
            pick("water", ["Water", "Not-water", "Not-water"]).alias("esgbert_category_water"),
            pick("commit", ["commitment/action", "not-commitment/action"]).alias("climate_commitments_actions"),
            pick("specific", ["specific", "non"]).alias("climate_specificity"),
        )


def _pick(keys: tuple[str, ...], task: str, names: list[str]) -> str:
    listed = "[" + ", ".join("'" + n + "'" for n in names) + "]"
    return f"({listed})[({HI(*keys, seed=task)} % {len(names)}) + 1]"


_PP = ("doc_id", "pos")
_TAGS = ["error", "wrong", " multi", "debatable", "out-of-context", "implicit", "table,error", "multiple, wrong", "close"]
_K = "(conv_id * 1000 + turn)"

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_task": ((), "select d.doc_id, d.text, d.lang, d.source, cast(l.quality as varchar) as label from documents d join labels l using (doc_id)"),
    "v_lang": ((), "select doc_id, text, source, lang as label from documents"),
    "v_multi": ((), f"""select doc_id, list_filter([case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end,
        case when {HI('doc_id', seed='m')} % 3 = 0 then 'long' end], lambda x: x is not null) as label from labels"""),
    "v_multi_pred": (("v_multi",), f"""select doc_id, label as y_true, list_distinct(list_concat(
        list_filter(label, lambda x: {HI('doc_id', 'x', seed='mp')} % 10 < 7),
        case {HI('doc_id', seed='mx')} % 5 when 0 then ['toxic'] when 1 then ['unseen'] else [] end)) as y_pred from v_multi"""),
    "v_pred": ((), f"select doc_id, source, lang as y_true, {sql_perturbed('lang', 'doc_id', 'p1')} as y_pred from documents"),
    "v_pred2": ((), f"select doc_id, source, lang as y_true, {sql_perturbed('lang', 'doc_id', 'p2')} as y_pred from documents"),
    "v_pred3": ((), f"select doc_id, source, lang as y_true, {sql_perturbed('lang', 'doc_id', 'p3')} as y_pred from documents"),
    "v_votes": ((), "select doc_id, lang as y_true, " + ", ".join(
        f"case when {HI('doc_id', seed=f'w{k}')} % 10 < 5 then lang when {HI('doc_id', seed=f'w{k}')} % 10 < 8 then {sql_next('lang')} "
        f"when {HI('doc_id', seed=f'w{k}')} % 10 < 9 then 'en' end as worker_{k}" for k in range(N_WORKERS)) + " from documents"),
    "v_votes_long": (("v_votes",), " union all ".join(
        f"select doc_id, y_true, 'worker_{k}' as annotator, worker_{k} as vote from v_votes where worker_{k} is not null" for k in range(N_WORKERS))),
    "v_para": ((), rf"""select doc_id, filename, pos, (pos // 4)::INTEGER as page_number, text,
        case when {HI('doc_id', 'pos', seed='t')} % 10 < 8 then 'NarrativeText' else 'Title' end as type,
        len(regexp_split_to_array(trim(text), ' +'))::INTEGER as word_count
        from (select doc_id, source as filename, unnest(range(len(l))) as pos, unnest(l) as text
              from (select doc_id, source, string_split(text, chr(10)) as l from documents))"""),
    "v_pairs": ((), """select u.conv_id * 1000 + a.turn as pair_id, u.text as query, a.text as text from conversations u join conversations a
        on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'"""),
    "v_dup": ((), f"select doc_id, lang as query, text, ({HI('doc_id', seed='d')} % 2)::INTEGER as label from documents"),
    "v_evid_gold": ((), """select l_orderkey as document_id, l_returnflag as query, l_linestatus as stance,
        list_sort(list(distinct l_linenumber)) as pages from lineitem group by all"""),
    "v_evid_pred": (("v_evid_gold",), f"""select document_id, query,
        case when h >= 7 then (case when stance = 'F' then 'O' else 'F' end) else stance end as stance,
        case when h between 5 and 6 then list_transform(pages, lambda p: p + 1) else pages end as pages
        from (select *, {HI('document_id', 'query', 'stance', seed='e')} % 10 as h from v_evid_gold) where h < 9"""),
    "v_claims": ((), f"""select o_orderkey, o_custkey as claim_id,
        case o_orderstatus when 'F' then 'SUPPORTS' when 'O' then 'REFUTES' when 'P' then 'NOT_ENOUGH_INFO' end as label,
        case when {HI('o_custkey', seed='c')} % 2 = 0 then 'DISPUTED' else 'SUPPORTS' end as claim_label from orders"""),
    "v_time": ((), 'select o_orderkey, o_orderpriority as label, o_orderdate as "Date" from orders'),
    "v_answers": ((), f"""select item_id, label, said, text, name, case when said is null then 'No verdict' when kind = 0 then 'Label: ' || upper(name)
        else 'Label: [' || name || ']' end || chr(10) || 'Explanation: ' || text as content from (
        select *, case said {' '.join(f"when '{a}' then '{b}'" for a, b in READABLE.items())} end as name from (
        select *, {sql_perturbed('label', 'item_id', 'r1')} as said, {HI('item_id', seed='k')} % 4 as kind from (
        select {_K} as item_id, text, (['de','en','es','fr'])[({HI(_K, seed='g')} % 4) + 1] as label from conversations where role = 'assistant')))"""),
    "v_carto": ((), "select doc_id, epoch, [" + ", ".join(f"({HI('doc_id', 'epoch', seed=f'l{j}')} % 1000) / 200.0::DOUBLE" for j in range(4)) + f"""] as logits,
        ({HI('doc_id', seed='y')} % 4)::INTEGER as label from documents, range(5) r(epoch)"""),
    "v_sheets": ((), f"""select doc_id, source as dataset, {_pick(('doc_id',), 's1', _TAGS)} || ': see ' || substr(lang, 1, 2) as comment,
        {_pick(('doc_id',), 's2', _TAGS)} || ': see ' || substr(lang, 1, 2) as comment_b from documents"""),
    "v_scored": (("v_para",), f"""select doc_id, pos, filename, page_number, {HI(*_PP, seed='climate')} % 3 = 0 as climate,
        {_pick(_PP, 'topic', ['Governance and Data Management', 'Energy', 'Water', 'Waste'])} as ClimaTOPIC,
        {_pick(_PP, 'sentiment', ['risk', 'neutral', 'opportunity'])} as climate_sentiment, {HI(*_PP, seed='claim')} % 4 = 0 as environmental_claim,
        {_pick(_PP, 'e', ['Environment', 'Not-environment', 'Not-environment'])} as esgbert_e,
        {_pick(_PP, 's', ['Social', 'Not-social', 'Not-social'])} as esgbert_s,
        {_pick(_PP, 'g', ['Governance', 'Not-governance', 'Not-governance'])} as esgbert_g,
        {_pick(_PP, 'tcfd', ['governance', 'metrics', 'none', 'risk', 'strategy'])} as climate_tcfd_recommendations,
        {_pick(_PP, 'forest', ['Forest', 'Not-forest', 'Not-forest'])} as esgbert_category_forest,
        {_pick(_PP, 'bio', ['Biodiversity', 'Not-biodiversity'])} as esgbert_category_biodiversity,
        {_pick(_PP, 'water', ['Water', 'Not-water', 'Not-water'])} as esgbert_category_water,
        {_pick(_PP, 'commit', ['commitment/action', 'not-commitment/action'])} as climate_commitments_actions,
        {_pick(_PP, 'specific', ['specific', 'non'])} as climate_specificity from v_para"""),
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Put the named views, and those they build on, in front of ``sql``."""
    order: list[str] = []

    def add(name: str) -> None:
        for parent in VIEW_SQL[name][0]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n][1]})" for n in order)
    body = sql.strip()
    for head in ("with recursive ", "with "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"with {ctes}\n{body}"
