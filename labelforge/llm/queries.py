"""The numbered queries: each applies its operator to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import conversations, decontaminate, fingerprints, forest, lm, mixing, negatives, pii, quality, simhash, tokens, toxicity, warc
from labelforge.llm.common import crc_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register ``fn`` under its name."""
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak supervision; labels of the held-out third are never read into a model."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained_on(docs, table(spark, sf_dir, "labels"), crc_of("doc_id") % 3 != 1)
    scored = toxicity.score(docs.select("doc_id", "text"), model, "text", "score")
    return scored.select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-mixing range coder; the result is read from the files."""
    manifest = tokens.write(table(spark, sf_dir, "documents"), tokens.public_tokenizer())
    return tokens.read(spark, manifest)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covering locality-sensitive hashing within 4 bits."""
    found = simhash.groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wu-Manber search for all windows of 10 benchmark words."""
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multivariate-hypergeometric splitting tree over block quotas."""
    drawn = mixing.draws(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


@query
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-prefix forest; every hundredth vector asks, all vectors answer."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.search(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP-packaged WARC archives, written and read back."""
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from q)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from r
"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention-based multiple-instance learning; labels of the held-out fifth are never read into a model."""
    docs = table(spark, sf_dir, "documents")
    net = quality.trained_on(docs, table(spark, sf_dir, "labels"), crc_of("doc_id") % 5 != 0)
    scored = quality.score(docs.select("doc_id", "text"), net, "text", "score")
    return scored.select("doc_id", (crc_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-supervision aggregation in DataFrame functions."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.counted(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated recurrent language model; documents of the held-out seventh are scored, not learned from."""
    found = lm.score(table(spark, sf_dir, "documents"), crc_of("doc_id") % 7 != 2)
    return found.withColumn("held_out", crc_of("doc_id") % 7 == 2)


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, damaged as the contract says, repaired by iterative-deepening A*."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix polynomial hashes of each text and of the text that ends like the next one begins."""
    found = fingerprints.compare_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment summaries; every seventh row's label is first moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", label.alias("label")))


ORACLES["op13_hard_negatives"] = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
