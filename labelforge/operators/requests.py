"""Request and response tables of language-model batches. The calls themselves happen elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.answers import (
    ANSWER_PATTERN, PAGES_SLOT, QUERY_SLOT, TEXT_SLOT, extract_prompt, parse_explanation, parse_label,
)
from labelforge.functions.text import last_part
from labelforge.operators.attach import attach_small
from labelforge.operators.cleaning import map_by_last_part, map_values

# Settings of a batch request.
METHOD = "POST"
URL = "/v1/chat/completions"
TEMPERATURE = 0.1
SEED = 42
HELPFUL_SYSTEM = "You are a helpful assistant."
ANNOTATOR_SYSTEM = (
    "You are an AI annotator for NLP tasks related to climate-change. You will be provided with the description of a "
    "tasks. Please follow the instructions."
)

RESPONSE_SCHEMA = (
    "id string, custom_id string, response struct<status_code:int,request_id:string,body:struct<id:string,object:string,"
    "created:bigint,model:string,choices:array<struct<index:int,message:struct<role:string,content:string,refusal:string>,"
    "logprobs:string,finish_reason:string>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,"
    "total_tokens:bigint>,system_fingerprint:string>>, error string"
)
TRANSCRIPT_TYPE = "map<string,array<array<struct<role:string,content:string>>>>"


def fill_prompts(
    rows: DataFrame, prompts: DataFrame, task: str = "task", text: str = "text", query: str | None = None,
    pages: str | None = None,
) -> DataFrame:
    """Add ``content``: the prompt of the row's task (``prompts(task, prompt)``) with its slots filled."""
    joined = attach_small(rows, prompts.select(F.col("task").alias(task), "prompt"), [task])
    content = F.replace(extract_prompt("prompt"), F.lit(TEXT_SLOT), F.col(text))
    if query is not None:
        content = F.replace(content, F.lit(QUERY_SLOT), F.coalesce(F.col(query), F.lit("")))
    if pages is not None:
        content = F.replace(content, F.lit(PAGES_SLOT), F.coalesce(F.col(pages), F.lit("")))
    return joined.withColumn("content", content).drop("prompt")


def label_blocks(catalogue: DataFrame) -> DataFrame:
    """(task, block): the description and one ``- [label]: definition`` line per label.

    ``catalogue(task, description, position, label, definition)``.
    """
    line = F.concat(F.lit("- ["), F.col("label"), F.lit("]: "), F.col("definition"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    blocks = catalogue.groupBy("task", "description").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("lines"))
    head = F.concat(F.lit("description: \n"), F.col("description"), F.lit("\n\nLabels: \n"))
    return blocks.select("task", F.concat(head, "lines").alias("block"))


def lint_prompts(prompts: DataFrame, is_pair: Column) -> DataFrame:
    """(task, problem): the first thing wrong with a prompt; prompts in order are left out. ``is_pair`` marks pair tasks."""
    p = F.col("prompt")
    problem = (
        F.when(~p.rlike(ANSWER_PATTERN), "answer format")
        .when(~F.contains(p, F.lit(TEXT_SLOT)), "no text slot")
        .when(is_pair & ~F.contains(p, F.lit(QUERY_SLOT)), "no query slot")
    )
    return prompts.select("task", problem.alias("problem")).filter(F.col("problem").isNotNull())


def batch_requests(rows: DataFrame, key: str, model: str, content: str = "content", system: str = ANNOTATOR_SYSTEM) -> DataFrame:
    """One JSON request per row in the column ``value``."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.lit(TEMPERATURE).alias("temperature"), F.lit(SEED).alias("seed"),
        F.array(message("system", F.lit(system)), message("user", F.col(content))).alias("messages"),
    )
    request = F.struct(
        F.concat(F.lit("task-"), F.col(key).cast("string")).alias("custom_id"), F.lit(METHOD).alias("method"),
        F.lit(URL).alias("url"), body.alias("body"),
    )
    return rows.select(F.to_json(request).alias("value"))


def read_responses(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON response lines to typed records plus ``content``."""
    parsed = lines.select(F.from_json(value, RESPONSE_SCHEMA).alias("r")).select("r.*")
    return parsed.withColumn("content", F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"])


def pair_responses(rows: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Left join of test rows with their answers by request id."""
    ids = responses.select(F.regexp_extract("custom_id", r"^task-(.*)$", 1).alias("__id"), "content")
    return rows.join(ids, F.col(key).cast("string") == F.col("__id"), "left").drop("__id")


def parse_answers(df: DataFrame, content: str = "content", prefix: str = "model") -> DataFrame:
    """Add ``<prefix>_label`` and ``<prefix>_explanation``."""
    return df.withColumn(f"{prefix}_label", parse_label(content)).withColumn(f"{prefix}_explanation", parse_explanation(content))


def answer_ids(df: DataFrame, label: str, readable: DataFrame, name: str = "y_pred", hierarchical: bool = False) -> DataFrame:
    """Parsed answer to label id through ``readable(key = readable name, value = id)``, ignoring case."""
    if hierarchical:
        return map_by_last_part(df, label, readable, name)
    lowered = readable.select(F.lower("key").alias("key"), "value")
    return map_values(df.withColumn("__low", F.lower(label)), "__low", lowered, name).drop("__low")


def audit(df: DataFrame, readable: DataFrame, content: str = "content", gold: str = "label") -> DataFrame:
    """Raw answer, parsed label, matching key, mapped label and readable gold label side by side."""
    parsed = parse_answers(df, content).withColumn("matching_key", last_part("model_label"))
    mapped = map_by_last_part(parsed, "model_label", readable, "mapped_label")
    names = readable.select(F.col("value").alias("key"), F.col("key").alias("value"))
    return map_values(mapped, gold, names, "gold_text")


def transcript_answers(df: DataFrame, value: str = "value") -> DataFrame:
    """Other columns, task, position and content of a JSON object task -> conversations; the answer is the third message."""
    rest = [c for c in df.columns if c != value]
    parsed = df.select(*rest, F.explode(F.from_json(value, TRANSCRIPT_TYPE)).alias("task", "talks"))
    talks = parsed.select(*rest, "task", F.posexplode("talks").alias("position", "messages"))
    return talks.select(*rest, "task", "position", F.get("messages", F.lit(2))["content"].alias("content"))


def chat_messages(system: Column, user: Column) -> Column:
    """The two-message chat of a local run."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
