"""The numbers behind a report dashboard: one row per paragraph in, small tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shortened topic name, pillar labels and commitment labels.
SHORT_TOPICS = {"Governance and Data Management": "Gov & Data"}
PILLARS = {"Environment": "esgbert_e", "Social": "esgbert_s", "Governance": "esgbert_g"}
NATURE = {"Forest": "esgbert_category_forest", "Biodiversity": "esgbert_category_biodiversity", "Water": "esgbert_category_water"}
COMMITMENT = "commitment/action"
SPECIFIC = "specific"


def _share(cond, among=None):
    """Share of rows where ``cond``, among rows where ``among``; 0 when there are none."""
    rows = F.count_if(among) if among is not None else F.count(F.lit(1))
    hits = F.count_if(cond & among) if among is not None else F.count_if(cond)
    return F.when(rows > 0, hits / rows).otherwise(0.0)


def climate_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Climate and other paragraphs."""
    return df.groupBy(*by).agg(F.count_if("climate").alias("climate"), F.count_if(~F.col("climate")).alias("non_climate"))


def label_share(df: DataFrame, column: str, short: dict[str, str] | None = None) -> DataFrame:
    """Share of every label among climate paragraphs (topics, disclosure recommendations)."""
    value = F.col(column)
    for long_name, short_name in (short or {}).items():
        value = F.when(value == long_name, short_name).otherwise(value)
    counts = df.filter("climate").groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("label is not null")
    return counts.select("label", "n", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


def sentiment_shares(df: DataFrame, column: str = "climate_sentiment") -> DataFrame:
    """Share of every label among climate and among other paragraphs, 0 where absent."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(
        F.count_if("climate").alias("c"), F.count_if(~F.col("climate")).alias("o")
    )
    total = W.partitionBy(F.lit(1))
    share = lambda n: F.coalesce(F.col(n) / F.nullif(F.sum(n).over(total), F.lit(0)), F.lit(0.0))
    return counts.select("label", share("c").alias("climate"), share("o").alias("non_climate"))


def claim_counts(df: DataFrame, claim: str = "environmental_claim") -> DataFrame:
    """Environmental claims among climate and other paragraphs."""
    return df.agg(F.count_if(F.col("climate") & F.col(claim)).alias("climate"), F.count_if(~F.col("climate") & F.col(claim)).alias("non_climate"))


def pillar_percentages(df: DataFrame) -> DataFrame:
    """Percent of paragraphs with a pillar among those with any, for climate paragraphs and overall."""
    flags = {name: F.coalesce(F.col(c) == name, F.lit(False)) for name, c in PILLARS.items()}
    some = flags["Environment"] | flags["Social"] | flags["Governance"]
    cols = []
    for name, flag in flags.items():
        cols.append((_share(flag, some & F.col("climate")) * 100).alias(f"{name}|Climate ESG"))
        cols.append((_share(flag, some) * 100).alias(f"{name}|Overall ESG"))
    return _long(df.agg(*cols), ["pillar", "group"], "percentage")


def nature_shares(df: DataFrame) -> DataFrame:
    """Share of climate paragraphs that mention forest, biodiversity, water."""
    cols = [_share(F.coalesce(F.col(c) == name, F.lit(False)), F.col("climate")).alias(name) for name, c in NATURE.items()]
    return _long(df.agg(*cols), ["topic"], "share")


def commitment_shares(df: DataFrame, claim: str = "environmental_claim") -> DataFrame:
    """Share of commitments, and of specific ones, among claim and other paragraphs."""
    commit = F.coalesce(F.col("climate_commitments_actions") == COMMITMENT, F.lit(False))
    specific = commit & F.coalesce(F.col("climate_specificity") == SPECIFIC, F.lit(False))
    cols = []
    for name, among in (("Env Claims", F.col(claim)), ("Non-Env Claims", ~F.col(claim))):
        cols.append(_share(commit, among).alias(f"Commitment/Action|{name}"))
        cols.append(_share(specific, among).alias(f"Specific Commitment|{name}"))
    return _long(df.agg(*cols), ["measure", "claim_type"], "proportion")


def _long(wide: DataFrame, names: list[str], value: str) -> DataFrame:
    """One row of ``a|b`` columns to long form."""
    long = wide.unpivot([], wide.columns, "__name", value)
    parts = F.split("__name", "[|]")
    return long.select(*[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(names)], value)
