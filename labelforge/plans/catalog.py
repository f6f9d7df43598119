"""The task catalogue: which tasks there are, what their tables look like, and what their labels are called."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.sources.writers import remaining, upsert

# Public data sets by task kind.
SINGLE = [
    "netzero_reduction", "climate_specificity", "climate_sentiment", "climate_commitments_actions", "climate_detection",
    "climate_tcfd_recommendations", "climatext", "climatext_wiki", "climatext_claim", "climatext_10k", "environmental_claims",
    "ClimaTOPIC", "climateFEVER_claim", "climateBUG_data", "lobbymap_pages", "sustainable_signals_review", "esgbert_e",
    "esgbert_s", "esgbert_g", "esgbert_action500", "esgbert_category_water", "esgbert_category_forest",
    "esgbert_category_biodiversity", "esgbert_category_nature", "sciDCC", "green_claims", "green_claims_3",
    "contrarian_claims", "climateStance", "climateEng", "ClimaINS", "ClimaINS_ours", "gw_stance_detection",
]
MULTILABEL = ["lobbymap_query", "logicClimate"]
STANCE = ["lobbymap_stance"]
RELATION = ["climateFEVER_evidence", "climateFEVER_evidence_climabench", "climaQA"]
NAMES = SINGLE + RELATION + STANCE + MULTILABEL
WATER_FILLED = ["contrarian_claims", "ClimaTOPIC"]
WEIGHTED_LOSS = [
    "contrarian_claims", "climateStance", "climateEng", "climate_tcfd_recommendations", "climateFEVER_evidence",
    "climateFEVER_evidence_climabench", "sciDCC", "logicClimate",
]

# Labels that count as a yes in votes, and stances by label.
POSITIVE = {
    "climatext_10k": "1", "climatext_claim": "1", "climatext_wiki": "1", "climatext": "1", "climateBUG_data": "climate",
    "climate_detection": "yes", "green_claims": "green_claim", "environmental_claims": "1",
    "sustainable_signals_review": "Relevant",
}
STANCES = {
    "climateStance": {"0": "Neutral", "1": "Support", "2": "Denies"},
    "gw_stance_detection": {"neutral": "Neutral", "agrees": "Support", "disagrees": "Denies"},
}
# Task groups of the report functions.
CLIMATE_TASKS = [
    "climatext_10k", "climatext_claim", "climatext_wiki", "climatext", "climateBUG_data", "climate_detection",
    "sustainable_signals_review",
]
TOPIC_TASKS = [
    "climate_tcfd_recommendations", "ClimaTOPIC", "esgbert_category_biodiversity", "esgbert_category_forest",
    "esgbert_category_nature", "esgbert_category_water", "esgbert_e", "esgbert_s", "esgbert_g", "sciDCC", "climateEng",
]
CLAIM_TASKS = ["green_claims", "environmental_claims"]
CHARACTERISTIC_TASKS = [
    "green_claims_3", "climate_sentiment", "climate_specificity", "climate_commitments_actions", "netzero_reduction",
    "esgbert_action500",
]
STANCE_TASKS = ["climateStance", "gw_stance_detection"]
# Readable labels.
READABLE = {
    "esgbert_category_biodiversity": {"0": "Not-biodiversity", "1": "Biodiversity"},
    "esgbert_category_forest": {"0": "Not-forest", "1": "Forest"},
    "esgbert_category_nature": {"0": "Not-nature", "1": "Nature"},
    "esgbert_category_water": {"0": "Not-water", "1": "Water"},
    "esgbert_e": {"0": "Not-environment", "1": "Environment"},
    "esgbert_s": {"0": "Not-social", "1": "Social"},
    "esgbert_g": {"0": "Not-governance", "1": "Governance"},
    "climateEng": {"0": "General", "1": "Politics", "2": "Ocean/Water", "3": "Agriculture/Forestry", "4": "Disaster"},
    "climate_commitments_actions": {"no": "not-commitment/action", "yes": "commitment/action"},
    "esgbert_action500": {"0": "Not-action", "1": "Action"},
    "climateStance": {"0": "Neutral/Ambiguous", "1": "Support", "2": "Denies"},
    "contrarian_claims": {
        "0_0": "No claim, No claim",
        "1_1": "Global warming is not happening, Ice/permafrost/snow cover isn’t melting",
        "1_2": "Global warming is not happening, We’re heading into an ice age/global cooling",
        "1_3": "Global warming is not happening, Weather is cold/snowing",
        "1_4": "Global warming is not happening, Climate hasn’t warmed/changed over the last (few) decade(s)",
        "1_6": "Global warming is not happening, Sea level rise is exaggerated/not accelerating",
        "1_7": "Global warming is not happening, Extreme weather isn’t increasing/has happened before/isn’t linked to climate change",
        "2_1": "Human greenhouse gases are not causing climate change, It’s natural cycles/variation",
        "2_3": "Human greenhouse gases are not causing climate change, There’s no evidence for greenhouse effect/carbon dioxide driving climate change",
        "3_1": "Climate impacts/global warming is beneficial/not bad, Climate sensitivity is low/negative feedbacks reduce warming",
        "3_2": "Climate impacts/global warming is beneficial/not bad, Species/plants/reefs aren’t showing climate impacts/are benefiting from climate change",
        "3_3": "Climate impacts/global warming is beneficial/not bad, CO2 is beneficial/not a pollutant",
        "4_1": "Climate solutions won’t work, Climate policies (mitigation or adaptation) are harmful",
        "4_2": "Climate solutions won’t work, Climate policies are ineffective/flawed",
        "4_4": "Climate solutions won’t work, Clean energy technology/biofuels won’t work",
        "4_5": "Climate solutions won’t work, People need energy (e.g. from fossil fuels/nuclear)",
        "5_1": "Climate movement/science is unreliable, Climate-related science is unreliable/uncertain/unsound (data, methods & models)",
        "5_2": "Climate movement/science is unreliable, Climate movement is unreliable/alarmist/corrupt",
    },
}
# Near-miss answers and the label they mean; answers kept to their first word; defaults of unparsable answers.
ANSWER_ALIASES = {
    "Climate solutions won’t work, Climate policies are harmful": READABLE["contrarian_claims"]["4_1"],
    "Climate solutions won’t work, One country is negligible": READABLE["contrarian_claims"]["4_2"],
}
TASK_ALIASES = {"climate_tcfd_recommendations": {"general": "none"}}
FIRST_WORD_TASKS = ["ClimaINS_ours"]
ANSWER_DEFAULTS = {
    "netzero_reduction": "none",
    "lobbymap_pages": "The page does not contain evidence about the stance of the company regarding any of the policy",
    "logicClimate": "None",
}
# Policy queries and their display names.
POLICY_QUERIES = {
    "alignment_with_ipcc_on_climate_action": "Alignment with IPCC on climate action",
    "carbon_tax": "Carbon tax",
    "communication_of_climate_science": "Communication of climate science",
    "disclosure_on_relationships": "Disclosure on relationships",
    "emissions_trading": "Emissions trading",
    "energy_and_resource_efficiency": "Energy and resource efficiency",
    "energy_transition_&_zero_carbon_technologies": "Energy transition & zero carbon technologies",
    "ghg_emission_regulation": "GHG emission regulation",
    "land_use": "Land use",
    "renewable_energy": "Renewable energy",
    "support_of_un_climate_process": "Support of UN climate process",
    "supporting_the_need_for_regulations": "Supporting the need for regulations",
    "transparency_on_legislation": "Transparency on legislation",
}


# Display names; other names are shown as they are.
DISPLAY_NAMES = {
    "climateFEVER_claim": "climateFEVER claim (our split)",
    "climateFEVER_claim_agg": "climateFEVER claim (ours split, aggregated)",
    "climateFEVER_claim_climabench_agg": "climateFEVER claim (climabench split, aggregated)",
    "climateFEVER_evidence_ours": "climateFEVER evidence (our split)",
    "climateFEVER_evidence_climabench": "climateFEVER evidence (climabench split)",
    "netzero_reduction_duplicated": "Net-Zero/Reduction (with duplicates)",
    "netzero_reduction": "Net-Zero/Reduction",
    "ClimaINS_ours": "ClimaINS (our split)",
    "climateFEVER_evidence": "climateFEVER evidence",
    "climateBUG_data": "climateBUG-data",
    "climate_commitments_actions": "Commitments And Actions",
    "climate_detection": "ClimateBERT's Climate detection",
    "climate_specificity": "Climate Specificity",
    "climate_sentiment": "climate sentiment",
    "climate_tcfd_recommendations": "Climate TCFD recommendations",
    "esgbert_category_water": "esgbert Water",
    "esgbert_category_forest": "esgbert Forest",
    "esgbert_category_biodiversity": "esgbert Biodiversity",
    "esgbert_category_nature": "esgbert Nature",
    "environmental_claims": "Environmental Claims",
    "green_claims": "Green Claims",
    "green_claims_3": "Implicit/Explicit Green Claims",
    "contrarian_claims": "CC-Contrarian Claims",
    "esgbert_e": "ESGBERT E",
    "esgbert_s": "ESGBERT S",
    "esgbert_g": "ESGBERT G",
    "gw_stance_detection": "Global-Warming Stance (GWSD)",
    "sustainable_signals_review": "SUSTAINABLESIGNALS reviews",
    "lobbymap_stance": "LobbyMap (Stance)",
    "lobbymap_query": "LobbyMap (Query)",
    "lobbymap_pages": "LobbyMap (Pages)",
    "lobbymap_query_p": "LobbyMap (Page)",
    "lobbymap_query_stance": "LobbyMap (Stance)",
    "climatext": "climatext (Wiki-doc)",
    "climatext_wiki": "climatext (Wikipedia)",
    "climatext_10k": "climatext (10k)",
    "climatext_claim": "climatext (claim)",
    "esgbert_action500": "ESGBERT action500",
}


@dataclass(frozen=True)
class TaskSpec:
    """Settings of one task."""

    name: str
    kind: str = "classification"
    trainer: str = "text"
    stratify_on: str | None = "label"
    label: str = "label"
    inputs: tuple[str, ...] = ("text",)
    balance: str = "balanced"
    weighted_loss: bool = False


# What differs from the defaults above, by kind.
_KINDS = {
    "classification": (SINGLE, {}),
    "relation": (RELATION, {"trainer": "pair", "stratify_on": "query", "inputs": ("text", "query"), "balance": "random"}),
    "stance": (STANCE, {"trainer": "query_onehot", "inputs": ("text", "query")}),
    "multilabel": (MULTILABEL, {"trainer": "multilabel", "stratify_on": None}),
}


def specs(wanted: Sequence[str] | None = None, overrides: Mapping[str, Mapping] | None = None) -> list[TaskSpec]:
    """All specs, or the wanted ones in the wanted order (unknown names are left out)."""
    known = {}
    for kind, (names, settings) in _KINDS.items():
        for name in names:
            spec = TaskSpec(name=name, kind=kind, weighted_loss=name in WEIGHTED_LOSS, **settings)
            if name in WATER_FILLED:
                spec = replace(spec, balance="weighted")
            known[name] = replace(spec, **(overrides or {}).get(name, {}))
    return [known[n] for n in (wanted if wanted is not None else known) if n in known]


def inputs_of(name: str) -> tuple[str, ...]:
    """Input columns of a task; names outside the catalogue have one text."""
    found = specs([name])
    return found[0].inputs if found else ("text",)


def catalogue(spark: SparkSession, wanted: Sequence[str] | None = None) -> DataFrame:
    """The specs as a table."""
    rows = [tuple(asdict(s).values()) for s in specs(wanted)]
    return spark.createDataFrame(
        rows, "name string, kind string, trainer string, stratify_on string, label string, inputs array<string>, balance string, weighted_loss boolean"
    )


def to_run(table: DataFrame, log: DataFrame, seed: int) -> DataFrame:
    """Catalogue rows the log has no result for under this seed."""
    return remaining(table.withColumnRenamed("name", "dataset_name"), log, seed).withColumnRenamed("dataset_name", "name")


def override(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace catalogue rows by name."""
    return upsert(table, changes, "name")


def positives(spark: SparkSession, tasks: Sequence[str]) -> DataFrame:
    """(task, positive) of yes/no tasks; a task without a positive label is an error."""
    missing = [t for t in tasks if t not in POSITIVE]
    if missing:
        raise ValueError(f"no positive label for {missing}")
    return spark.createDataFrame([(t, POSITIVE[t]) for t in tasks], "task string, positive string")


def unseen_positives(predictions: DataFrame, positive: DataFrame) -> DataFrame:
    """Tasks whose positive label no row of the data has: a catalogue that does not fit the data."""
    seen = predictions.select("task", F.col("y_pred").alias("positive")).distinct()
    return positive.join(seen, ["task", "positive"], "left_anti")


def readable_labels(spark: SparkSession) -> DataFrame:
    """(task, y_pred, value)."""
    rows = [(t, k, v) for t, names in READABLE.items() for k, v in names.items()]
    return spark.createDataFrame(rows, "task string, y_pred string, value string")


def stance_labels(spark: SparkSession) -> DataFrame:
    """(task, y_pred, stance)."""
    rows = [(t, k, v) for t, names in STANCES.items() for k, v in names.items()]
    return spark.createDataFrame(rows, "task string, y_pred string, stance string")


def display_names(spark: SparkSession) -> DataFrame:
    """(key, value) for an identity mapping of task names."""
    return spark.createDataFrame(list(DISPLAY_NAMES.items()), "key string, value string")
