"""Mixing sources to target weights: exact block quotas, dealt to output shards by a multivariate-hypergeometric splitting tree.

A source's target is met by whole epochs of the source and a remainder. The documents of a source lie in about
sqrt(count)/4 blocks by hash, the blocks in a permuted order; the remainder takes blocks in that order, and documents of the
last one in hash order. The blocks that a source gives are its quota. The tree cuts the shards in halves, and draws how
many blocks of each source go left from the multivariate hypergeometric law (what dealing all blocks at random would
give) until one shard is left; the quotas stay exact. Every shard then takes the next blocks of each source's order, so that
no block goes out twice in an epoch, and orders its documents by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import free_name, written
from labelforge.operators.attach import attach_small

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
#: Words of an output shard.
SHARD_WORDS = 50_000_000


def size_of(text: Column) -> Column:
    """Number of runs of signs that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: np.ndarray, weights: np.ndarray, most_times: float = MOST_TIMES) -> np.ndarray:
    """Targets that share the total of ``sizes`` by ``weights``, none above ``most_times`` its size; the excess goes by weight."""
    sizes = sizes.astype(float)
    target, caps = np.zeros(len(sizes)), most_times * sizes
    free = sizes > 0
    left = sizes.sum()
    while free.any():
        share = np.where(free, left * weights / weights[free].sum(), 0.0)
        over = free & (share > caps)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return target


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] dealt to ``shards``: a table [source, shard] with exact row sums and even shards."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    first = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals") if quotas.sum() else quotas
    return np.hstack([split_tree(first, left, rng), split_tree(quotas - first, shards - left, rng)])


def _targets(weights: tuple[float, ...], most_times: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # one row per source, so one task: names of sources, not documents
        rows = rows.assign(raw=[None if x is None else x.encode() for x in rows["source"]], none=rows["source"].isna())
        rows = rows.sort_values(["none", "raw"], key=None, kind="stable").reset_index(drop=True)
        sizes = rows["source_size"].to_numpy(np.int64)
        w = np.resize(np.array(weights, float), len(rows))
        target = water_fill(sizes, w, most_times)
        times = np.divide(target, sizes, out=np.zeros(len(rows)), where=sizes > 0)
        epochs = np.minimum(np.floor(times + 1e-12), most_times).astype(np.int64)
        rows["target"], rows["epochs"] = target, epochs
        rows["remainder"] = np.where(epochs >= most_times, 0.0, np.maximum(target - epochs * sizes, 0.0))
        rows["blocks"] = np.maximum(1, np.ceil(np.sqrt(rows["n"].to_numpy(float)) / 4)).astype(np.int64)
        return rows[["source", "source_size", "target", "epochs", "remainder", "blocks"]]

    return run


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of one source in permuted order: place, and 1 if the remainder takes it, 2 if it takes a part (``part`` words)."""
    rows = rows.sort_values(["lot", "block"]).reset_index(drop=True)
    words, left = rows["words"].to_numpy(np.int64), float(rows["remainder"].iloc[0])
    upto = np.cumsum(words)
    take = (upto <= left).astype(np.int64)
    if left <= 0:
        take[:] = 0
    edge = int(take.sum())
    rows["part"] = 0.0
    if left > 0 and edge < len(rows):
        take[edge] = 2
        rows.loc[edge, "part"] = left - (upto[edge - 1] if edge else 0)
    rows["take"], rows["place"] = take, np.arange(len(rows))
    return rows[["source", "block", "epochs", "place", "take", "part"]]


def _close(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block that is taken in part: documents in hash order while they fit, then each that still fits, then the one that brings the sum nearest."""
    sizes = rows.groupby("lot", sort=True)["size"].sum()  # ties of the lot go together
    lots, words, left = sizes.index.to_numpy(np.int64), sizes.to_numpy(np.int64), float(rows["part"].iloc[0])
    whole = int((np.cumsum(words) <= left).sum())
    left -= float(words[:whole].sum())
    extra, rest = [], []
    for lot, size in zip(lots[whole:].tolist(), words[whole:].tolist(), strict=True):
        if size <= left:
            extra.append(lot)
            left -= size
        else:
            rest.append((lot, size))
    best = min(((abs(size - left), lot) for lot, size in rest), default=(left, 0))
    if best[0] < left:
        extra.append(best[1])
    cut = int(lots[whole - 1]) if whole else None
    out = pd.DataFrame({"source": rows["source"].iloc[:1], "block": rows["block"].iloc[:1]}).reset_index(drop=True)
    return out.assign(cut=pd.array([cut], "Int64"), extra=[extra])


def _deal(shards: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # one row per source
        rows = rows.assign(none=rows["source"].isna()).sort_values(["none", "source"]).reset_index(drop=True)
        table = split_tree(rows["quota"].to_numpy(np.int64), shards, np.random.default_rng(seed))
        return pd.DataFrame({"source": rows["source"], "upto": list(np.cumsum(table, axis=1))})

    return run


def _shards(rows: pd.DataFrame) -> pd.DataFrame:
    """The shard of every (epoch, block) of one source: epoch by epoch in block order, and the remainder last."""
    rows = rows.sort_values("place").reset_index(drop=True)
    upto, n, epochs = np.asarray(rows["upto"].iloc[0]), len(rows), int(rows["epochs"].iloc[0])
    draws = (np.arange(epochs)[:, None] * n + np.arange(n)[None, :]).reshape(epochs, n)
    whole = np.searchsorted(upto, draws, side="right")
    last = np.searchsorted(upto, epochs * n + rows["place"].to_numpy(), side="right")
    rows["shards"] = [whole[:, i].astype(np.int64).tolist() for i in range(n)]
    rows["last_shard"] = np.where(rows["take"].to_numpy() > 0, last, -1)
    return rows[["source", "block", "take", "part", "shards", "last_shard"]]


def _sized(docs: DataFrame, key: str, source: str, text: str, seed: int, names: dict[str, str]) -> DataFrame:
    """``docs`` with id, source, size and lot (the place in hash order) under ``names``."""
    given = {
        "doc_id": F.col(key).cast("long"), "source": F.col(source).cast("string"), "size": size_of(F.col(text)),
    }
    for c, value in given.items():
        docs = docs.withColumn(names[c], value)
    return docs.withColumn(names["lot"], F.xxhash64(F.lit(seed), F.coalesce(F.col(names["doc_id"]), F.lit(-1)), names["size"]))


def _plan(rows: DataFrame, weights: tuple[float, ...], most_times: float, shard_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """For rows (source, size, lot): a table by source (target) and one by source and block (shards of its copies)."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = per_source.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(
        _targets(weights, most_times), "source string, source_size long, target double, epochs long, remainder double, blocks long"
    )
    plan = written(plan, "targets")
    rows = attach_small(rows, plan.select("source", "blocks"), ["source"], "inner").withColumn("block", _block())
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = attach_small(blocks, plan.select("source", "epochs", "remainder"), ["source"], "inner")
    blocks = blocks.withColumn("lot", F.xxhash64(F.lit(seed), "source", "block"))
    chosen = written(blocks.groupBy("source").applyInPandas(_choose, "source string, block long, epochs long, place long, take long, part double"), "blocks")
    total = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_words))
    quotas = chosen.groupBy("source").agg(F.sum(F.col("epochs") + F.when(F.col("take") > 0, 1).otherwise(0)).alias("quota"))
    dealt = quotas.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_deal(n_shards, seed), "source string, upto array<long>")
    placed = attach_small(chosen, dealt, ["source"], "inner").groupBy("source").applyInPandas(
        _shards, "source string, block long, take long, part double, shards array<long>, last_shard long"
    )
    # only the one block of each source that the remainder takes in part is ordered; ties of the lot go together
    part = chosen.filter("take = 2").select("source", "block", "part")
    edge = attach_small(rows.select("source", "block", "size", "lot"), part, ["source", "block"], "inner")
    closed = edge.groupBy("source", "block").applyInPandas(_close, "source string, block long, cut long, extra array<long>")
    placed = attach_small(placed.drop("part"), closed, ["source", "block"])
    return plan, written(placed, "draws")


def _block() -> Column:
    return F.pmod(F.xxhash64("lot", F.lit("block")), F.col("blocks"))


def _drawn(rows: DataFrame, plan: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (source, size, lot, ..) with source_size, target and shards, one entry per copy."""
    rows = attach_small(rows, plan.select("source", "source_size", "target", "blocks"), ["source"], "inner").withColumn("block", _block())
    rows = attach_small(rows, placed, ["source", "block"], "inner")
    edge = F.coalesce(F.col("lot") <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("extra", F.col("lot")), F.lit(False))
    last = (F.col("take") == 1) | ((F.col("take") == 2) & edge)
    every = F.when(last, F.concat("shards", F.array("last_shard"))).otherwise(F.col("shards"))
    return rows.withColumn("shards", every).drop("blocks", "block", "take", "last_shard", "cut", "extra")


_OWN = ("doc_id", "source", "size", "lot")


def draws(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    most_times: float = MOST_TIMES,
    shard_words: int = SHARD_WORDS,
    seed: int = 42,
) -> DataFrame:
    """doc_id, source, size, source_size, target and shards (one entry per copy) of every row.

    Sources in code-point order, null last, weigh ``weights``, repeating. The sum of all sizes is shared by weight, a
    source at most ``most_times`` times its own; the excess is shared again until none is above. ``shards`` says which
    output shard each copy goes to; an empty list means that the mix leaves the document out. A document without words has
    size 0 and follows its block. Null ids are drawn like others. Rows that repeat in id and size share their fate. Reruns
    agree: order and place come from hashes of id, source and size. No rows: no draws.
    """
    rows = _sized(docs, key, source, text, seed, {c: free_name(docs, f"__{c}") for c in _OWN})
    rows = written(rows.select(*[F.col(free_name(docs, f"__{c}")).alias(c) for c in _OWN]), "sizes")
    plan, placed = _plan(rows.drop("doc_id"), weights, most_times, shard_words, seed)
    return _drawn(rows, plan, placed).drop("lot")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    most_times: float = MOST_TIMES,
    shard_words: int = SHARD_WORDS,
    seed: int = 42,
) -> DataFrame:
    """The mixed documents: the columns of ``docs``, each row as often as it is drawn (see :func:`draws`).

    The rows of a shard stand in hash order in one partition; texts are shuffled once, to their shards.
    """
    rows = _sized(docs, key, source, text, seed, {c: free_name(docs, f"__{c}") for c in _OWN})
    sizes = written(rows.select(*[F.col(free_name(docs, f"__{c}")).alias(c) for c in _OWN[1:]]), "sizes")
    plan, placed = _plan(sizes, weights, most_times, shard_words, seed)
    # given columns go into one struct, so that none clashes with the operator's own
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), *[F.col(free_name(docs, f"__{c}")).alias(c) for c in _OWN[1:]]
    )
    out = _drawn(packed, plan, placed).select("given", "lot", F.posexplode("shards").alias("copy", "shard"))
    shards = placed.select(F.explode(F.concat("shards", F.array("last_shard"))).alias("s")).agg(F.max("s")).first()[0]
    out = out.repartition((shards or 0) + 1, "shard").sortWithinPartitions("shard", F.xxhash64("lot", "copy"), "lot")
    return out.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])
