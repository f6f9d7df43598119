"""Language and gibberish labels from letter-trigram profiles learned as a Spark job.

Words are runs of letters of any script. Words are cut into trigrams inside the task and counted map-side. Profiles of
alphabets are small and broadcast after a check; past the bound (many languages, scripts of many signs) they meet the
trigrams in a join that spreads frequent ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.operators.attach import null_safe_join, small_table, spread_join

FLOOR = -12.0  # log probability of a trigram no profile knows
NOISE_LETTERS = 0.5
SALAD_SCORE = -9.5


def _words(text: str):
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))


def _explode_trigrams(df: DataFrame, word: str = "word") -> DataFrame:
    """One row per trigram of a marked word. Two plain generators are compiled, nested array functions are not."""
    places = F.explode(F.sequence(F.lit(1), F.length(word))).alias("i")
    gram = F.substring(F.concat(F.lit("^"), F.col(word), F.lit("$")), F.col("i"), F.lit(3))
    return df.select("*", places).withColumn("gram", gram).drop("i", word)


def fit_profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(gram, lang, score): log of the trigram's share in the language, with one count added to each.

    Words are counted first, so that each distinct word is cut once.
    """
    words = df.select(F.col(lang).alias("lang"), F.explode(_words(text)).alias("word")).groupBy("lang", "word")
    grams = _explode_trigrams(words.agg(F.count(F.lit(1)).alias("n")))
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = counts.groupBy(F.col("lang").alias("of")).agg((F.sum("n") + F.count(F.lit(1))).alias("size"))  # one row per language
    scored = counts.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("of")))
    return scored.select("gram", "lang", F.log((F.col("n") + 1) / F.col("size")).alias("score"))


def detect(df: DataFrame, profiles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Add ``language``, ``score`` (mean log probability per trigram) and ``gibberish``; a text without words has neither.

    Trigrams meet profiles of a checked size in the task that cut them, and leave it as one row of sums per ``key`` (which is
    unique). Scores go back to the rows by a join on ``key``. Profiles beyond that size meet the trigrams in a join that
    spreads frequent ones.
    """
    known = small_table(profiles)
    scored = _joined_scores(df, profiles, key, text) if known is None else _broadcast_scores(df, known, key, text)
    letters = F.length(F.regexp_replace(F.col(text), r"[^\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    gibberish = (
        F.when(F.coalesce(letters, F.lit(0.0)) < NOISE_LETTERS, "noise")
        .when(F.coalesce(F.col("score"), F.lit(FLOOR)) < SALAD_SCORE, "word salad").otherwise("clean")
    )
    return df.join(scored, key, "left").withColumn("gibberish", gibberish)


def _broadcast_scores(df: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, score) with profiles of a checked size; a sum per language, all in one pass."""
    names = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").collect() if r[0] is not None]
    if not names:
        return df.select(key).limit(0).withColumn("language", F.lit("")).withColumn("score", F.lit(0.0))
    one = profiles.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == n, F.col("score"))).alias(f"s{i}") for i, n in enumerate(names)])
    cut = _explode_trigrams(df.select(key, F.explode(_words(text)).alias("word"))).select(key, "gram")
    cut = null_safe_join(cut, F.broadcast(one), ["gram"], "left")
    sums = cut.groupBy(key).agg(*[F.avg(F.coalesce(F.col(f"s{i}"), F.lit(FLOOR))).alias(f"s{i}") for i in range(len(names))])
    each = [F.struct(F.col(f"s{i}").alias("score"), F.lit(n).alias("lang")) for i, n in enumerate(names)]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return sums.select(key, best.alias("b")).select(key, F.col("b.lang").alias("language"), F.col("b.score").alias("score"))


def _joined_scores(df: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, score) by a join of exploded trigrams with profiles of any size."""
    cut = _explode_trigrams(df.select(key, F.explode(_words(text)).alias("word"))).select(key, "gram")
    sizes = cut.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hits = spread_join(cut.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("k")), profiles.select("gram", "lang", "score"), ["gram"], "inner")
    sums = hits.groupBy(key, "lang").agg(F.sum((F.col("score") - FLOOR) * F.col("k")).alias("s"))
    one = sizes.join(sums, key, "left").withColumn("mean", F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n") + FLOOR)
    last = profiles.agg(F.max("lang").alias("last"))  # one row: what texts without a known trigram are called
    best = one.groupBy(key).agg(F.max(F.struct("mean", "lang")).alias("b")).crossJoin(F.broadcast(last))
    return best.select(key, F.coalesce("b.lang", "last").alias("language"), F.col("b.mean").alias("score"))
