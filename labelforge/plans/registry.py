"""The list of named queries and the SQL fragments their checks share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelforge.functions import text as tx

MODULES = ("cleaning", "nesting", "copies", "splitting", "statistics", "voting", "models", "scoring", "evidence", "answers", "errors", "reports", "recipes")

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use the named views."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            from labelforge.plans.views import with_views

            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def load_all() -> None:
    """Import every query module once."""
    for module in MODULES:
        importlib.import_module(f"labelforge.plans.{module}_queries")


def bind(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A query as a function of session and folder."""
    from labelforge.plans.views import Tables

    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


# --- SQL fragments -------------------------------------------------------------------------------------------------


def sql_text(value: str) -> str:
    """A quoted SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_hash(*keys: str, seed: int | str = 42) -> str:
    """The seeded hash of key expressions."""
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def sql_hash_int(*keys: str, seed: int | str = 42) -> str:
    """Its first 32 bits."""
    return f"(('0x' || substr({sql_hash(*keys, seed=seed)}, 1, 8))::BIGINT)"


def sql_strip(x: str) -> str:
    """Without whitespace at both ends."""
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_fold(x: str) -> str:
    """ASCII folding."""
    out = f"translate({x}, {sql_text(tx.FOLD_FROM)}, {sql_text(tx.FOLD_TO)})"
    for letter, spelled in tx.WIDE_FOLDS.items():
        out = f"replace({out}, {sql_text(letter)}, {sql_text(spelled)})"
    return rf"regexp_replace({out}, '[^\x00-\x7F]', '', 'g')"


def sql_clean(x: str) -> str:
    """The cleaning step (the tables hold no broken encodings, which unit tests cover)."""
    out = sql_fold(x)
    for pattern, token in ((tx.URL_PATTERN, tx.URL_TOKEN), (tx.EMAIL_PATTERN, tx.EMAIL_TOKEN), (tx.PHONE_PATTERN, tx.PHONE_TOKEN)):
        out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(token)}, 'g')"
    out = rf"regexp_replace({out}, '[ \t\r\f]+', ' ', 'g')"
    out = rf"regexp_replace({out}, ' ?\n[ \n]*', chr(10), 'g')"
    return sql_strip(out)


def sql_tokens(x: str) -> str:
    """Number of tokens."""
    return f"coalesce(len(regexp_extract_all({x}, {sql_text(tx.TOKEN_PATTERN)})), 0)::INTEGER"


def sql_normal(x: str) -> str:
    """Hard normalisation."""
    import string

    return sql_strip(rf"regexp_replace(lower(translate({x}, {sql_text(string.punctuation)}, '')), '\s+', ' ', 'g')")


def sql_rank(group: str, key: str, lead: str = "", seed: int | str = 42) -> str:
    """Rank in a group in hash order."""
    order = f"{lead}, " if lead else ""
    return f"row_number() over (partition by {group} order by {order}{sql_hash(key, seed=seed)}, {key})"
