"""Seeded hash order: the replacement for seeded pseudo-random choice.

Ordering rows by ``md5(seed|key)`` is a uniform shuffle that does not depend on partitioning, so that a sample
stays the same when a task is retried or the cluster has another size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def hash_hex(*keys: Column | str, seed: int | str = DEFAULT_SEED) -> Column:
    """32 hex digits, uniform for distinct keys."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(*keys: Column | str, seed: int | str = DEFAULT_SEED) -> Column:
    """The first 32 bits of :func:`hash_hex` as a bigint."""
    return F.conv(F.substring(hash_hex(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def digest(text: Column | str) -> Column:
    """A 256-bit stand-in for a long text, so that a shuffle moves 64 characters and not the text."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)
