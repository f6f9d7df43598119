"""Applying a caller's model to text columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_with(df: DataFrame, load: Callable[[], Scorer], inputs: Sequence[str], output: str) -> DataFrame:
    """Add the columns of the DDL string ``output``.

    ``load`` builds the scorer, once per task; the scorer maps a batch of the input columns to a frame of the
    output columns. Only the inputs go to Python; the other columns stay in the row. Works on batch and streaming tables.
    """
    wanted, names = list(inputs), T.StructType.fromDDL(output).names

    @F.pandas_udf(output)
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            yield scorer(batch.set_axis(wanted, axis=1)).reset_index(drop=True)[names]

    kept = [F.col(f"`{c}`") for c in df.columns]
    one = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(wanted)])
    made = df.select(*kept, scored(one).alias("__scored"))
    return made.select(*kept, *[F.col("__scored").getField(n).alias(n) for n in names])


class Models:
    """Scorer loaders by family and mode. Modes: classification, pairs, multilabel."""

    MODES = ("classification", "pairs", "multilabel")

    def __init__(self) -> None:
        self._loaders: dict[tuple[str, str], Callable[[str], Callable[[], Scorer]]] = {}

    def register(self, family: str, mode: str, loader: Callable[[str], Callable[[], Scorer]]) -> None:
        """``loader(task)`` returns what :func:`score_with` calls in every task."""
        if mode not in self.MODES:
            raise ValueError(f"unknown mode {mode!r}: {self.MODES}")
        self._loaders[(family, mode)] = loader

    def select(self, family: str, mode: str = "classification") -> Callable[[str], Callable[[], Scorer]]:
        """The loader of a family, or an error that names the families there are."""
        if mode not in self.MODES:
            raise ValueError(f"unknown mode {mode!r}: {self.MODES}")
        if (family, mode) not in self._loaders:
            raise ValueError(f"unknown family {family!r}: {sorted({f for f, m in self._loaders if m == mode})}")
        return self._loaders[(family, mode)]

    def predict(self, df: DataFrame, family: str, task: str, text: str = "text", query: str | None = None, mode: str = "classification") -> DataFrame:
        """Score ``df`` for one task: adds ``y_pred`` (a list of labels in multilabel mode)."""
        output = "y_pred array<string>" if mode == "multilabel" else "y_pred string"
        inputs = [text] if query is None else [text, query]
        return score_with(df, self.select(family, mode)(task), inputs, output)
