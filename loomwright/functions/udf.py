"""Where users plug in their own code: answer methods, rewriting steps, configurations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_text(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.StringType())])


def answer_with(tasks: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], by: str | None = None, name: str = "answer") -> DataFrame:
    """Tasks with the answers of fn. A parallel-safe fn gets Arrow batches of any rows; one that keeps state (by given) gets
    each group's rows together in one call."""
    schema = with_text(tasks, name)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{name: fn(pdf)})

    if by is None:
        return tasks.mapInPandas(batches, schema)
    return tasks.groupBy(by).applyInPandas(lambda pdf: pdf.assign(**{name: fn(pdf)}), schema)


def rewrite_with(rows: DataFrame, fn: Callable[[str], str], source: str, fallback: Column, name: str = "rewritten") -> DataFrame:
    """Rows with the text that fn makes of the source; where fn raises or gives nothing, the fallback."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(x):
            try:
                return fn(x) or None
            except Exception:  # noqa: BLE001  a user's step may fail on a row; the row then keeps its fallback
                return None

        for pdf in it:
            yield pdf.assign(**{name: pdf[source].map(safe)})

    return rows.mapInPandas(batches, with_text(rows, name)).withColumn(name, F.coalesce(name, fallback))


def method_config(defaults: Column, given: Column) -> Column:
    """Struct config, unknown: the defaults overlaid by what is given, and the given keys that no default has."""
    unknown = F.array_sort(F.array_except(F.map_keys(given), F.map_keys(defaults)))
    kept = F.map_zip_with(defaults, F.map_filter(given, lambda k, v: F.array_contains(F.map_keys(defaults), k)), lambda k, d, g: F.coalesce(g, d))
    return F.struct(kept.alias("config"), unknown.alias("unknown"))
