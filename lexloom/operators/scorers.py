"""Model stages as pluggable scorers: a scorer turns batches of rows into batches of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score(df: DataFrame, make: Callable[[], Scorer], inputs: list[str], outputs: str, keys: list[str]) -> DataFrame:
    """(keys, outputs): `make` is called once per task and returns the scorer, which sees the columns `inputs`.

    `outputs` is a schema such as "entail double, contra double". Only keys and inputs travel to Python.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", " + outputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for b in batches:
            yield pd.concat([b[keys].reset_index(drop=True), scorer(b[inputs]).reset_index(drop=True)], axis=1)

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, schema)


def stored(df: DataFrame, column: str, fallback: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The stored column where it has a value, else that of a scorer's result by the same keys."""
    f = fallback.select(*keys, F.col(name).alias("_scored")).dropDuplicates(keys)
    return df.join(f, keys, "left").withColumn(name, F.coalesce(F.col(column), F.col("_scored"))).drop("_scored")
