"""Average ranks, rank correlations and step-up corrections that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.relational import PLAIN_ROWS, cut


def average_rank(df: DataFrame, by: list[str], value: str, name: str, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Adds the rank of `value` within the groups of `by`, ties sharing the mean of their places; null values get null.

    Values are counted first, so that repeated ones are ranked once. Few counted rows take a window by group; many
    are parted by range, and sums of the parts before shift the ranks, so that a group may hold any share of the rows;
    they are joined by merging, as an estimate from file sizes could have them broadcast.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    few = counts.count() <= plain_rows
    if few:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumn("__below", F.sum("__n").over(w) - F.col("__n"))
    else:
        parts = cut(counts.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
        w = Window.partitionBy("__part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = parts.groupBy("__part", *by).agg(F.sum("__n").alias("__s"))
        shift = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("__part", *by, shift.alias("__shift"))  # about one row a part and group
        inside = parts.withColumn("__below", F.sum("__n").over(w) - F.col("__n"))
        same = inside["__part"] == sums["__part"]
        for b in by:
            same = same & inside[b].eqNullSafe(sums[b])
        ranked = inside.join(sums, same).select(*[inside[b] for b in by], inside[value], inside["__n"], (F.col("__below") + F.col("__shift")).alias("__below"))
    ranked = ranked.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], F.col(value).alias("__v"), (F.col("__below") + (F.col("__n") + 1) / 2).alias(name))
    on = F.col(value) == F.col("__v")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranked if few else ranked.hint("merge"), on, "left").drop("__v", *[f"__k{i}" for i in range(len(by))])


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """(by, n, rho) over the pairs without nulls; rho is null below `least` pairs or where a side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    r = average_rank(average_rank(pairs, by, "_x", "_rx"), by, "_y", "_ry")
    out = r.groupBy(*by).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))
    return out.select(*by, "n", F.when(F.col("n") >= least, F.col("rho")).alias("rho"))


def bh(df: DataFrame, by: list[str], p: str, name: str = "q") -> DataFrame:
    """Adds Benjamini-Hochberg adjusted values within the groups of `by` (families of tests, hence small); p is floored at 1e-300."""
    floored = F.greatest(F.lit(1e-300), F.col(p))
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p)))
    df = df.withColumn("_r", rank).withColumn("_q", floored * n / F.col("_r"))
    step = F.min("_q").over(Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, step).drop("_q", "_r")
