"""Rater sheets: last deliveries, unblinding, and scores beside those of the other raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config as C


def sheets(rated: DataFrame) -> DataFrame:
    """The last delivery of each (rater, item, label); scores outside 1-5 are null, `valid` is Y, N or null."""
    score = [F.when(F.col(f"{d}_1_5").between(1, 5), F.col(f"{d}_1_5")).alias(d) for d in C.DIMS]
    valid = F.upper(F.substring(F.trim("valid_rewrite"), 1, 1)).alias("valid")
    rows = rated.where("rater is not null and item_id is not null and label is not null").select("rater", "item_id", F.upper(F.trim("label")).alias("label"), "rated_at", *score, valid)
    w = Window.partitionBy("rater", "item_id", "label").orderBy(F.desc_nulls_last("rated_at"), *[F.desc_nulls_last(d) for d in C.DIMS], F.desc_nulls_last("valid"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "rated_at")


def unblinded(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """Sheets with the system behind each label.

    A rater who has no key for an item at all takes that of the item's first rater who has one; a label that
    stays unknown is left out. The key grows with the sheets and its file packs to a fraction of its size in memory,
    so its joins are merged: by the file's size they would be broadcast through the driver.
    """
    k = key.select("rater", "item_id", F.upper(F.trim("label")).alias("label"), "system").where("system is not null").groupBy("rater", "item_id", "label").agg(F.min("system").alias("own"))
    has = k.select("rater", "item_id").distinct().withColumn("has", F.lit(True))
    first = k.groupBy("item_id", "label").agg(F.min_by("own", "rater").alias("other"), F.min("rater").alias("r"))
    least = k.groupBy("item_id").agg(F.min("rater").alias("r"))
    other = first.join(least.hint("merge"), ["item_id", "r"]).drop("r")
    j = sheet.join(k.hint("merge"), ["rater", "item_id", "label"], "left").join(has.hint("merge"), ["rater", "item_id"], "left").join(other.hint("merge"), ["item_id", "label"], "left")
    system = F.coalesce("own", F.when(F.col("has").isNull(), F.col("other")))
    return j.withColumn("system", system).where("system is not null").drop("own", "has", "other")


def long_scores(df: DataFrame) -> DataFrame:
    """(item_id, system, rater, dim, score) of the scores that are not null."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("score")) for d in C.DIMS])).alias("x")
    return df.select("item_id", "system", "rater", each).select("item_id", "system", "rater", "x.dim", "x.score").where("score is not null")


def beside(scores: DataFrame, least: int = 3) -> DataFrame:
    """(item_id, system, dim, rater, score, n, others): each score of the cells with `least` scores or more, beside their
    number and the mean of the cell's other scores. All raters of a cell count."""
    cell = ["item_id", "system", "dim"]
    sums = scores.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("score").alias("_s")).where(F.col("n") >= least)
    return scores.join(sums.hint("merge"), cell).select(*cell, "rater", "score", "n", F.round((F.col("_s") - F.col("score")) / (F.col("n") - 1), 9).alias("others"))
