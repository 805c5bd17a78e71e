"""Writers: JSON lines, JSON documents, sheets, Markdown tables; and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report that is written as one file; more raise an error, for such tables belong into `json_lines`.
REPORT_ROWS = 1_000_000


def _small(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report of more than {most} rows")
    return df


def json_lines(df: DataFrame, path: str, partition: str | None = "tag", mode: str = "overwrite") -> None:
    """One object per line, in one folder per value of `partition`, so that reports read only the tags they need."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    (w.partitionBy(partition) if partition else w).json(path)


def json_document(df: DataFrame, path: str, name: str = "rows") -> None:
    """A small result as one JSON document; the rows become one array, so use it for reports only."""
    _small(df, REPORT_ROWS).agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(name))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def sheet(df: DataFrame, path: str) -> None:
    """A rater sheet as one CSV file with a header that starts with a byte-order mark."""
    first, *rest = df.columns
    _small(df, REPORT_ROWS).select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A report as a Markdown table; null shows as a dash. More than `most` rows raise an error."""
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = _small(df, most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def missing(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the sink does not hold yet; a null key equals a null key."""
    d = done.select(*[F.col(k).alias(f"_d_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_d_{k}"))
    return df.join(d, on, "left_anti")


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends to a parquet sink only what it lacks, so that a run that is repeated adds nothing."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        df = missing(df, spark.read.parquet(path), keys)
    df.write.mode("append").parquet(path)
