"""Readers of record files: JSON documents, JSON lines, rater sheets, keys, vectors; with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import schemas as S

BOM = "﻿"


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object per line; blank lines count nothing, missing keys are null, a broken line is a row of nulls."""
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(snippets, terms) of corpus documents."""
    d = json_document(spark, path, S.CORPUS)
    return d.select(F.explode("snippets").alias("s")).select("s.*"), d.select(F.explode("terms").alias("t")).select("t.*")


def terms(df: DataFrame, column: str) -> DataFrame:
    """(term, definition) of a JSON column that holds a list of objects, a list of strings or an object of definitions."""
    c = F.col(column)
    objects = F.from_json(c, "array<struct<term:string,definition:string>>")
    names = F.from_json(c, "array<string>")
    pairs = F.map_entries(F.from_json(c, "map<string,string>"))
    kind = F.when(c.rlike(r"^\s*\[\s*\{"), 1).when(c.rlike(r"^\s*\["), 2).when(c.rlike(r"^\s*\{"), 3)
    rows = F.when(kind == 1, objects).when(kind == 2, F.transform(names, lambda t: F.struct(t.alias("term"), F.lit("").alias("definition")))).when(kind == 3, F.transform(pairs, lambda e: F.struct(e["key"].alias("term"), e["value"].alias("definition"))))
    return df.select(F.explode(rows).alias("t")).select(F.col("t.term").alias("term"), F.coalesce("t.definition", F.lit("")).alias("definition")).where("term is not null")


def split_document(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text, split) of documents that map each split to its passages."""
    item = "array<struct<id:string,title:string,text:string>>"
    d = json_document(spark, path, f"train {item}, val {item}, test {item}")
    one = lambda s: d.select(F.explode(s).alias("x")).select("x.*").withColumn("split", F.lit(s))
    return one("train").unionByName(one("val")).unionByName(one("test"))


def tagged(spark: SparkSession, paths: str | list[str], schema: str, pattern: str, exclude: str = "pilot|selftest") -> DataFrame:
    """JSON lines with the `tag` that `pattern` finds in each file's name; files whose name matches `exclude` are left out."""
    df = spark.read.schema(schema).json(paths).withColumn("_file", F.col("_metadata.file_name"))
    df = df.where(~F.col("_file").rlike(exclude)) if exclude else df
    return df.withColumn("tag", F.regexp_extract("_file", pattern, 1)).drop("_file")


def preferred_variant(df: DataFrame, tag: str = "tag", suffix: str = "_honest") -> DataFrame:
    """Of each tag the rows of its re-scored file if there is one, else those of its raw file; tags lose the suffix."""
    base = F.regexp_replace(tag, f"{suffix}$", "")
    rows = df.withColumns({"_base": base, "_raw": (~F.col(tag).endswith(suffix)).cast("int")})
    best = rows.groupBy("_base").agg(F.min("_raw").alias("_raw"))
    return rows.join(best, ["_base", "_raw"]).withColumn(tag, F.col("_base")).drop("_base", "_raw")


def backfilled(honest: DataFrame, raw: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Honest rows whose empty or null `columns` are taken from the raw row of the same keys."""
    r = raw.select(*keys, *[F.col(c).alias(f"_raw_{c}") for c in columns]).dropDuplicates(keys)
    j = honest.join(r, keys, "left")
    for c in columns:
        own = F.nullif(F.col(c), F.lit("")) if dict(honest.dtypes)[c] == "string" else F.col(c)
        j = j.withColumn(c, F.coalesce(own, F.col(f"_raw_{c}")))
    return j.drop(*[f"_raw_{c}" for c in columns])


def rater_sheets(spark: SparkSession, paths: str | list[str], pattern: str = r"rated_(R\d+)") -> DataFrame:
    """Rater sheets (CSV with or without a byte-order mark, quoted line ends); scores that are no numbers are null.

    The rater comes from the file's name.
    """
    df = spark.read.schema(S.SHEET).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(paths)
    df = df.withColumn("rater", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))
    score = {c: F.col(c).try_cast("double").cast("int") for c in df.columns if c.endswith("_1_5")}
    return df.withColumns({"item_id": F.regexp_replace("item_id", f"^{BOM}", ""), **score})


def blinding_key(spark: SparkSession, path: str) -> DataFrame:
    """(rater, item_id, label, system) of a three-level JSON key, one row a leaf."""
    text = spark.read.text(path, wholetext=True)
    k = text.select(F.explode(F.from_json("value", S.KEY)).alias("rater", "items")).select("rater", F.explode("items").alias("item_id", "labels"))
    return k.select("rater", "item_id", F.explode("labels").alias("label", "system"))


def first_of_name(df: DataFrame, directories: list[str], path: str = "path") -> DataFrame:
    """Of the files of one name those in the first of the directories that has it. `path` holds each row's file.

    The names are settled on the list of files (a partial count in each task); the rows are only filtered.
    """
    name = F.regexp_extract(path, "([^/]+)$", 1)
    rank = F.lit(len(directories))
    for i, d in reversed(list(enumerate(directories))):
        rank = F.when(F.col(path).contains(d.rstrip("/") + "/"), i).otherwise(rank)
    rows = df.withColumns({"_name": name, "_rank": rank})
    best = rows.groupBy("_name").agg(F.min("_rank").alias("_rank"))  # one row a file name
    return rows.join(best, ["_name", "_rank"], "left_semi").drop("_name", "_rank")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of saved answers of a case service: `results` with a name and a text of one line."""
    d = json_document(spark, path, "results array<struct<name:string,text:string>>")
    return d.select(F.explode("results").alias("c")).select("c.name", F.trim(F.regexp_replace("c.text", r"\s+", " ")).alias("text"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files under a model or data folder, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of vectors kept as parquet."""
    return spark.read.schema(S.EMBEDDING).parquet(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, type) of a graph kept as JSON lines."""
    return json_lines(spark, path, S.EDGE)
