"""Shared inputs of the queries, and the SQL snippets of their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that hold texts or structures; rows that carry them are not sorted or shuffled to drop redeliveries.
WIDE = frozenset(["src", "rew", "parts", "nli"])
#: Up to so many row ids of overtaken deliveries (8 MB) are broadcast.
OVERTAKEN = 1_000_000


def _parts(df: DataFrame) -> int:
    """Number of parts that the scan of a table has."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def scored(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The last delivery of each (tag, id, lv) with a plain lower-case `lv`, of only the columns asked for.

    The overtaken deliveries are found on the narrow columns. They are few, so wide rows drop them by a broadcast of
    their row ids, whose number is checked. Beyond the bound, for narrow rows, and where the scan has too few parts to
    occupy the cores (so that the heavy expressions that follow need a shuffle), the window carries the columns.
    """
    rows = table(spark, sf_dir, "scored").withColumn("lv", F.lower(F.trim("lv")))
    key = ["tag", "id", "lv"]
    keep = [c for c in cols if c not in key]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("received_at"), F.desc("row_id")))
    if WIDE & set(cols) and _parts(rows) >= spark.sparkContext.defaultParallelism:
        overtaken = rows.select(*key, "row_id", "received_at").withColumn("k", place).where("k > 1").select("row_id")
        if overtaken.count() <= OVERTAKEN:
            return rows.join(F.broadcast(overtaken), "row_id", "left_anti").select(*key, *keep)
    rows = rows.select(*key, "row_id", "received_at", *[c for c in keep if c not in ("row_id", "received_at")])
    return rows.withColumn("k", place).where("k = 1").select(*key, *keep)


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct passages; a passage delivered twice counts once."""
    return table(spark, sf_dir, "snippets").distinct()


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, definition): lower-case terms without blanks, each with its least definition that is not blank, or ''."""
    t = table(spark, sf_dir, "terms").select(F.lower(F.trim("term")).alias("term"), F.nullif(F.trim("definition"), F.lit("")).alias("d")).where("term is not null and term <> ''")
    return t.groupBy("term").agg(F.coalesce(F.min("d"), F.lit("")).alias("definition"))


def term_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the sorted terms and their definitions by term. The term table is of fixed size."""
    return terms(spark, sf_dir).agg(F.array_sort(F.collect_list("term")).alias("terms"), F.map_from_entries(F.collect_list(F.struct("term", "definition"))).alias("definitions"))


def with_terms(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.crossJoin(F.broadcast(term_arrays(spark, sf_dir)))  # one row


def pure() -> Column:
    """A row that holds remarks only: its flag if it has one, else an empty rewrite."""
    return F.coalesce(F.col("pure_commentary"), F.coalesce(F.col("rew"), F.lit("")) == "")


# ---- SQL snippets ----

WS = r"[ \t\n\x0B\f\r]+"
Q_SCORED = "s as (select * exclude (k, lv0), lv0 as lv from (select * exclude (lv), lower(trim(lv)) as lv0, row_number() over (partition by tag, id, lower(trim(lv)) order by received_at desc nulls last, row_id desc) as k from scored) where k = 1)"
Q_SNIPPETS = "sn as (select distinct * from snippets)"
Q_TERMS = "tm as (select lower(trim(term)) as term, coalesce(min(nullif(trim(definition), '')), '') as definition from terms where term is not null and trim(term) <> '' group by 1), ta as (select list(term order by term) as terms from tm)"
Q_PURE = "coalesce(pure_commentary, coalesce(rew, '') = '')"
Q_TARGET = "case lv " + " ".join(f"when '{k}' then {v}::double" for k, v in C.TARGETS.items()) + " end"


def q_words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{WS}'), lambda w: w <> '')"


def q_tokens(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '[A-Za-z'']+')"


def q_lower_tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z'']+')"


def q_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"


def q_sentences(c: str) -> str:
    marked = f"regexp_replace(coalesce({c}, ''), '([.!?]){WS}', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {q_strip('x')}), lambda x: x <> '')"


def q_sentence_count(c: str) -> str:
    return f"greatest(len(regexp_extract_all(coalesce({c}, ''), '[.!?]+')), len(list_filter(string_split(coalesce({c}, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))), 1)"


def q_syllables(w: str) -> str:
    return f"(case when length({w}) <= 3 then 1 else greatest(1, len(regexp_extract_all({w}, '[aeiouy]+')) - (case when {w} like '%e' then 1 else 0 end)) end)"


def q_syllable_count(arr: str) -> str:
    return f"coalesce(list_sum(list_transform({arr}, lambda w: {q_syllables('w')})), 0)::double"


def q_flesch(c: str) -> str:
    n = f"nullif(len({q_tokens(c)}), 0)::double"
    return f"coalesce(206.835::double - 1.015::double * {n} / {q_sentence_count(c)} - 84.6::double * {q_syllable_count(q_lower_tokens(c))} / {n}, 0::double)"


def q_ngrams(arr: str, n: int) -> str:
    return f"(case when len({arr}) >= {n} then list_transform(range(1, len({arr}) - {n} + 2), lambda i: array_to_string(({arr})[i:i + {n - 1}], ' ')) else []::varchar[] end)"


def q_clamp(x: str) -> str:
    return f"greatest(0::double, least(1::double, {x}))"


def q_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def q_list(xs: list[str]) -> str:
    return "[" + ", ".join(q_str(x) for x in xs) + "]"


def q_set_f1(a: str, b: str) -> str:
    """F1 of two lists of distinct values."""
    return f"coalesce(2::double * len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}), 0), 1::double)"
