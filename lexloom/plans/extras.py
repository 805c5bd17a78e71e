"""Queries: the smaller operators: lookups, formats, set operations and single-system correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import rewards as RW
from lexloom.functions import text as T
from lexloom.operators import ranks as R
from lexloom.operators import retrieval
from lexloom.plans import kit as K
from lexloom.plans import relations as REL
from lexloom.plans.reports import _long, _rows
from lexloom.plans.statistics import _LENS, _LONG, _rho, rnd

INSTRUCTIONS = {"beginner": "Use short sentences and everyday words.", "intermediate": "Use plain words and keep the main legal terms.", "advanced": "Keep the legal terms and the structure."}


def level_instructions(spark: SparkSession, d: str) -> DataFrame:
    lookup = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
    return K.scored(spark, d).select("tag", "id", "lv", F.try_element_at(lookup, F.col("lv")).alias("instruction"))


def qualified_ids(spark: SparkSession, d: str) -> DataFrame:
    """Running ids of the passages of each source."""
    s = K.snippets(spark, d).select("id", F.coalesce("source", F.lit("none")).alias("source")).distinct()
    n = F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1
    return s.select("id", F.format_string("%s_%05d", F.substring("source", 1, 3), n).alias("qualified"))


def tail_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Documents without what follows a citation mark; short rests are empty."""
    t = T.strip(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), K.WS, " "), r"\b(?:Rule|Section)\b.*$", ""))
    return K.table(spark, d, "documents").select("doc_id", F.when(F.length(t) < 80, "").otherwise(t).alias("body"))


def field_clip(spark: SparkSession, d: str) -> DataFrame:
    return K.snippets(spark, d).select("id", F.replace(F.substring("text", 1, 280), F.lit("\n"), F.lit(" ")).alias("clip"), F.substring("title", 1, 100).alias("title"))


def present_tags(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows of the systems that have been judged."""
    return K.scored(spark, d).join(K.table(spark, d, "judged").select(F.col("system").alias("tag")).distinct(), "tag", "left_semi")


def config_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cells that each pair of systems shares."""
    s = K.scored(spark, d)
    a, b = s.select("id", "lv", F.col("tag").alias("a")), s.select("id", "lv", F.col("tag").alias("b"))
    return a.join(b, ["id", "lv"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Ids in the scored rows, the judged rows, both and either."""
    s, j = (K.table(spark, d, t).select("id").where("id is not null").distinct() for t in ("scored", "judged"))
    both = s.withColumn("s", F.lit(1)).join(j.withColumn("j", F.lit(1)), "id", "full")
    return both.agg(F.count("s").alias("n_scored"), F.count("j").alias("n_judged"), F.count(F.when(F.col("s").isNotNull() & F.col("j").isNotNull(), 1)).alias("n_both"), F.count("*").alias("n_either"), F.count(F.when(F.col("j").isNull(), 1)).alias("n_only_scored"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    u = retrieval.unit(F.col("embedding"))
    return K.table(spark, d, "embeddings").select("vec_id", rnd(F.aggregate(F.transform(u, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), "norm2"))


def in_band(spark: SparkSession, d: str) -> DataFrame:
    """Share of valid rows within ten and twelve points of their own level's target."""
    s = _rows(spark, d).where(~F.col("pure") & F.col("fre").isNotNull() & F.col("target").isNotNull())
    return s.groupBy("tag").agg(F.count("*").alias("n"), *[rnd(F.avg((F.abs(F.col("fre") - F.col("target")) <= k).cast("double")), f"within_{k}") for k in (10, 12)])


def one_system_rho(spark: SparkSession, d: str) -> DataFrame:
    """Human difficulty against stored reading ease for one system."""
    return R.spearman(REL.three_lens(spark, d).where("system = 'tuned'"), [], "human", "fre").select("n", rnd("rho"))


def source_row_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of one system's cells by level and dimension, with the composite of four dimensions."""
    s = REL._sheets(spark, d).where("system = 'base'").withColumn("lv", F.regexp_extract("item_id", "^(.*)_([^_]*)$", 2))
    comp = (F.col("difficulty") + F.col("meaning") + F.col("terminology") + F.col("fluency")) / 4
    return s.groupBy("lv").agg(F.count("*").alias("n"), *[rnd(F.avg(x), x) for x in C.DIMS], rnd(F.avg(comp), "composite"))


def stored_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty score from the stored reading ease."""
    return K.scored(spark, d, "fre").select("tag", "id", "lv", rnd(RW.difficulty_score(F.col("fre"), "lv"), "r_diff"))


def any_rater(spark: SparkSession, d: str) -> DataFrame:
    """Cells that any rater has scored, with the raters and scores behind them."""
    return _long(spark, d).groupBy("item_id", "system").agg(F.count_distinct("rater").alias("n_raters"), F.count("*").alias("n_scores"))


def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Confidence read from the replies as text; what is no number is null."""
    j = K.table(spark, d, "judged")
    return j.select("judge_id", F.nullif(F.regexp_extract("raw", r'"confidence": ([^,}]*)', 1), F.lit("")).try_cast("double").alias("confidence"))


QUERIES = {f.__name__: f for f in (level_instructions, qualified_ids, tail_fragments, field_clip, present_tags, config_pairs, key_sets, unit_vectors, in_band, one_system_rho, source_row_means, stored_difficulty, any_rater, safe_numbers)}

_S = f"with {K.Q_SCORED}"
SQL = {
    "level_instructions": f"{_S} select tag, id, lv, case lv " + " ".join(f"when {K.q_str(k)} then {K.q_str(v)}" for k, v in INSTRUCTIONS.items()) + " end as instruction from s",
    "qualified_ids": f"with {K.Q_SNIPPETS}, p as (select distinct id, coalesce(source, 'none') as source from sn) select id, substr(source, 1, 3) || '_' || lpad((row_number() over (partition by source order by id) - 1)::varchar, 5, '0') as qualified from p",
    "tail_fragments": "with t as (select doc_id, " + K.q_strip(f"regexp_replace(regexp_replace(coalesce(text, ''), '{K.WS}', ' ', 'g'), '\\b(?:Rule|Section)\\b.*$', '')") + " as t from documents) select doc_id, case when length(t) < 80 then '' else t end as body from t",
    "field_clip": f"with {K.Q_SNIPPETS} select id, replace(substr(text, 1, 280), chr(10), ' ') as clip, substr(title, 1, 100) as title from sn",
    "present_tags": f"{_S} select tag, id, lv from s where tag in (select system from judged where system is not null)",
    "config_pairs": f"{_S} select a.tag as a, b.tag as b, count(*) as n from s a join s b on a.id = b.id and a.lv = b.lv and a.tag < b.tag group by all",
    "key_sets": "with a as (select distinct id, 1 as s from scored where id is not null), b as (select distinct id, 1 as j from judged where id is not null) select count(s) as n_scored, count(j) as n_judged, count(*) filter (s is not null and j is not null) as n_both, count(*) as n_either, count(*) filter (j is null) as n_only_scored from a full join b using (id)",
    "unit_vectors": "with v as (select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) + 1e-9 as n from embeddings) select vec_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 9) as norm2 from v",
    "in_band": f"with {K.Q_SCORED}, h as (select tag, abs(fre - {K.Q_TARGET}) as gap from s where not {K.Q_PURE}) select tag, count(*) as n, round(avg((gap <= 10)::int::double), 9) as within_10, round(avg((gap <= 12)::int::double), 9) as within_12 from h where gap is not null group by tag",
    "one_system_rho": f"with {_LENS}, x as (select human, fre from tl where system = 'tuned') {_rho('x', '', 'human', 'fre')}",
    "source_row_means": f"with {REL.Q_SHEETS} select regexp_extract(item_id, '^(.*)_([^_]*)$', 2) as lv, count(*) as n, " + ", ".join(f"round(avg({x}), 9) as {x}" for x in C.DIMS) + ", round(avg((difficulty + meaning + terminology + fluency)::double / 4), 9) as composite from u where system = 'base' group by 1",
    "stored_difficulty": f"{_S} select tag, id, lv, round(case when fre is not null and {K.Q_TARGET} is not null then {K.q_clamp(f'1 - abs(fre - {K.Q_TARGET}) / 20')} end, 9) as r_diff from s",
    "any_rater": f"with {_LONG} select item_id, system, count(distinct rater) as n_raters, count(*) as n_scores from lg group by all",
    "safe_numbers": "select judge_id, try_cast(nullif(regexp_extract(raw, '\"confidence\": ([^,}]*)', 1), '') as double) as confidence from judged",
}
