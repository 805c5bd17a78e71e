"""Queries: variants of samples, weights, supports and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.operators import relational as O
from lexloom.operators import tests_stat as S
from lexloom.plans import kit as K
from lexloom.plans import relations as REL
from lexloom.plans.reports import _long
from lexloom.plans.statistics import _KW_OF, _LONG, _totals, rnd

SAMPLE = 50


def kb_n_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 50 passages: those of least hash."""
    return O.n_sample(K.snippets(spark, d).where(F.col("split").isin("train", "val")).select("id").distinct(), "id", SAMPLE, C.SEED)


def level_parity(spark: SparkSession, d: str) -> DataFrame:
    """The two outer levels in turn over the test passages in the order of their ids."""
    ids = O.numbered(K.snippets(spark, d).where("split = 'test' and id is not null").select("id").distinct(), ["id"], "n")
    return ids.select("id", F.when(F.col("n") % 2 == 1, C.LEVELS[0]).otherwise(C.LEVELS[-1]).alias("lv"))


def weight_override(spark: SparkSession, d: str) -> DataFrame:
    """The weights when each part in turn is set to 0.3 and the others are rescaled to the rest."""
    rows = [(k, part, 0.3 if k == part else C.WEIGHTS[part] * 0.7 / (1 - C.WEIGHTS[k])) for k in C.PARTS for part in C.PARTS]
    return spark.createDataFrame(rows, "changed string, part string, weight double").select("changed", "part", rnd("weight"))


def compared_tags(spark: SparkSession, d: str) -> DataFrame:
    """Systems that have both scores and replies, where there are two or more of them; none otherwise."""
    tags = K.scored(spark, d).select("tag").distinct().join(K.table(spark, d, "judged").select(F.col("system").alias("tag")).distinct(), "tag", "left_semi")
    return tags.withColumn("n", F.count("*").over(Window.partitionBy())).where("n >= 2").select("tag", "n")  # one row a system


def full_support(spark: SparkSession, d: str) -> DataFrame:
    """Passages and levels that every system has a score for."""
    t = _totals(spark, d)
    n = t.agg(F.count_distinct("tag").alias("all_tags"))
    return t.groupBy("id", "lv").agg(F.count_distinct("tag").alias("n")).join(F.broadcast(n), F.col("n") == F.col("all_tags")).select("id", "lv")  # `n` is one row


def kruskal_common(spark: SparkSession, d: str) -> DataFrame:
    """Rank test of the systems by level over the passages that all of them have."""
    t = _totals(spark, d).join(full_support(spark, d), ["id", "lv"], "left_semi")
    return S.kruskal_wallis(t, ["lv"], "tag", "tot").select("lv", "n", "k", rnd("h"), rnd("epsilon2"))


def judge_auto_gap(spark: SparkSession, d: str) -> DataFrame:
    """Mean judge composite, stored total and their difference on the scale of 0 to 1, by level."""
    j = REL._judged(spark, d)
    comp = ((F.col("judge.difficulty") + F.col("judge.faithfulness") + F.col("judge.terminology") + F.col("judge.fluency")) / 4 - 1) / 4
    v = j.select("lv", comp.alias("c"), "tot").where("c is not null and tot is not null")
    return v.groupBy("lv").agg(F.count("*").alias("n"), rnd(F.avg("c"), "judge"), rnd(F.avg("tot"), "auto_tot"), rnd(F.avg("c") - F.avg("tot"), "auto_diff"))


def reply_identity(spark: SparkSession, d: str) -> DataFrame:
    """Of the cells with two replies or more the share whose replies are the same byte for byte, by system."""
    g = K.table(spark, d, "judged").where("raw is not null").groupBy("id", F.lower(F.trim("lv")).alias("lv"), "system").agg(F.count("*").alias("k"), F.min("raw").alias("a"), F.max("raw").alias("b")).where("k >= 2")
    return g.groupBy("system").agg(F.count("*").alias("n"), rnd(100 * F.avg((F.col("a") == F.col("b")).cast("double")), "percent"))


def score_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Of the cells with two scores or more the share in which all are equal, by dimension."""
    g = _long(spark, d).groupBy("item_id", "system", "dim").agg(F.count("*").alias("k"), F.min("score").alias("a"), F.max("score").alias("b")).where("k >= 2")
    return g.groupBy("dim").agg(F.count("*").alias("n"), rnd(100 * F.avg((F.col("a") == F.col("b")).cast("double")), "percent"))


QUERIES = {f.__name__: f for f in (kb_n_sample, level_parity, weight_override, compared_tags, full_support, kruskal_common, judge_auto_gap, reply_identity, score_agreement)}

_FULL = f"{K.Q_SCORED}, tt as (select * from s where tot is not null), fs as (select id, lv from tt group by all having count(distinct tag) = (select count(distinct tag) from tt))"
SQL = {
    "kb_n_sample": f"with {REL._KB} select id from (select distinct id from kb) order by md5('{C.SEED}:' || id), id limit {SAMPLE}",
    "level_parity": f"with {K.Q_SNIPPETS} select id, case when row_number() over (order by id) % 2 = 1 then '{C.LEVELS[0]}' else '{C.LEVELS[-1]}' end as lv from (select distinct id from sn where split = 'test' and id is not null)",
    "weight_override": "with w(part, weight) as (values " + ", ".join(f"('{k}', {v}::double)" for k, v in C.WEIGHTS.items()) + ") select b.part as changed, a.part, round(case when a.part = b.part then 0.3::double else a.weight * 0.7::double / (1 - b.weight) end, 9) as weight from w a, w b",
    "compared_tags": f"with {K.Q_SCORED}, t as (select distinct tag from s where tag in (select system from judged where system is not null)) select tag, (select count(*) from t) as n from t where (select count(*) from t) >= 2",
    "full_support": f"with {_FULL} select id, lv from fs",
    "kruskal_common": _KW_OF(f"{_FULL}, x as (select tt.* from tt join fs using (id, lv))", "x"),
    "judge_auto_gap": f"with {REL.Q_JUDGED}, v as (select lv, ((judge.difficulty + judge.faithfulness + judge.terminology + judge.fluency)::double / 4 - 1) / 4 as c, tot from jg) select lv, count(*) as n, round(avg(c), 9) as judge, round(avg(tot), 9) as auto_tot, round(avg(c) - avg(tot), 9) as auto_diff from v where c is not null and tot is not null group by lv",
    "reply_identity": "with g as (select system, min(raw) as a, max(raw) as b from judged where raw is not null group by id, lower(trim(lv)), system having count(*) >= 2) select system, count(*) as n, round(100 * avg((a = b)::int::double), 9) as percent from g group by system",
    "score_agreement": f"with {_LONG}, g as (select dim, min(score) as a, max(score) as b from lg group by item_id, system, dim having count(*) >= 2) select dim, count(*) as n, round(100 * avg((a = b)::int::double), 9) as percent from g group by dim",
}
