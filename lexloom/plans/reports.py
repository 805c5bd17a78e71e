"""Queries: grouped reports over scored, judged and rated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import rewards as RW
from lexloom.functions import text as T
from lexloom.operators import ratings as RT
from lexloom.plans import kit as K
from lexloom.plans import relations as REL

_COLS = ("rew", "tot", "fre", "parts", "nli", "attempts", "stripped", "pure_commentary", "sec")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    s = K.scored(spark, d, *_COLS).withColumn("pure", K.pure())
    return s.withColumns({"contra": RW.contradiction("nli"), "target": T.level_target("lv")}).drop("rew", "nli")


def _honest() -> list:
    ok = ~F.col("pure")
    near = lambda k: F.avg(F.when(ok & F.col("fre").isNotNull(), (F.abs(F.col("fre") - F.col("target")) <= k).cast("double")))
    r = lambda c, name: F.round(c, 9).alias(name)
    return [
        F.count("*").alias("n"), F.sum(F.col("pure").cast("long")).alias("n_pure"), r(F.avg(F.col("pure").cast("double")), "pure_rate"), F.count(F.when(F.col("stripped"), 1)).alias("n_stripped"), F.sum(ok.cast("long")).alias("n_valid"),
        r(F.avg(F.when(ok, F.col("fre"))), "fre_mean"), r(F.stddev_pop(F.when(ok, F.col("fre"))), "fre_std"), r(F.median(F.when(ok, F.col("fre"))), "fre_median"), r(near(10), "in_band_10"), r(near(12), "in_band_12"),
        r(F.avg(F.when(F.col("pure"), 0.0).otherwise(F.col("tot"))), "tot"), r(F.avg(F.when(ok, F.col("tot"))), "tot_valid"),
        *[r(F.avg(F.when(ok, F.coalesce(F.col(f"parts.{p}"), F.lit(0.0)))), p) for p in ("diff", "term", "copy", "faith")],
        r(F.avg(F.when(ok, F.col("contra"))), "contradiction"), r(F.avg("attempts"), "attempts"),
    ]


Q_ROWS = f"{K.Q_SCORED}, h as (select *, {K.Q_PURE} as pure, {K.Q_TARGET} as target, try_cast(case when json_valid(nli) then coalesce(json_extract_string(nli, '$.contra'), json_extract_string(nli, '$[2]')) end as double) as contra from s)"
_Q_HONEST = """count(*) as n, count(*) filter (pure) as n_pure, round(avg(pure::int::double), 9) as pure_rate, count(*) filter (stripped) as n_stripped, count(*) filter (not pure) as n_valid,
round(avg(fre) filter (not pure), 9) as fre_mean, round(stddev_pop(fre) filter (not pure), 9) as fre_std, round(median(fre) filter (not pure), 9) as fre_median,
round(avg((abs(fre - target) <= 10)::int::double) filter (not pure), 9) as in_band_10, round(avg((abs(fre - target) <= 12)::int::double) filter (not pure), 9) as in_band_12,
round(avg(case when pure then 0 else tot end), 9) as tot, round(avg(tot) filter (not pure), 9) as tot_valid, """ + ", ".join(f"round(avg(coalesce(parts.{p}, 0)) filter (not pure), 9) as {p}" for p in ("diff", "term", "copy", "faith")) + ", round(avg(contra) filter (not pure), 9) as contradiction, round(avg(attempts), 9) as attempts"


def honest_table(spark: SparkSession, d: str) -> DataFrame:
    """Failure-aware report by system and level."""
    return _rows(spark, d).groupBy("tag", "lv").agg(*_honest())


def honest_table_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The same with a subtotal of each system over its levels ('all')."""
    r = _rows(spark, d).groupingSets([["tag", "lv"], ["tag"]], "tag", "lv").agg(F.grouping("lv").alias("g"), *_honest())
    return r.withColumn("lv", F.when(F.col("g") == 1, "all").otherwise(F.col("lv"))).drop("g")


def recompute_summary(spark: SparkSession, d: str) -> DataFrame:
    """Re-score summary: only positive reading ease counts."""
    s = _rows(spark, d)
    pos = F.when(~F.col("pure") & (F.col("fre") > 0), F.col("fre"))
    return s.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.col("pure").cast("long")).alias("n_pure"), F.count(pos).alias("n_positive"), F.round(F.avg(pos), 9).alias("fre_mean"), F.round(F.sum(F.when(F.abs(pos - F.col("target")) <= 12, 1.0).otherwise(0.0)) / F.greatest(F.lit(1), F.count("*")), 9).alias("in_band"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    """Level summary with the faithfulness proxy where no contradiction is stored."""
    s = _rows(spark, d)
    hall = F.when(~F.col("pure"), F.coalesce("contra", F.when(F.coalesce(F.col("parts.faith"), F.lit(0.0)) < 0.5, 1.0).otherwise(0.0)))
    return s.groupBy("tag", "lv").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("pure"), F.col("fre"))), 9).alias("fre_mean"), F.round(F.avg(hall), 9).alias("contradiction"), F.round(F.avg(F.coalesce("attempts", F.lit(1)).cast("double")), 9).alias("attempts"))


def metrics_by_level(spark: SparkSession, d: str) -> DataFrame:
    s = K.scored(spark, d, "rew", "nli", "sec", "pure_commentary").where(~K.pure())
    s = s.select("tag", "lv", T.flesch("rew").alias("ease"), T.word_count("rew").cast("double").alias("w"), T.sentence_count("rew").cast("double").alias("s"), RW.contradiction("nli").alias("contra"), "sec")
    return s.groupBy("tag", "lv").agg(F.count("*").alias("n"), F.round(F.avg("ease"), 9).alias("ease"), F.round(F.avg(F.col("w") / F.col("s")), 9).alias("sentence_words"), F.round(F.avg("contra"), 9).alias("contradiction"), F.round(F.avg("sec"), 9).alias("mean_sec"))


def radar(spark: SparkSession, d: str) -> DataFrame:
    return K.scored(spark, d, "parts").groupBy("tag", "lv").agg(*[F.round(F.avg(f"parts.{p}"), 9).alias(p) for p in C.PARTS])


def seed_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the mean total over three seeds (here: hash thirds of the ids) of each system."""
    seed = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(3))
    m = K.scored(spark, d, "tot").where("tot is not null").groupBy("tag", seed.alias("seed")).agg(F.avg("tot").alias("m"))
    return m.groupBy("tag").agg(F.count("*").alias("n_seeds"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_pop("m"), 9).alias("std"), F.round(F.min("m"), 9).alias("least"), F.round(F.max("m"), 9).alias("most"), F.round(F.max("m") - F.min("m"), 9).alias("range"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return RT.long_scores(REL._sheets(spark, d))


def system_dim_means(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).groupBy("system", "dim").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 9).alias("std"))


def mean_of_item_means(spark: SparkSession, d: str) -> DataFrame:
    m = _long(spark, d).groupBy("item_id", "system", "dim").agg(F.avg("score").alias("m"))
    return m.groupBy("system", "dim").agg(F.count("*").alias("n_items"), F.round(F.avg("m"), 9).alias("mean"))


def passage_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the level means of each passage, system and dimension."""
    m = _long(spark, d).groupBy("item_id", "system", "dim").agg(F.avg("score").alias("m"))
    m = m.withColumn("id", F.regexp_extract("item_id", "^(.*)_([^_]*)$", 1))
    return m.groupBy("id", "system", "dim").agg(F.count("*").alias("n_levels"), F.round(F.avg("m"), 9).alias("mean"))


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Systems whose judge replies were parsed often enough."""
    j = K.table(spark, d, "judged")
    n = j.groupBy("system").agg(F.count("*").alias("n"), F.count("judge").alias("n_parsed"))
    return n.where(F.col("n_parsed") >= C.MIN_GAP_CELLS).select("system", "n", "n_parsed", F.round(F.col("n_parsed") / F.col("n"), 9).alias("coverage"))


def censoring_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows whose difficulty score sits at zero."""
    s = K.scored(spark, d, "fre").where("fre is not null").select("tag", RW.difficulty_score(F.col("fre"), "lv").alias("x")).where("x is not null")
    return s.groupBy("tag").agg(F.count("*").alias("n"), F.sum((F.col("x") <= 0).cast("long")).alias("n_zero"), F.round(100 * F.avg((F.col("x") <= 0).cast("double")), 9).alias("percent"))


def word_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Least, quartiles by index and greatest word count of the passages of each source."""
    s = K.snippets(spark, d).select("id", "source", "text").distinct().select(F.coalesce("source", F.lit("?")).alias("source"), T.word_count("text").alias("w"))
    n = s.groupBy("source", "w").count()
    run = F.sum("count").over(Window.partitionBy("source").orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("count").over(Window.partitionBy("source"))
    r = n.select("source", "w", run.alias("upto"), total.alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / 4), F.col("w")))
    return r.groupBy("source").agg(F.max("n").alias("n"), F.min("w").alias("least"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), F.max("w").alias("most"))


def mainset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Judge means, composite and shares rated good by judge and by rule, by system and level."""
    j = REL._judged(spark, d)
    mean = (F.col("judge.difficulty") + F.col("judge.faithfulness") + F.col("judge.terminology") + F.col("judge.fluency")) / 4
    j = j.withColumn("composite", mean)
    return j.groupBy("system", "lv").agg(F.count("*").alias("n"), *[F.round(F.avg(f"judge.{x}"), 9).alias(x) for x in ("difficulty", "faithfulness", "terminology", "fluency")], F.round(F.avg("composite"), 9).alias("composite"), F.round(F.avg((F.col("composite") >= C.JUDGE_GOOD).cast("double")), 9).alias("judge_good"), F.round(F.avg((F.col("tot") >= C.AUTO_GOOD).cast("double")), 9).alias("auto_good"))


def first_available_metric(spark: SparkSession, d: str) -> DataFrame:
    """For each id and level the total of the first system in order of preference that has one, else 0.8."""
    order = ("tuned", "looped", "base")
    s = K.scored(spark, d, "tot").groupBy("id", "lv").agg(*[F.max(F.when(F.col("tag") == t, F.col("tot"))).alias(t) for t in order])
    return s.select("id", "lv", F.coalesce(*order, F.lit(0.8)).alias("tot"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each system by outcome: good, remark, too hard, too easy or other."""
    s = _rows(spark, d)
    label = F.when(F.col("pure"), "pure_meta").when(F.col("fre") < F.col("target") - 12, "too_hard").when(F.col("fre") > F.col("target") + 12, "too_easy").when(F.col("tot") >= C.AUTO_GOOD, "good").otherwise("other")
    return s.select("tag", label.alias("label")).groupBy("tag").pivot("label", ["good", "pure_meta", "too_hard", "too_easy", "other"]).count().na.fill(0)


def examples(spark: SparkSession, d: str) -> DataFrame:
    """The three rows of greatest total of each system and level."""
    w = Window.partitionBy("tag", "lv").orderBy(F.desc("tot"), "id")
    return K.scored(spark, d, "tot").where("tot is not null").withColumn("k", F.row_number().over(w)).where("k <= 3")


_L = f"with {REL.Q_SHEETS}, {REL.Q_LONG}"
_IM = f"{_L}, im as (select item_id, system, dim, avg(score) as m from lg group by all)"

QUERIES = {f.__name__: f for f in (
    honest_table, honest_table_rollup, recompute_summary, summary, metrics_by_level, radar, seed_dispersion, system_dim_means, mean_of_item_means, passage_collapse, coverage_gate, censoring_share,
    word_quantiles, mainset_summary, first_available_metric, category_counts, examples,
)}

_PROXY = "case when not pure then coalesce(contra, case when coalesce(parts.faith, 0) < 0.5 then 1::double else 0::double end) end"
_COMP = "(judge.difficulty + judge.faithfulness + judge.terminology + judge.fluency)::double / 4"
SQL = {
    "honest_table": f"with {Q_ROWS} select tag, lv, {_Q_HONEST} from h group by tag, lv",
    "honest_table_rollup": f"with {Q_ROWS} select tag, case when grouping(lv) = 1 then 'all' else lv end as lv, {_Q_HONEST} from h group by grouping sets ((tag, lv), (tag))",
    "recompute_summary": f"with {Q_ROWS}, p as (select *, case when not pure and fre > 0 then fre end as pos from h) select tag, count(*) as n, count(*) filter (pure) as n_pure, count(pos) as n_positive, round(avg(pos), 9) as fre_mean, round(count(*) filter (abs(pos - target) <= 12)::double / greatest(1, count(*)), 9) as in_band from p group by tag",
    "summary": f"with {Q_ROWS} select tag, lv, count(*) as n, round(avg(fre) filter (not pure), 9) as fre_mean, round(avg({_PROXY}), 9) as contradiction, round(avg(coalesce(attempts, 1)), 9) as attempts from h group by tag, lv",
    "metrics_by_level": f"with {Q_ROWS}, m as (select tag, lv, {K.q_flesch('rew')} as ease, len({K.q_words('rew')})::double / {K.q_sentence_count('rew')} as ws, contra, sec from h where not pure) select tag, lv, count(*) as n, round(avg(ease), 9) as ease, round(avg(ws), 9) as sentence_words, round(avg(contra), 9) as contradiction, round(avg(sec), 9) as mean_sec from m group by tag, lv",
    "radar": f"with {K.Q_SCORED} select tag, lv, " + ", ".join(f"round(avg(parts.{p}), 9) as {p}" for p in C.PARTS) + " from s group by tag, lv",
    "seed_dispersion": f"with {K.Q_SCORED}, m as (select tag, ('0x' || substr(md5(id), 1, 8))::bigint % 3 as seed, avg(tot) as m from s where tot is not null group by all) select tag, count(*) as n_seeds, round(avg(m), 9) as mean, round(stddev_pop(m), 9) as std, round(min(m), 9) as least, round(max(m), 9) as most, round(max(m) - min(m), 9) as range from m group by tag",
    "system_dim_means": f"{_L} select system, dim, count(*) as n, round(avg(score), 9) as mean, round(coalesce(stddev_samp(score), 0), 9) as std from lg group by all",
    "mean_of_item_means": f"{_IM} select system, dim, count(*) as n_items, round(avg(m), 9) as mean from im group by all",
    "passage_collapse": f"{_IM} select regexp_extract(item_id, '^(.*)_([^_]*)$', 1) as id, system, dim, count(*) as n_levels, round(avg(m), 9) as mean from im group by all",
    "coverage_gate": "select system, count(*) as n, count(judge) as n_parsed, round(count(judge)::double / count(*), 9) as coverage from judged group by system having count(judge) >= 30",
    "censoring_share": f"with {K.Q_SCORED}, x as (select tag, {K.q_clamp(f'1 - abs(fre - {K.Q_TARGET}) / 20')} as x from s where fre is not null and {K.Q_TARGET} is not null) select tag, count(*) as n, count(*) filter (x <= 0) as n_zero, round(100 * avg((x <= 0)::int::double), 9) as percent from x group by tag",
    "word_quantiles": f"with {K.Q_SNIPPETS}, w as (select coalesce(source, '?') as source, len({K.q_words('text')})::int as w from (select distinct id, source, text from sn)), l as (select source, list(w order by w) as l from w group by source) select source, len(l) as n, l[1] as least, l[floor(len(l) / 4)::int + 1] as q1, l[floor(len(l) * 2 / 4)::int + 1] as q2, l[floor(len(l) * 3 / 4)::int + 1] as q3, l[-1] as most from l",
    "mainset_summary": f"with {REL.Q_JUDGED}, c as (select *, {_COMP} as composite from jg) select system, lv, count(*) as n, " + ", ".join(f"round(avg(judge.{x}), 9) as {x}" for x in ("difficulty", "faithfulness", "terminology", "fluency")) + ", round(avg(composite), 9) as composite, round(avg((composite >= 3.5)::int::double), 9) as judge_good, round(avg((tot >= 0.8)::int::double), 9) as auto_good from c group by all",
    "first_available_metric": f"with {K.Q_SCORED} select id, lv, coalesce(max(tot) filter (tag = 'tuned'), max(tot) filter (tag = 'looped'), max(tot) filter (tag = 'base'), 0.8::double) as tot from s group by id, lv",
    "category_counts": f"with {Q_ROWS}, l as (select tag, case when pure then 'pure_meta' when fre < target - 12 then 'too_hard' when fre > target + 12 then 'too_easy' when tot >= 0.8 then 'good' else 'other' end as label from h) select tag, " + ", ".join(f"count(*) filter (label = '{x}') as {x}" for x in ("good", "pure_meta", "too_hard", "too_easy", "other")) + " from l group by tag",
    "examples": f"with {K.Q_SCORED} select tag, id, lv, tot, k from (select tag, id, lv, tot, (row_number() over (partition by tag, lv order by tot desc, id))::int as k from s where tot is not null) where k <= 3",
}
