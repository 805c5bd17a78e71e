"""Queries: partitions, samples, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import rewards as RW
from lexloom.functions import text as T
from lexloom.operators import ratings as R
from lexloom.operators import relational as O
from lexloom.plans import kit as K


def _kb(spark: SparkSession, d: str) -> DataFrame:
    return K.snippets(spark, d).where(F.col("split").isin("train", "val"))


_KB = f"{K.Q_SNIPPETS}, kb as (select * from sn where split in ('train', 'val'))"


def kb_union(spark: SparkSession, d: str) -> DataFrame:
    s = K.snippets(spark, d)
    return s.where("split = 'train'").unionByName(s.where("split = 'val'")).select("id", "source", "title", "split")


def kb_filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _kb(spark, d).where(F.col("id").startswith("stat")).select("id", "source", "title")


def kb_filter_title(spark: SparkSession, d: str) -> DataFrame:
    return _kb(spark, d).where(F.contains("title", F.lit("ford")) & ~F.contains("title", F.lit("berg"))).select("id", "title")


def kb_fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    return O.fraction_sample(_kb(spark, d).select("id").distinct(), "id", 0.1, C.SEED)


def test_head(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 test passages by id."""
    return K.snippets(spark, d).where("split = 'test'").select("id").distinct().orderBy("id").limit(20)


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return O.hash_split(K.snippets(spark, d).select("id").distinct(), "id").select("id", "bucket", "part")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return O.group_split(K.snippets(spark, d).select("id", "source", "title").distinct(), ["source", "title"]).select("id", "part")


def split_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct ids and parts of the split: a partition covers every id once."""
    s = O.hash_split(K.snippets(spark, d).select("id").distinct(), "id")
    return s.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum(F.when(F.col("part").isNotNull(), 1).otherwise(0)).alias("n_placed"))


def passage_cap(spark: SparkSession, d: str) -> DataFrame:
    return O.capped(K.snippets(spark, d).select("id", "source").distinct(), ["source"], ["id"], 12).select("id", "source")


def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "documents").where((T.word_count("text") >= 50) & (F.length("text") >= 80) & ~F.col("text").rlike("(?i)(^chapter|^title:)")).select("doc_id")


def level_expansion(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.createDataFrame([(x,) for x in C.LEVELS], "lv string")
    return K.snippets(spark, d).where("split = 'test'").select("id").distinct().crossJoin(F.broadcast(levels))  # three rows


def reward_weights_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The weights that remain when each part is dropped in turn, rescaled to one."""
    w = spark.createDataFrame(list(C.WEIGHTS.items()), "part string, weight double")
    j = w.crossJoin(F.broadcast(w.select(F.col("part").alias("dropped")))).where("part <> dropped")  # five rows
    return j.select("dropped", "part", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("dropped")), 9).alias("weight"))


def metric_long(spark: SparkSession, d: str) -> DataFrame:
    s = K.scored(spark, d, "rew", "tot", "fre", "parts", "pure_commentary")
    rows = s.select("tag", "id", "lv", F.when(K.pure(), 0.0).otherwise(F.col("tot")).alias("tot"), "fre", *[F.col(f"parts.{p}").alias(p) for p in C.PARTS])
    return rows.unpivot(["tag", "id", "lv"], ["tot", "fre", *C.PARTS], "metric", "value").where("value is not null")


def nli_normalised(spark: SparkSession, d: str) -> DataFrame:
    return K.scored(spark, d, "nli").select("tag", "id", "lv", *[RW.nli_part("nli", p).alias(p) for p in ("entail", "neutral", "contra")])


def contradiction_value(spark: SparkSession, d: str) -> DataFrame:
    """Contradiction, or a proxy from faithfulness where the scorer gave none."""
    s = K.scored(spark, d, "nli", "parts")
    return s.select("tag", "id", "lv", F.coalesce(RW.contradiction("nli"), F.when(F.coalesce(F.col("parts.faith"), F.lit(0.0)) < 0.5, 1.0).otherwise(0.0)).alias("contra"))


def aligned_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = K.scored(spark, d, "tot", "fre")
    a, b = (s.where(F.col("tag") == t).select("id", "lv", F.col("tot").alias(f"tot_{t}"), F.col("fre").alias(f"fre_{t}")) for t in ("base", "tuned"))
    return a.join(b, ["id", "lv"])


def common_support(spark: SparkSession, d: str) -> DataFrame:
    """(id, lv) that at least three systems share with how many there are."""
    return K.scored(spark, d).groupBy("id", "lv").agg(F.count_distinct("tag").alias("n_tags")).where("n_tags >= 3")


def complete_ids(spark: SparkSession, d: str) -> DataFrame:
    return O.complete_keys(K.scored(spark, d).where(F.col("lv").isin(*C.LEVELS)), "id", "lv", 3)


def topup_anti(spark: SparkSession, d: str) -> DataFrame:
    """Passages that no system has rewritten yet."""
    return K.snippets(spark, d).select("id").distinct().join(K.table(spark, d, "scored").select("id"), "id", "left_anti")


def variant_preference(spark: SparkSession, d: str) -> DataFrame:
    """Of each system the re-scored rows if it has any, else all its rows."""
    s = K.scored(spark, d, "pure_commentary", "row_id").withColumn("priority", F.when(F.col("pure_commentary").isNotNull(), 0).otherwise(1))
    return O.preferred(s, "tag", "priority").select("tag", "id", "lv", "priority")


def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Judge rows with the source and seconds of their scored row."""
    j = K.table(spark, d, "judged").select("judge_id", "row_id")
    raw = K.table(spark, d, "scored").select("row_id", "src", "sec")
    return j.join(raw, "row_id", "left").select("judge_id", F.coalesce(F.length(F.nullif("src", F.lit(""))), F.lit(0)).alias("src_chars"), "sec")


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    return R.unblinded(R.sheets(K.table(spark, d, "rated")), K.table(spark, d, "blind_key"))


def unblind(spark: SparkSession, d: str) -> DataFrame:
    return _sheets(spark, d).select("rater", "item_id", "label", "system")


Q_SHEETS = f"""r0 as (select rater, item_id, upper(trim(label)) as label, rated_at, {', '.join(f"case when {x}_1_5 between 1 and 5 then {x}_1_5 end as {x}" for x in C.DIMS)}, upper(substr(trim(valid_rewrite), 1, 1)) as valid from rated where rater is not null and item_id is not null and label is not null),
sh as (select * exclude (k, rated_at) from (select *, row_number() over (partition by rater, item_id, label order by rated_at desc nulls last, {', '.join(f'{x} desc nulls last' for x in C.DIMS)}, valid desc nulls last) as k from r0) where k = 1),
k0 as (select rater, item_id, upper(trim(label)) as label, min(system) as own from blind_key where system is not null group by all),
kf as (select item_id, min(rater) as rater from k0 group by 1), ko as (select k0.item_id, k0.label, k0.own as other from k0 join kf using (item_id, rater)),
kh as (select distinct rater, item_id, true as has from k0),
ub as (select sh.*, coalesce(own, case when has is null then other end) as system from sh left join k0 using (rater, item_id, label) left join kh using (rater, item_id) left join ko using (item_id, label)),
u as (select * from ub where system is not null)"""
Q_LONG = f"lg as (select item_id, system, rater, dim, score::double as score from u unpivot (score for dim in ({', '.join(C.DIMS)})))"
Q_MATRIX = "mx as (select item_id, system, dim, rater, score, n, round((s - score) / (n - 1), 9) as others from lg join (select item_id, system, dim, count(*) as n, sum(score) as s from lg group by all having count(*) >= 3) using (item_id, system, dim))"


def rater_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Each score beside the number and the mean of its cell's others, over all raters."""
    return R.beside(R.long_scores(_sheets(spark, d)))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Judge scores by cell: the last reply (greatest judge_id) for each (id, lv, system) with a judge."""
    j = K.table(spark, d, "judged").where("judge is not null").select("id", F.lower(F.trim("lv")).alias("lv"), "system", "judge_id", "judge", "tot", "fre")
    return j.groupBy("id", "lv", "system").agg(F.max_by(F.struct("judge", "tot", "fre"), "judge_id").alias("x")).select("id", "lv", "system", "x.*")


Q_JUDGED = "jg as (select id, lv, system, judge, tot, fre from (select id, lower(trim(lv)) as lv, system, judge, tot, fre, row_number() over (partition by id, lower(trim(lv)), system order by judge_id desc) as k from judged where judge is not null) where k = 1)"


def three_lens(spark: SparkSession, d: str) -> DataFrame:
    """Human mean, judge score and stored reading ease of the cells that have all three."""
    h = _sheets(spark, d).groupBy("item_id", "system").agg(F.avg("difficulty").alias("human")).where("human is not null")
    j = _judged(spark, d).select(F.concat_ws("_", "id", "lv").alias("item_id"), "system", "id", "lv", F.col("judge.difficulty").cast("double").alias("judge"), "tot", "fre")
    return h.join(j.hint("merge"), ["item_id", "system"]).where("fre is not null and judge is not null")  # both grow


Q_LENS = "hm as (select item_id, system, avg(difficulty) as human from u group by all having avg(difficulty) is not null), tl as (select hm.item_id, system, id, lv, human, judge.difficulty::double as judge, tot, fre from hm join (select *, id || '_' || lv as item_id from jg) using (item_id, system) where fre is not null and judge.difficulty is not null)"


def three_lens_join(spark: SparkSession, d: str) -> DataFrame:
    return three_lens(spark, d).where("system <> 'base'").select("item_id", "system", F.round("human", 9).alias("human"), "judge", "tot", "fre")


def pollution_delta(spark: SparkSession, d: str) -> DataFrame:
    """What counting remarks as failures takes from each system's mean."""
    s = K.scored(spark, d, "rew", "tot", "pure_commentary").where("tot is not null")
    honest = F.when(K.pure(), 0.0).otherwise(F.col("tot"))
    return s.groupBy("tag").agg(F.count("*").alias("n"), F.sum(K.pure().cast("long")).alias("n_pure"), F.round(F.avg("tot"), 9).alias("raw"), F.round(F.avg(honest), 9).alias("honest"), F.round(F.avg(F.col("tot") - honest), 9).alias("delta"))


def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    """Systems in alphabetical order as attempts at an (id, lv): the best until the first that passes, at most five."""
    s = K.scored(spark, d, "tot").where("tot is not null")
    s = s.withColumn("attempt", F.row_number().over(Window.partitionBy("id", "lv").orderBy("tag")))
    s = s.withColumn("passed", F.col("tot") >= C.AUTO_GOOD)
    return O.best_attempts(s, ["id", "lv"], "attempt", "tot", "passed", 5).select("id", "lv", "tag", "attempt", "tot", "passed", "tried")


def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id", "lv")
    s = K.scored(spark, d, "tot").where("tot is not null")
    return s.select("tag", "id", "lv", F.round((F.col("tot") - F.avg("tot").over(w)) / (F.coalesce(F.stddev_samp("tot").over(w), F.lit(0.0)) + 1e-6), 9).alias("advantage"))


def system_rank(spark: SparkSession, d: str) -> DataFrame:
    m = _sheets(spark, d).groupBy("system").agg(F.round(F.avg("overall"), 9).alias("mean"), F.count("overall").alias("n"))
    return m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))))  # one row a system


def rank_with_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the systems by judge mean within each level, withheld where a system has too few cells."""
    m = _judged(spark, d).groupBy("lv", "system").agg(F.round(F.avg("judge.difficulty"), 9).alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy("lv")
    return m.withColumn("rank", F.when(F.min("n").over(w) >= C.MIN_RANK_CELLS, F.rank().over(w.orderBy(F.desc("mean")))))


def blind_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels A-F for the systems of each item and rater, shuffled by hash."""
    cells = K.table(spark, d, "blind_key").select("rater", "item_id", "system").where("system is not null").distinct()
    order = F.md5(F.concat_ws("|", F.lit(str(C.SEED)), "rater", "item_id", "system").cast("binary"))
    n = F.row_number().over(Window.partitionBy("rater", "item_id").orderBy(order))
    return cells.withColumn("label", F.substring(F.lit("ABCDEF"), n, F.lit(1)))


def custom_order(spark: SparkSession, d: str) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("tuned", "looped", "base", "lexsub", "seqa", "seqb")])
    w = Window.partitionBy("id", "lv").orderBy(F.array_position(order, F.col("tag")))
    return K.scored(spark, d).select("tag", "id", "lv", F.row_number().over(w).alias("position"))


def length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at most 320 words in all, in batches of 16 by (id, lv, tag)."""
    s = K.scored(spark, d, "src", "rew").where("src is not null and rew is not null").withColumn("n", T.word_count("src") + T.word_count("rew")).where("n <= 320")
    return O.numbered(s.select("tag", "id", "lv", "n"), ["id", "lv", "tag"], "at").select("tag", "id", "lv", "n", F.floor((F.col("at") - 1) / 16).alias("batch"))


def item_key_parts(spark: SparkSession, d: str) -> DataFrame:
    """Item ids taken apart at the last underscore."""
    i = K.table(spark, d, "rated").select("item_id").distinct().where("item_id is not null")
    return i.select("item_id", F.regexp_extract("item_id", "^(.*)_([^_]*)$", 1).alias("id"), F.regexp_extract("item_id", "^(.*)_([^_]*)$", 2).alias("lv"))


_S = f"with {K.Q_SCORED}"
_U = f"with {Q_SHEETS}"
_part = "case when b < 80 then 'train' when b < 90 then 'val' else 'test' end"
_buckets = "b as (select id, (('0x' || md5('legal:' || id))::uhugeint % 100)::bigint as b from (select distinct id from sn))"

QUERIES = {f.__name__: f for f in (
    kb_union, kb_filter_prefix, kb_filter_title, kb_fraction_sample, test_head, hash_split, group_split, split_integrity, passage_cap, min_length_filter, level_expansion, reward_weights_ablation,
    metric_long, nli_normalised, contradiction_value, aligned_pairs, common_support, complete_ids, topup_anti, variant_preference, backfill, unblind, rater_matrix, three_lens_join, pollution_delta,
    best_attempt, group_advantage, system_rank, rank_with_coverage, blind_labels, custom_order, length_batches, item_key_parts,
)}

SQL = {
    "kb_union": f"with {K.Q_SNIPPETS} select id, source, title, split from sn where split = 'train' union all select id, source, title, split from sn where split = 'val'",
    "kb_filter_prefix": f"with {_KB} select id, source, title from kb where id like 'stat%'",
    "kb_filter_title": f"with {_KB} select id, title from kb where contains(title, 'ford') and not contains(title, 'berg')",
    "kb_fraction_sample": f"with {_KB} select id from (select id, row_number() over (order by md5('42:' || id)) as k, count(*) over () as n from (select distinct id from kb)) where k <= greatest(1, floor(n * 0.1::double))",
    "test_head": f"with {K.Q_SNIPPETS} select distinct id from sn where split = 'test' order by id limit 20",
    "hash_split": f"with {K.Q_SNIPPETS}, {_buckets} select id, b as bucket, {_part} as part from b",
    "group_split": f"with {K.Q_SNIPPETS}, g as (select distinct id, source, title, md5('42|' || coalesce(source, '') || '|' || coalesce(title, '')) as g from sn), r as (select g, row_number() over (order by g) as r, count(*) over () as n from (select distinct g from g)) select id, case when r <= floor(0.8::double * n) then 'train' when r <= floor(0.8::double * n) + floor(0.1::double * n) then 'val' else 'test' end as part from g join r using (g)",
    "split_integrity": f"with {K.Q_SNIPPETS}, {_buckets} select count(*) as n, count(distinct id) as n_ids, count({_part})::bigint as n_placed from b",
    "passage_cap": f"with {K.Q_SNIPPETS} select id, source from (select *, row_number() over (partition by source order by id) as k from (select distinct id, source from sn)) where k <= 12",
    "min_length_filter": f"select doc_id from documents where len({K.q_words('text')}) >= 50 and length(text) >= 80 and not regexp_matches(text, '(?i)(^chapter|^title:)')",
    "level_expansion": f"with {K.Q_SNIPPETS} select id, lv from (select distinct id from sn where split = 'test'), (select unnest({K.q_list(list(C.LEVELS))}) as lv)",
    "reward_weights_ablation": "with w(part, weight) as (values " + ", ".join(f"('{k}', {v}::double)" for k, v in C.WEIGHTS.items()) + ") select b.part as dropped, a.part, round(a.weight / sum(a.weight) over (partition by b.part), 9) as weight from w a join w b on a.part <> b.part",
    "metric_long": f"{_S}, m as (select tag, id, lv, case when {K.Q_PURE} then 0 else tot end as tot, fre, {', '.join(f'parts.{p} as {p}' for p in C.PARTS)} from s) select tag, id, lv, metric, value from m unpivot (value for metric in (tot, fre, {', '.join(C.PARTS)}))",
    "nli_normalised": f"{_S} select tag, id, lv, " + ", ".join(f"try_cast(case when json_valid(nli) then coalesce(json_extract_string(nli, '$.{p}'), json_extract_string(nli, '$[{i}]')) end as double) as {p}" for i, p in enumerate(("entail", "neutral", "contra"))) + " from s",
    "contradiction_value": f"{_S} select tag, id, lv, coalesce(try_cast(case when json_valid(nli) then coalesce(json_extract_string(nli, '$.contra'), json_extract_string(nli, '$[2]')) end as double), case when coalesce(parts.faith, 0) < 0.5 then 1::double else 0::double end) as contra from s",
    "aligned_pairs": f"{_S} select a.id, a.lv, a.tot as tot_base, a.fre as fre_base, b.tot as tot_tuned, b.fre as fre_tuned from s a join s b on a.id = b.id and a.lv = b.lv where a.tag = 'base' and b.tag = 'tuned'",
    "common_support": f"{_S} select id, lv, count(distinct tag) as n_tags from s group by all having count(distinct tag) >= 3",
    "complete_ids": f"{_S} select id from s where lv in ('beginner', 'intermediate', 'advanced') group by id having count(distinct lv) = 3",
    "topup_anti": f"with {K.Q_SNIPPETS} select distinct id from sn where id not in (select id from scored where id is not null)",
    "variant_preference": f"{_S}, v as (select tag, id, lv, case when pure_commentary is not null then 0 else 1 end as priority from s) select tag, id, lv, priority from v where priority = (select min(priority) from v b where b.tag = v.tag)",
    "backfill": "select judge_id, coalesce(length(nullif(src, '')), 0)::int as src_chars, sec from judged left join (select row_id, src, sec from scored) using (row_id)",
    "unblind": f"{_U} select rater, item_id, label, system from u",
    "rater_matrix": f"{_U}, {Q_LONG}, {Q_MATRIX} select * from mx",
    "three_lens_join": f"{_U}, {Q_JUDGED}, {Q_LENS} select item_id, system, round(human, 9) as human, judge, tot, fre from tl where system <> 'base'",
    "pollution_delta": f"{_S}, h as (select tag, tot, {K.Q_PURE} as p, case when {K.Q_PURE} then 0 else tot end as honest from s where tot is not null) select tag, count(*) as n, count(*) filter (p) as n_pure, round(avg(tot), 9) as raw, round(avg(honest), 9) as honest, round(avg(tot - honest), 9) as delta from h group by tag",
    "best_attempt": f"{_S}, a as (select tag, id, lv, tot, row_number() over (partition by id, lv order by tag)::int as attempt, tot >= 0.8 as passed from s where tot is not null), f as (select *, min(case when passed then attempt end) over (partition by id, lv) as f from a), t as (select *, count(*) over (partition by id, lv) as tried, row_number() over (partition by id, lv order by tot desc, attempt) as k from f where attempt <= 5 and (f is null or attempt <= f)) select id, lv, tag, attempt, tot, passed, tried from t where k = 1",
    "group_advantage": f"{_S} select tag, id, lv, round((tot - avg(tot) over w) / (coalesce(stddev_samp(tot) over w, 0) + 1e-6), 9) as advantage from s where tot is not null window w as (partition by id, lv)",
    "system_rank": f"{_U}, m as (select system, round(avg(overall), 9) as mean, count(overall) as n from u group by 1) select system, mean, n, rank() over (order by mean desc)::int as rank from m",
    "rank_with_coverage": f"with {Q_JUDGED}, m as (select lv, system, round(avg(judge.difficulty), 9) as mean, count(*) as n from jg group by all) select lv, system, mean, n, case when min(n) over (partition by lv) >= 20 then rank() over (partition by lv order by mean desc)::int end as rank from m",
    "blind_labels": "select rater, item_id, system, substr('ABCDEF', (row_number() over (partition by rater, item_id order by md5('42|' || rater || '|' || item_id || '|' || system)))::int, 1) as label from (select distinct rater, item_id, system from blind_key where system is not null)",
    "custom_order": f"{_S} select tag, id, lv, (row_number() over (partition by id, lv order by list_position(['tuned', 'looped', 'base', 'lexsub', 'seqa', 'seqb'], tag)))::int as position from s",
    "length_batches": f"{_S}, n as (select tag, id, lv, (len({K.q_words('src')}) + len({K.q_words('rew')}))::int as n from s where src is not null and rew is not null), a as (select *, row_number() over (order by id, lv, tag) as pos from n where n <= 320) select tag, id, lv, n, floor((pos - 1) / 16)::bigint as batch from a",
    "item_key_parts": "select item_id, regexp_extract(item_id, '^(.*)_([^_]*)$', 1) as id, regexp_extract(item_id, '^(.*)_([^_]*)$', 2) as lv from (select distinct item_id from rated where item_id is not null)",
}
