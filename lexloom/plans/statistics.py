"""Queries: rank tests, variance tests, and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import rewards as RW
from lexloom.operators import ranks as R
from lexloom.operators import tests_stat as S
from lexloom.plans import kit as K
from lexloom.plans import relations as REL
from lexloom.plans.reports import Q_ROWS, _long, _rows

rnd = lambda c, name=None: F.round(c, 9).alias(name or c)


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return K.scored(spark, d, "tot").where("tot is not null")


def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    p = K.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return R.average_rank(p, ["p_brand"], "p_size", "rank").select("p_partkey", "p_brand", "rank")


def kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    return S.kruskal_wallis(_totals(spark, d), ["lv"], "tag", "tot").select("lv", "n", "k", rnd("h"), rnd("epsilon2"))


def anova_eta2(spark: SparkSession, d: str) -> DataFrame:
    return S.anova(_totals(spark, d), ["lv"], "tag", "tot").select("lv", "n", "k", rnd("f"), rnd("eta2"))


def dunn_posthoc(spark: SparkSession, d: str) -> DataFrame:
    return S.dunn(_totals(spark, d), ["lv"], "tag", "tot").select("lv", "a", "b", rnd("z"))


def _against_base(spark: SparkSession, d: str) -> DataFrame:
    t = _totals(spark, d)
    b = t.where("tag = 'base'").select("id", "lv", F.col("tot").alias("base"))
    return t.where("tag <> 'base'").join(b, ["id", "lv"]).select("tag", "id", "lv", F.round(F.col("tot") - F.col("base"), 9).alias("gap"))


def wilcoxon_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.signed_rank(_against_base(spark, d), ["tag"], "gap").select("tag", "n_pairs", "n_zero", "n", rnd("w_plus"), rnd("w_minus"), rnd("w"))


def median_diff(spark: SparkSession, d: str) -> DataFrame:
    return _against_base(spark, d).groupBy("tag", "lv").agg(F.count("*").alias("n"), rnd(F.median("gap"), "median"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Beginner less advanced difficulty of each passage and system, from item means."""
    m = _long(spark, d).where("dim = 'difficulty'").groupBy("item_id", "system").agg(F.avg("score").alias("m"))
    m = m.select(F.regexp_extract("item_id", "^(.*)_([^_]*)$", 1).alias("id"), F.regexp_extract("item_id", "^(.*)_([^_]*)$", 2).alias("lv"), "system", "m")
    p = m.groupBy("id", "system").agg(*[F.avg(F.when(F.col("lv") == x, F.col("m"))).alias(x) for x in ("beginner", "advanced")])
    return p.where("beginner is not null and advanced is not null").select("id", "system", F.round(F.col("beginner") - F.col("advanced"), 9).alias("gap"))


def paired_gap(spark: SparkSession, d: str) -> DataFrame:
    g = _gaps(spark, d)
    s = S.signed_rank(g, ["system"], "gap")
    m = g.groupBy("system").agg(F.avg("gap").alias("mean_gap"))
    return s.join(m, "system").select("system", "n_pairs", "n_zero", rnd("mean_gap"), rnd("w"))


def _item_means(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).where("dim = 'overall'").groupBy("item_id", "system").agg(F.round(F.avg("score"), 9).alias("m"))


def wilcoxon_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """One system against each other on shared items, one-sided: the statistics that the adjusted p comes from."""
    m = _item_means(spark, d)
    a = m.where("system = 'tuned'").select("item_id", F.col("m").alias("x"))
    g = m.where("system <> 'tuned'").join(a, "item_id").select("system", F.round(F.col("x") - F.col("m"), 9).alias("gap"))
    return S.signed_rank(g, ["system"], "gap").where("n_pairs >= 6").select("system", "n_pairs", "n", rnd("w_plus"))


def friedman(spark: SparkSession, d: str) -> DataFrame:
    return S.friedman(_item_means(spark, d), "item_id", "system", "m", 6).select("n", "k", rnd("chi2"))


def _hallucination(spark: SparkSession, d: str) -> DataFrame:
    s = _rows(spark, d)
    mass = F.sum(F.coalesce("contra", F.when(F.coalesce(F.col("parts.faith"), F.lit(0.0)) < 0.5, 1.0).otherwise(0.0)))
    return s.groupBy("tag").agg(mass.alias("mass"), (F.count("*") - mass).alias("rest"))


def chi2_contingency(spark: SparkSession, d: str) -> DataFrame:
    return S.chi2(_hallucination(spark, d), "tag", ["mass", "rest"]).select("dof", rnd("chi2"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    q = K.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    return K.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").join(q, "o_orderkey")


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return R.spearman(_orders(spark, d), [], "o_totalprice", "quantity").select("n", rnd("rho"))


def rank_rho(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations over the systems between human, judge and rule means."""
    t = REL.three_lens(spark, d).groupBy("system").agg(F.round(F.avg("human"), 9).alias("human"), F.round(F.avg("judge"), 9).alias("judge"), F.round(F.avg("tot"), 9).alias("auto"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("human", "judge"), ("human", "auto"), ("judge", "auto"))])).alias("p")
    return R.spearman(t.select(pairs).select("p.*"), ["pair"], "x", "y", 4).select("pair", "n", rnd("rho"))


def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Each judge dimension against each stored metric."""
    dims, metrics = ("difficulty", "faithfulness", "terminology", "fluency"), ("tot", "fre")
    j = REL._judged(spark, d).where("judge is not null")
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("dim"), F.lit(b).alias("metric"), F.col(f"judge.{a}").cast("double").alias("x"), F.col(b).alias("y")) for a in dims for b in metrics])).alias("c")
    return R.spearman(j.select(cells).select("c.*"), ["dim", "metric"], "x", "y").select("dim", "metric", "n", rnd("rho"))


def within_system_spearman(spark: SparkSession, d: str) -> DataFrame:
    r = R.spearman(REL.three_lens(spark, d), ["system"], "human", "judge").where("rho is not null")
    return r.agg(F.count("*").alias("n_systems"), rnd(F.avg("rho"), "mean_rho"))


def partial_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Human against judge difficulty given the stored reading ease."""
    n, rho, _ = S.partial_spearman(REL.three_lens(spark, d), "human", "judge", ["fre"])
    return spark.createDataFrame([(n, None if rho is None else round(rho, 9))], "n long, rho double")


def level_split_rho(spark: SparkSession, d: str) -> DataFrame:
    """Human against judge by level, over cells and over passage means."""
    t = REL.three_lens(spark, d)
    cell = R.spearman(t, ["lv"], "human", "judge").withColumn("unit", F.lit("cell"))
    p = t.groupBy("id", "lv").agg(F.round(F.avg("human"), 9).alias("human"), F.round(F.avg("judge"), 9).alias("judge"))
    return cell.unionByName(R.spearman(p, ["lv"], "human", "judge").withColumn("unit", F.lit("passage"))).select("unit", "lv", "n", rnd("rho"))


def order_swap(spark: SparkSession, d: str) -> DataFrame:
    """Two arms (the raters of even and of odd hash) by dimension: means over the cells that both saw, difference, equal means and correlation."""
    arm = F.conv(F.substring(F.md5(F.concat(F.lit("arm:"), "rater").cast("binary")), 32, 1), 16, 10).cast("int") % 2
    mean = lambda k: F.round(F.avg(F.when(arm == k, F.col("score"))), 9)
    m = _long(spark, d).groupBy("item_id", "system", "dim").agg(mean(0).alias("a"), mean(1).alias("b")).where("a is not null and b is not null")
    g = m.groupBy("dim").agg(rnd(F.avg("a"), "mean_a"), rnd(F.avg("b"), "mean_b"), rnd(F.avg("b") - F.avg("a"), "delta"), rnd(100 * F.avg((F.col("a") == F.col("b")).cast("double")), "exact"))
    return g.join(R.spearman(m, ["dim"], "a", "b").select("dim", "n", rnd("rho")), "dim")


def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """Step-up adjustment within each system and level, with contradiction probabilities as p."""
    s = K.scored(spark, d, "nli").select("tag", "id", "lv", RW.contradiction("nli").alias("p")).where("p is not null")
    return R.bh(s, ["tag", "lv"], "p").select("tag", "id", "lv", F.round("q", 9).alias("q"))


def p_values(spark: SparkSession, d: str) -> DataFrame:
    """p-values and stars of the tests above."""
    one = lambda df, test, key, stat: df.select(F.lit(test).alias("test"), F.col(key).cast("string").alias("key"), F.col(stat).cast("double").alias("statistic"), "p")
    t = _totals(spark, d)
    kw = S.with_p(S.kruskal_wallis(t, ["lv"], "tag", "tot").withColumn("dof", F.col("k") - 1), "chi2", "h", "dof")
    an = S.with_p(S.anova(t, ["lv"], "tag", "tot").withColumns({"d1": F.col("k") - 1, "d2": F.col("n") - F.col("k")}), "f", "f", "d1", "d2")
    du = S.with_p(S.dunn(t, ["lv"], "tag", "tot").withColumn("key", F.concat_ws(" ", "lv", "a", "b")), "normal", "z")
    wx = S.signed_rank_p(S.signed_rank(_against_base(spark, d), ["tag"], "gap"))
    fr = S.with_p(S.friedman(_item_means(spark, d), "item_id", "system", "m", 6).withColumns({"dof": F.col("k") - 1, "key": F.lit("all")}), "chi2", "chi2", "dof")
    ch = S.with_p(S.chi2(_hallucination(spark, d), "tag", ["mass", "rest"]).withColumn("key", F.lit("all")), "chi2", "chi2", "dof")
    sp = S.with_p(R.spearman(_orders(spark, d), [], "o_totalprice", "quantity").withColumn("key", F.lit("all")), "correlation", "rho", "n")
    out = one(kw, "kruskal_wallis", "lv", "h")
    for df, test, key, stat in ((an, "anova", "lv", "f"), (du, "dunn", "key", "z"), (wx, "wilcoxon", "tag", "w"), (fr, "friedman", "key", "chi2"), (ch, "chi2", "key", "chi2"), (sp, "spearman", "key", "rho")):
        out = out.unionByName(one(df, test, key, stat))
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return out.withColumn("stars", stars)


# ---- SQL ----

_T = f"{K.Q_SCORED}, t as (select tag, id, lv, tot from s where tot is not null)"
q_rank = lambda v, by: f"(rank() over ({f'partition by {by} ' if by else ''}order by {v}) + (count(*) over (partition by {f'{by}, ' if by else ''}{v}) - 1) / 2.0::double)"
_RANKED = lambda src: f"rk as (select lv, tag, {q_rank('tot', 'lv')} as r from {src}), gr as (select lv, tag, count(*) as n_g, sum(r) as r_g from rk group by all), ti as (select lv, sum(c)::double as n, sum(c::double * c * c - c) as ties from (select lv, tot, count(*) as c from {src} group by all) group by lv)"
_KW = f"{_T}, {_RANKED('t')}"
_KW_OF = lambda head, src: f"{"" if head.startswith("with") else "with "}{head}, {_RANKED(src)}, h as (select lv, count(*) as k, sum(r_g * r_g / n_g) as s from gr group by lv), z as (select lv, n, k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0) as h from h join ti using (lv)) select lv, n::bigint as n, k, round(h, 9) as h, round(h / (n - 1), 9) as epsilon2 from z where k > 1"
_GAP = f"{_T}, g as (select a.tag, a.id, a.lv, round(a.tot - b.tot, 9) as gap from t a join t b on a.id = b.id and a.lv = b.lv and b.tag = 'base' where a.tag <> 'base')"
_signed = lambda by, src: f"lv_ as (select {by}, gap, {q_rank('abs(gap)', by)} as r from {src} where gap <> 0), sr as (select {by}, count(*) as n, coalesce(sum(r) filter (gap > 0), 0)::double as w_plus, coalesce(sum(r) filter (gap < 0), 0)::double as w_minus from lv_ group by all), tt as (select {by}, count(*) as n_pairs, count(*) filter (gap = 0) as n_zero from {src} group by all)"
_LONG = f"{REL.Q_SHEETS}, {REL.Q_LONG}"
_GAPS = f"{_LONG}, im as (select item_id, system, avg(score) as m from lg where dim = 'difficulty' group by all), ip as (select regexp_extract(item_id, '^(.*)_([^_]*)$', 1) as id, system, avg(m) filter (regexp_extract(item_id, '^(.*)_([^_]*)$', 2) = 'beginner') as b, avg(m) filter (regexp_extract(item_id, '^(.*)_([^_]*)$', 2) = 'advanced') as a from im group by all), g as (select id, system, round(b - a, 9) as gap from ip where a is not null and b is not null)"
_MEANS = f"{_LONG}, m as (select item_id, system, round(avg(score), 9) as m from lg where dim = 'overall' group by all)"
_corr = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
_rho = lambda src, by, x, y, least=5: f"select {by + ', ' if by else ''}count(*) as n, round(case when count(*) >= {least} then {_corr('rx', 'ry')} end, 9) as rho from (select *, {q_rank(x, by)} as rx, {q_rank(y, by)} as ry from {src} where {x} is not null and {y} is not null) {f'group by {by}' if by else ''}"
_LENS = f"{REL.Q_SHEETS}, {REL.Q_JUDGED}, {REL.Q_LENS}"
_MASS = f"{Q_ROWS}, ms as (select tag, sum(coalesce(contra, case when coalesce(parts.faith, 0) < 0.5 then 1::double else 0::double end)) as mass, count(*) as c from h group by tag), o as (select tag, 'mass' as col, mass as o from ms union all select tag, 'rest', c - mass from ms)"

QUERIES = {f.__name__: f for f in (
    avg_rank, kruskal_wallis, anova_eta2, dunn_posthoc, wilcoxon_signed_rank, median_diff, paired_gap, wilcoxon_bonferroni, friedman, chi2_contingency, spearman, rank_rho, spearman_matrix,
    within_system_spearman, partial_spearman, level_split_rho, order_swap, bh_fdr, p_values,
)}

SQL = {
    "avg_rank": f"select p_partkey, p_brand, {q_rank('p_size', 'p_brand')} as rank from part",
    "kruskal_wallis": _KW_OF(_T, "t"),
    "anova_eta2": f"with {_T}, a as (select lv, tag, tot, avg(tot) over (partition by lv) as m, avg(tot) over (partition by lv, tag) as mg from t), z as (select lv, count(*) as n, count(distinct tag) as k, sum((mg - m) * (mg - m)) as b, sum((tot - mg) * (tot - mg)) as w from a group by lv) select lv, n, k, round((b / (k - 1)) / nullif(w / (n - k), 0), 9) as f, round(coalesce(b / nullif(b + w, 0), 0), 9) as eta2 from z where k > 1",
    "dunn_posthoc": f"with {_KW} select a.lv, a.tag as a, b.tag as b, round((a.r_g / a.n_g - b.r_g / b.n_g) / sqrt(n * (n + 1) / 12 * (1.0::double / a.n_g + 1.0::double / b.n_g)), 9) as z from gr a join gr b on a.lv = b.lv and a.tag < b.tag join ti on ti.lv = a.lv",
    "wilcoxon_signed_rank": f"with {_GAP}, {_signed('tag', 'g')} select tag, n_pairs, n_zero, coalesce(n, 0) as n, round(coalesce(w_plus, 0), 9) as w_plus, round(coalesce(w_minus, 0), 9) as w_minus, round(coalesce(least(w_plus, w_minus), 0), 9) as w from tt left join sr using (tag)",
    "median_diff": f"with {_GAP} select tag, lv, count(*) as n, round(median(gap), 9) as median from g group by all",
    "paired_gap": f"with {_GAPS}, {_signed('system', 'g')}, mg as (select system, avg(gap) as mean_gap from g group by 1) select system, n_pairs, n_zero, round(mean_gap, 9) as mean_gap, round(coalesce(least(w_plus, w_minus), 0), 9) as w from tt left join sr using (system) join mg using (system)",
    "wilcoxon_bonferroni": f"with {_MEANS}, g as (select b.system, round(a.m - b.m, 9) as gap from m a join m b using (item_id) where a.system = 'tuned' and b.system <> 'tuned'), {_signed('system', 'g')} select system, n_pairs, coalesce(n, 0) as n, round(coalesce(w_plus, 0), 9) as w_plus from tt left join sr using (system) where n_pairs >= 6",
    "friedman": f"with {_MEANS}, f as (select *, {q_rank('m', 'item_id')} as r from m where item_id in (select item_id from m group by 1 having count(distinct system) = 6)), sm as (select sum(s * s) as ss, max(n)::double as n from (select sum(r) as s, count(*) as n from f group by system)), ti as (select coalesce(sum(c::double * c * c - c), 0) as t from (select count(*) as c from f group by item_id, m)) select n::bigint as n, 6 as k, round((12 / (n * 6 * 7) * ss - 3 * n * 7) / nullif(1 - t / (n * 6 * 35), 0), 9) as chi2 from sm, ti",
    "chi2_contingency": f"with {_MASS}, e as (select o, sum(o) over (partition by tag) * sum(o) over (partition by col) / sum(o) over () as e from o) select (select (count(distinct tag) - 1)::int from o) as dof, round(sum((o - e) * (o - e) / e), 9) as chi2 from e",
    "spearman": f"with q as (select l_orderkey as o_orderkey, sum(l_quantity) as quantity from lineitem group by 1), x as (select o_totalprice, quantity from orders join q using (o_orderkey)) {_rho('x', '', 'o_totalprice', 'quantity')}",
    "rank_rho": f"with {_LENS}, y as (select system, round(avg(human), 9) as human, round(avg(judge), 9) as judge, round(avg(tot), 9) as auto from tl group by 1), x as (select 'human-judge' as pair, human as x, judge as y from y union all select 'human-auto', human, auto from y union all select 'judge-auto', judge, auto from y) {_rho('x', 'pair', 'x', 'y', 4)}",
    "spearman_matrix": f"with {REL.Q_JUDGED}, x as (" + " union all ".join(f"select '{a}' as dim, '{b}' as metric, judge.{a}::double as x, {b} as y from jg" for a in ("difficulty", "faithfulness", "terminology", "fluency") for b in ("tot", "fre")) + f") {_rho('x', 'dim, metric', 'x', 'y')}",
    "within_system_spearman": f"with {_LENS}, z as ({_rho('tl', 'system', 'human', 'judge').replace('round(case', '(case').replace('end, 9)', 'end)')}) select count(rho) as n_systems, round(avg(rho), 9) as mean_rho from z where rho is not null",
    "partial_spearman": f"with {_LENS}, r as (select {q_rank('human', '')} as a, {q_rank('judge', '')} as b, {q_rank('fre', '')} as c from tl where human is not null and judge is not null and fre is not null), z as (select count(*) as n, {_corr('a', 'b')} as ab, {_corr('a', 'c')} as ac, {_corr('b', 'c')} as bc from r) select n, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 9) as rho from z",
    "level_split_rho": f"with {_LENS}, pm as (select id, lv, round(avg(human), 9) as human, round(avg(judge), 9) as judge from tl group by all), a as ({_rho('tl', 'lv', 'human', 'judge')}), b as ({_rho('pm', 'lv', 'human', 'judge')}) select 'cell' as unit, lv, n, rho from a union all select 'passage', lv, n, rho from b",
    "order_swap": f"with {_LONG}, am as (select item_id, system, dim, round(avg(score) filter (right(md5('arm:' || rater), 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e')), 9) as a, round(avg(score) filter (right(md5('arm:' || rater), 1) not in ('0', '2', '4', '6', '8', 'a', 'c', 'e')), 9) as b from lg group by all), mx as (select * from am where a is not null and b is not null), x as (select dim, round(avg(a), 9) as mean_a, round(avg(b), 9) as mean_b, round(avg(b) - avg(a), 9) as delta, round(100 * avg((a = b)::int::double), 9) as exact from mx group by dim), y as ({_rho('mx', 'dim', 'a', 'b')}) select * from x join y using (dim)",
    "bh_fdr": f"with {Q_ROWS}, p as (select tag, id, lv, contra as p from h where contra is not null), r as (select *, count(*) over (partition by tag, lv) as n, row_number() over (partition by tag, lv order by p) as r from p), q as (select tag, id, lv, r, greatest(1e-300, p) * n / r as q from r) select tag, id, lv, round(min(q) over (partition by tag, lv order by r desc rows between unbounded preceding and current row), 9) as q from q",
}
