"""Queries: agreement, reliability, calibration, self-consistency and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.operators import reliability as L
from lexloom.operators import tests_stat as S
from lexloom.plans import kit as K
from lexloom.plans import relations as REL
from lexloom.plans.reports import _long
from lexloom.plans.statistics import _LENS, _LONG, _corr, _gaps, q_rank, rnd

ROUNDS, GAP_ROUNDS = 2000, 800
_JDIMS = ("difficulty", "faithfulness", "terminology", "fluency")


def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Linearly weighted kappa over all pairs of raters of a cell."""
    k = L.pooled_kappa(_long(spark, d), ["dim"], ["item_id", "system"], "score", [1.0, 2.0, 3.0, 4.0, 5.0], True)
    return k.select("dim", "n", rnd("kappa"))


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of all pairs of raters of a cell on whether the rewrite is valid."""
    return L.pooled_kappa(REL._sheets(spark, d), [], ["item_id", "system"], "valid", ["N", "Y"], False).select("n", rnd("kappa"))


def exact_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of the cells with three scores or more on which all raters agree."""
    g = _long(spark, d).groupBy("item_id", "system", "dim").agg(F.count("*").alias("k"), F.min("score").alias("a"), F.max("score").alias("b")).where("k >= 3")
    return g.groupBy("dim").agg(F.count("*").alias("n"), rnd(100 * F.avg((F.col("a") == F.col("b")).cast("double")), "percent"))


def icc(spark: SparkSession, d: str) -> DataFrame:
    return L.icc(REL.rater_matrix(spark, d), ["dim"], ["item_id", "system"]).select("dim", "n", rnd("k"), rnd("icc2k"), rnd("icc3k"), rnd(F.sqrt(F.greatest(F.lit(0.0), "icc3k")), "ceiling"))


def leave_one_out_rho(spark: SparkSession, d: str) -> DataFrame:
    return L.leave_one_out(REL.rater_matrix(spark, d), ["dim"]).select("dim", "raters", rnd("rho"))


def spearman_brown(spark: SparkSession, d: str) -> DataFrame:
    i = L.icc(REL.rater_matrix(spark, d), ["dim"], ["item_id", "system"])
    return i.select("dim", *[rnd(c, n) for n, c in L.spearman_brown(F.col("icc3k"), F.col("k")).items()])


def design_effect(spark: SparkSession, d: str) -> DataFrame:
    m = _long(spark, d).where("dim = 'difficulty'").groupBy("item_id", "system").agg(F.avg("score").alias("m"))
    return L.design_effect(m, ["item_id"], "system", "m").select("n_clusters", "m", rnd("icc1"), rnd("deff"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    j = REL._judged(spark, d)
    comp = (F.col("judge.difficulty") + F.col("judge.faithfulness") + F.col("judge.terminology") + F.col("judge.fluency")) / 4
    return j.select("system", "lv", F.col("judge.confidence").alias("confidence"), "tot", *[F.col(f"judge.{x}").alias(x) for x in _JDIMS], comp.alias("composite"), ((comp >= C.JUDGE_GOOD) == (F.col("tot") >= C.AUTO_GOOD)).alias("correct"))


def ece(spark: SparkSession, d: str) -> DataFrame:
    return L.calibration(_verdicts(spark, d), ["system"], "confidence", "correct", C.CONFIDENCE_BINS).select("system", "n", rnd("ece"))


def judge_level_means(spark: SparkSession, d: str) -> DataFrame:
    v = _verdicts(spark, d)
    return v.groupBy("system", "lv").agg(F.count("*").alias("n"), *[rnd(F.avg(x), x) for x in _JDIMS], rnd(F.avg("confidence"), "confidence"), rnd(F.avg("tot"), "auto_tot"))


def _decodes(spark: SparkSession, d: str) -> DataFrame:
    """Raters of a cell as repeated decodes: their composite of four dimensions."""
    s = REL._sheets(spark, d)
    comp = (F.col("difficulty") + F.col("meaning") + F.col("terminology") + F.col("fluency")) / 4
    return s.select("item_id", "system", "rater", *C.DIMS, comp.cast("double").alias("composite"))


def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise agreement of verdicts and mean spread of composites over repeated decodes, by system."""
    v = _decodes(spark, d).where("composite is not null")
    g = v.groupBy("item_id", "system").agg(F.count("*").alias("k"), F.sum((F.col("composite") >= C.JUDGE_GOOD).cast("long")).alias("c"), F.stddev_pop("composite").alias("s")).where("k > 1")
    agree = (F.col("c") * (F.col("c") - 1) + (F.col("k") - F.col("c")) * (F.col("k") - F.col("c") - 1)) / (F.col("k") * (F.col("k") - 1))
    return g.groupBy("system").agg(F.count("*").alias("n"), rnd(F.avg(agree), "agreement"), rnd(F.avg("s"), "spread"))


def decode_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Of the cells with exactly five decodes the share in which all give the same score, by dimension."""
    m = _long(spark, d).groupBy("item_id", "system", "dim").agg(F.count("*").alias("k"), F.count_distinct("score").alias("u")).where("k = 5")
    return m.groupBy("dim").agg(F.count("*").alias("n"), rnd(100 * F.avg((F.col("u") == 1).cast("double")), "percent"))


def first_valid_decode(spark: SparkSession, d: str) -> DataFrame:
    """The first reply of each cell that could be parsed."""
    j = K.table(spark, d, "judged").where("judge is not null").select("id", F.lower(F.trim("lv")).alias("lv"), "system", "judge_id", F.col("judge.difficulty").alias("difficulty"))
    return j.groupBy("id", "lv", "system").agg(F.min("judge_id").alias("judge_id"), F.min_by("difficulty", "judge_id").alias("difficulty"))


def cluster_bootstrap(spark: SparkSession, d: str, rounds: int = ROUNDS) -> DataFrame:
    """Percentile interval of the human-judge rank correlation over resamples of passages, with ranks anew in each."""
    r = L.bootstrap_spearman(REL.three_lens(spark, d), "id", "human", "judge", rounds, C.BOOTSTRAP_SEED)
    return L.interval(r, "rho").select("rounds", rnd("low"), rnd("high"), rnd("above"), rnd("below"))


def icc_bootstrap(spark: SparkSession, d: str, rounds: int = ROUNDS) -> DataFrame:
    """Percentile interval of the average-measures correlation of each dimension over resamples of items."""
    i = L.bootstrap_icc(REL.rater_matrix(spark, d), "dim", ["item_id", "system"], "item_id", rounds, C.BOOTSTRAP_SEED)
    return L.interval(i, "icc3k", ["dim"]).select("dim", "rounds", rnd("low"), rnd("high"), rnd("above"), rnd("below"))


def gap_bootstrap(spark: SparkSession, d: str, rounds: int = GAP_ROUNDS) -> DataFrame:
    """Over resamples of passages, the share with a significant level gap and the median p, by system."""
    p = S.signed_rank_p(L.bootstrap_signed_rank(_gaps(spark, d), "system", "id", "gap", rounds, C.BOOTSTRAP_SEED))
    return p.groupBy("system").agg(F.count("*").alias("rounds"), rnd(F.avg((F.col("p") < 0.05).cast("double")), "significant"), rnd(F.median("p"), "median_p"))


_MX = f"{_LONG}, {REL.Q_MATRIX}"
_CENTRED = f"""{_MX}, rm as (select dim, rater, count(*) as nj, avg(score) as mj from mx group by all),
rs as (select dim, count(*)::double as raters, sum(nj * mj * mj) - sum(nj * mj) * sum(nj * mj) / sum(nj) as ssc from rm group by dim),
ce as (select dim, item_id, system, count(*)::double as n, sum(score - mj) as t, sum((score - mj) * (score - mj)) as q from mx join rm using (dim, rater) group by all)"""
_ICC = f"""{_CENTRED}, sq as (select dim, count(*)::double as m, sum(n) as total, sum(n * n) as nn, sum(t * t / n) as a, sum(t) as t, sum(q) as q from ce group by dim),
ms as (select dim, m, total, nn, raters, (a - t * t / total) / (m - 1) as msr, (q - a) / (total - m - raters + 1) as mse, ssc / (raters - 1) as msc from sq join rs using (dim)),
ii as (select dim, m::bigint as n, (total - nn / total) / (m - 1) as k, (msr - mse) / (msr + (msc - mse) * raters / total) as icc2k, (msr - mse) / msr as icc3k from ms)"""
_TIMES = lambda key, src, rounds: f"dr as (select {key}, 8 * j + i as b, {' + '.join(f'(u >= {t})::int' for t in L.POISSON)} as w from (select {key}, j, i, ('0x' || substr(md5('{C.BOOTSTRAP_SEED}:' || j || ':' || {key}), 4 * i + 1, 4))::int as u from (select distinct {key} from {src}), range({rounds // 8}) t(j), range(8) v(i)))"
_VERDICT = f"{REL.Q_JUDGED}, vd as (select *, (judge.difficulty + judge.faithfulness + judge.terminology + judge.fluency)::double / 4 as composite, judge.confidence as conf from jg), vc as (select *, (composite >= 3.5) = (tot >= 0.8) as correct from vd)"
_UNLIKE = lambda c, n, weighted: " + ".join(f"{j - i if weighted else 1} * {c}{i} * {c}{j}" for i in range(n) for j in range(i + 1, n))
_POOLED = lambda src, by, label, labels, weighted: f"kc as (select {by}item_id, system, {', '.join(f'count(*) filter ({label} = {x})::double as c{i}' for i, x in enumerate(labels))} from {src} where {label} in ({', '.join(map(str, labels))}) group by all), kn as (select *, {' + '.join(f'c{i}' for i in range(len(labels)))} as n from kc), ks as (select {by}sum(n * (n - 1) / 2) as p, sum({_UNLIKE('c', len(labels), weighted)}) as o, {', '.join(f'sum((n - 1) * c{i}) as m{i}' for i in range(len(labels)))} from kn where n > 1 group by all), kr as (select {by}p::bigint as n, round(1 - (o / p) / nullif(2 * ({_UNLIKE('m', len(labels), weighted)}) / (4 * p * p), 0), 9) as kappa from ks)"
_BOOT = f"""{_LENS}, {_TIMES('id', 'tl', ROUNDS)},
ws as (select b, human, judge, sum(w)::double as w from dr join tl using (id) where w > 0 group by all),
wr as (select b, w, sum(w) over (partition by b order by human) - sum(w) over (partition by b, human) / 2 + 0.5 as rx, sum(w) over (partition by b order by judge) - sum(w) over (partition by b, judge) / 2 + 0.5 as ry from ws),
wm as (select b, w, rx - sum(w * rx) over (partition by b) / sum(w) over (partition by b) as rx, ry - sum(w * ry) over (partition by b) / sum(w) over (partition by b) as ry from wr),
bb as (select b, case when sum(w) >= 5 then sum(w * rx * ry) / nullif(sqrt(sum(w * rx * rx) * sum(w * ry * ry)), 0) end as rho from wm group by b)"""
_INTERVAL = lambda v: f"count({v}) as rounds, round(quantile_cont({v}, 0.025), 9) as low, round(quantile_cont({v}, 0.975), 9) as high, round(avg(({v} > 0)::int::double), 9) as above, round(avg(({v} < 0)::int::double), 9) as below"
_ICC_BOOT = f"""{_CENTRED}, st as (select dim, item_id, count(*)::double as m, sum(n) as n, sum(t * t / n) as a, sum(t) as t, sum(q) as q from ce group by all), {_TIMES('item_id', 'st', ROUNDS)},
sm as (select dim, b, sum(w * m) as m, sum(w * n) as n, sum(w * a) as a, sum(w * t) as t, sum(w * q) as q from dr join st using (item_id) where w > 0 group by all),
sv as (select dim, b, (a - t * t / n) / nullif(m - 1, 0) as msr, (q - a) / nullif(n - m - raters + 1, 0) as mse from sm join rs using (dim)), si as (select dim, (msr - mse) / nullif(msr, 0) as i from sv)"""

QUERIES = {f.__name__: f for f in (
    weighted_kappa, cohen_kappa, exact_agreement, icc, leave_one_out_rho, spearman_brown, design_effect, ece, judge_level_means, self_consistency, decode_agreement, first_valid_decode,
    cluster_bootstrap, icc_bootstrap, gap_bootstrap,
)}

SQL = {
    "weighted_kappa": f"with {_LONG}, {_POOLED('lg', 'dim, ', 'score', [1, 2, 3, 4, 5], True)} select * from kr",
    "cohen_kappa": f"with {REL.Q_SHEETS}, {_POOLED('u', '', 'valid', ["'N'", "'Y'"], False)} select * from kr",
    "exact_agreement": f"with {_LONG}, g as (select dim, min(score) as a, max(score) as b from lg group by dim, item_id, system having count(*) >= 3) select dim, count(*) as n, round(100 * avg((a = b)::int::double), 9) as percent from g group by dim",
    "icc": f"with {_ICC} select dim, n, round(k, 9) as k, round(icc2k, 9) as icc2k, round(icc3k, 9) as icc3k, round(sqrt(greatest(0, icc3k)), 9) as ceiling from ii",
    "leave_one_out_rho": f"with {_MX}, k as (select dim, rater, {q_rank('score', 'dim, rater')} as rx, {q_rank('others', 'dim, rater')} as ry from mx), c as (select dim, rater, case when count(*) >= 5 then {_corr('rx', 'ry')} end as rho from k group by all) select dim, count(*) as raters, round(avg(rho), 9) as rho from c where rho is not null group by dim",
    "spearman_brown": f"with {_ICC}, s as (select dim, icc3k / (k - (k - 1) * icc3k) as r from ii), t as (select *, 2 * r / (1 + r) as rel2, 3 * r / (1 + 2 * r) as rel3 from s) select dim, round(r, 9) as single, round(rel2, 9) as rel2, round(rel3, 9) as rel3, round(sqrt(rel3 / nullif(rel2, 0)), 9) as factor from t",
    "design_effect": f"with {_LONG}, m as (select item_id, system, avg(score) as v from lg where dim = 'difficulty' group by all), k as (select *, row_number() over (partition by item_id order by system) as k, count(*) over (partition by item_id) as c from m), l as (select *, min(c) over () as m from k), g as (select item_id, avg(v) as g, sum(v) as s, sum(v * v) as q, max(m)::double as m from l where k <= m group by 1), a as (select count(*) as n_clusters, max(m) as m, max(m) * var_pop(g) as msb, avg((q - s * s / m) / (m - 1)) as msw from g), i as (select *, (msb - msw) / (msb + (m - 1) * msw) as icc1 from a) select n_clusters, m::bigint as m, round(icc1, 9) as icc1, round(1 + (m - 1) * icc1, 9) as deff from i",
    "ece": f"with {_VERDICT}, b as (select system, ceil(round(conf * 5, 9)) as bin, conf, correct::int::double as k from vc where conf is not null and correct is not null), g as (select system, case when bin between 1 and 5 then bin end as bin, count(*) as m, avg(conf) as c, avg(k) as a from b group by all) select system, sum(m)::bigint as n, round(sum(case when bin is not null then m * abs(a - c) else 0 end) / sum(m), 9) as ece from g group by system",
    "judge_level_means": f"with {_VERDICT} select system, lv, count(*) as n, " + ", ".join(f"round(avg(judge.{x}), 9) as {x}" for x in _JDIMS) + ", round(avg(conf), 9) as confidence, round(avg(tot), 9) as auto_tot from vc group by all",
    "self_consistency": f"with {REL.Q_SHEETS}, v as (select item_id, system, (difficulty + meaning + terminology + fluency)::double / 4 as x from u where difficulty + meaning + terminology + fluency is not null), g as (select system, count(*) as k, count(*) filter (x >= 3.5) as c, stddev_pop(x) as s from v group by item_id, system having count(*) > 1) select system, count(*) as n, round(avg((c * (c - 1) + (k - c) * (k - c - 1))::double / (k * (k - 1))), 9) as agreement, round(avg(s), 9) as spread from g group by system",
    "decode_agreement": f"with {_LONG}, m as (select dim, count(distinct score) as u from lg group by item_id, system, dim having count(*) = 5) select dim, count(*) as n, round(100 * avg((u = 1)::int::double), 9) as percent from m group by dim",
    "first_valid_decode": "select id, lower(trim(lv)) as lv, system, min(judge_id) as judge_id, min_by(judge.difficulty, judge_id) as difficulty from judged where judge is not null group by all",
    "cluster_bootstrap": f"with {_BOOT} select {_INTERVAL('rho')} from bb where rho is not null",
    "icc_bootstrap": f"with {_ICC_BOOT} select dim, {_INTERVAL('i')} from si where i is not null group by dim",
}
