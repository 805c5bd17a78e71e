"""Hypothesis tests and effect sizes as grouped aggregates; p-values are finished on the small results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import dist
from lexloom.operators.ranks import average_rank, correlation

_cube = lambda c: c * c * c - c


def _eq(a: DataFrame, b: DataFrame, cols: list[str]):
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _rank_sums(df: DataFrame, by: list[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(by, group, n_g, r_g) and (by, n, ties) of the ranks over all groups together."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*by, group, F.col(value).cast("double").alias("_v"))
    ranked = average_rank(rows, by, "_v", "_r")
    groups = ranked.groupBy(*by, group).agg(F.count("*").alias("n_g"), F.sum("_r").alias("r_g"))
    t = F.col("count").cast("double")
    ties = rows.groupBy(*by, "_v").count().groupBy(*by).agg(F.sum("count").cast("double").alias("n"), F.sum(_cube(t)).alias("ties"))
    return groups, ties


def kruskal_wallis(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, n, k, h, epsilon2): H with the correction for ties, and H / (n - 1); families of one group are left out."""
    groups, ties = _rank_sums(df, by, group, value)
    g = groups.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col("r_g") * F.col("r_g") / F.col("n_g")).alias("s"))
    j = g.join(ties, by) if by else g.crossJoin(ties)
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0)))
    return j.where("k > 1 and n > 1").withColumn("h", h).select(*by, n.cast("long").alias("n"), "k", "h", (F.col("h") / (n - 1)).alias("epsilon2"))


def anova(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, n, k, f, eta2): one-way analysis of variance; eta2 is 0 where nothing varies."""
    v = F.col(value).cast("double")
    g = df.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n_g"), F.avg(v).alias("m_g"), F.var_pop(v).alias("v_g"))
    t = g.groupBy(*by).agg(F.sum("n_g").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n_g") * F.col("m_g")) / F.sum("n_g")).alias("m"), F.sum(F.col("n_g") * F.col("v_g")).alias("ssw"))
    same = g.join(t.select(*by, "m"), by) if by else g.crossJoin(t.select("m"))
    b = same.groupBy(*by).agg(F.sum(F.col("n_g") * (F.col("m_g") - F.col("m")) * (F.col("m_g") - F.col("m"))).alias("ssb"))
    j = t.join(b, by) if by else t.crossJoin(b)
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.nullif(F.try_divide(F.col("ssw"), F.col("n") - F.col("k")), F.lit(0.0)))
    return j.where("k > 1").select(*by, "n", "k", f.alias("f"), F.coalesce(F.try_divide("ssb", F.col("ssb") + F.col("ssw")), F.lit(0.0)).alias("eta2"))


def dunn(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, a, b, z): mean-rank differences of each pair of groups over their standard error, without tie correction."""
    groups, ties = _rank_sums(df, by, group, value)
    m = groups.select(*by, F.col(group).alias("a"), F.col("n_g").alias("na"), (F.col("r_g") / F.col("n_g")).alias("ra"))
    o = m.select(*by, F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"))
    j = (m.join(o, by) if by else m.crossJoin(o)).where("a < b")
    j = j.join(ties.select(*by, "n"), by) if by else j.crossJoin(ties.select("n"))
    se = F.sqrt(F.col("n") * (F.col("n") + 1) / 12 * (1 / F.col("na") + 1 / F.col("nb")))
    return j.select(*by, "a", "b", F.coalesce(F.try_divide(F.col("ra") - F.col("rb"), se), F.lit(0.0)).alias("z"))


def signed_rank(df: DataFrame, by: list[str], diff: str) -> DataFrame:
    """(by, n_pairs, n_zero, n, w_plus, w_minus, w, ties): Wilcoxon's signed ranks; zeros are dropped, w is the lesser sum."""
    d = df.where(F.col(diff).isNotNull()).select(*by, F.col(diff).cast("double").alias("_d"), F.abs(F.col(diff).cast("double")).alias("_a"))
    live = d.where("_d <> 0")
    ranked = average_rank(live, by, "_a", "_r")
    s = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    ties = live.groupBy(*by, "_a").count().groupBy(*by).agg(F.sum(_cube(F.col("count").cast("double"))).alias("ties"))
    total = d.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.sum((F.col("_d") == 0).cast("long")).alias("n_zero"))
    j = total.join(s, _eq(total, s, by), "left").select(*[total[b] for b in by], "n_pairs", "n_zero", "n", "w_plus", "w_minus")
    out = j.join(ties, _eq(j, ties, by), "left")
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(*[j[b] for b in by], "n_pairs", "n_zero", F.coalesce("n", F.lit(0)).alias("n"), z("w_plus"), z("w_minus"), F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)).alias("w"), z("ties"))


def signed_rank_p(df: DataFrame, greater: bool = False) -> DataFrame:
    """Adds `p` and `effect` (|z| over the root of the pairs) to the rows of `signed_rank`."""

    def finish(batches):
        for b in batches:
            p = [dist.signed_rank_p(r.w_plus, r.w_minus, int(r.n), r.ties, r.ties == 0 and r.n_zero == 0, greater) for r in b.itertuples()]
            p = [max(x, 1e-300) for x in p]
            e = [abs(dist.normal_ppf(x / 2)) / math.sqrt(n) if n and w else 0.0 for x, n, w in zip(p, b["n_pairs"], b["n"])]
            yield b.assign(p=p, effect=e)

    return df.mapInPandas(finish, T.StructType(df.schema.fields + [T.StructField("p", T.DoubleType()), T.StructField("effect", T.DoubleType())]))


def friedman(df: DataFrame, block: str, group: str, value: str, k: int) -> DataFrame:
    """One row (n, k, chi2): over the blocks that have all `k` groups, with the correction for ties within blocks."""
    v = df.where(F.col(value).isNotNull()).select(block, group, F.col(value).cast("double").alias("_v"))
    full = v.groupBy(block).agg(F.count_distinct(group).alias("c")).where(F.col("c") == k).select(block)
    v = v.join(full.hint("merge"), block, "left_semi")
    w = Window.partitionBy(block)
    r = v.withColumn("_t", F.count("*").over(Window.partitionBy(block, "_v"))).withColumn("_r", F.rank().over(w.orderBy("_v")) + (F.col("_t") - 1) / 2)
    sums = r.groupBy(group).agg(F.sum("_r").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").cast("double").alias("n"))
    ties = v.groupBy(block, "_v").count().agg(F.coalesce(F.sum(_cube(F.col("count").cast("double"))), F.lit(0.0)).alias("t"))
    n = F.col("n")
    chi = F.try_divide(12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1), F.nullif(1 - F.col("t") / (n * k * (k * k - 1)), F.lit(0.0)))
    return sums.crossJoin(ties).select(n.cast("long").alias("n"), F.lit(k).alias("k"), chi.alias("chi2"))


def chi2(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """One row (dof, chi2) for a table of (fractional) counts, one row of it for each row of `df`; Yates' correction at one degree of freedom."""
    long = df.select(row, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("o")) for c in columns])).alias("x")).select(row, "x.c", "x.o")
    long = long.where("o is not null")
    rows, cols = long.groupBy(row).agg(F.sum("o").alias("rs")), long.groupBy("c").agg(F.sum("o").alias("cs"))
    total = long.agg(F.sum("o").alias("n"), F.count_distinct(row).alias("nr"), F.count_distinct("c").alias("nc"))
    j = long.join(rows, row).join(cols, "c").crossJoin(F.broadcast(total)).withColumn("e", F.col("rs") * F.col("cs") / F.col("n"))
    dev = F.abs(F.col("o") - F.col("e"))
    dev = F.when((F.col("nr") - 1) * (F.col("nc") - 1) == 1, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
    out = j.agg(F.max((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"), F.sum(F.try_divide(dev * dev, F.col("e"))).alias("chi2"))
    return out.select(F.col("dof").cast("int").alias("dof"), "chi2")


def partial_spearman(df: DataFrame, x: str, y: str, controls: list[str]) -> tuple[int, float | None, float | None]:
    """(n, rho, p) of the rank correlation of x and y given the controls, from the inverse of the ranks' correlation matrix.

    The matrix of the sums is all that reaches the driver. None where it is singular or below six rows.
    """
    cols = [x, y, *controls]
    rows = df.where(" and ".join(f"{c} is not null" for c in cols)).select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        rows = average_rank(rows, [], f"v{i}", f"r{i}")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i)]
    got = rows.agg(F.count("*"), *[correlation(f"r{i}", f"r{j}") for i, j in pairs]).first()
    n, m = got[0], np.eye(len(cols))
    if n < 6 or any(v is None for v in got[1:]):
        return n, None, None
    for (i, j), v in zip(pairs, got[1:]):
        m[i, j] = m[j, i] = v
    try:
        inv = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return n, None, None
    rho = float(-inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1]))
    return n, rho, dist.correlation_p(rho, n, len(controls))


def with_p(df: DataFrame, kind: str, stat: str, *dofs: str) -> DataFrame:
    """Adds `p` to a small result. kind: normal (two-sided), chi2, f or correlation."""

    def finish(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                v, k = r[stat], [r[c] for c in dofs]
                if v is None or pd.isna(v):
                    out.append(None)
                elif kind == "normal":
                    out.append(2 * dist.normal_sf(abs(v)))
                elif kind == "chi2":
                    out.append(dist.chi2_sf(v, k[0]))
                elif kind == "f":
                    out.append(dist.f_sf(v, k[0], k[1]))
                else:
                    out.append(dist.correlation_p(v, int(k[0])))
            yield b.assign(p=pd.Series(out, dtype="float64", index=b.index))

    return df.mapInPandas(finish, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))
