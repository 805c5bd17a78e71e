"""Partitions, samples, splits and top-k that stay distributed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many rows a plain window over one partition ranks them; beyond, rows are ranked by range.
PLAIN_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints_{uuid.uuid4().hex[:8]}"


def numbered(df: DataFrame, order: list, name: str = "rank", plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Adds the 1-based position in the order of `order` over all rows.

    A small table takes one window. A larger one is parted by range, sorted within the parts, and each part's
    positions are shifted by the sizes of those before it, so no task holds more than its range.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if df.count() <= plain_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*cols)).cast("long"))
    parts = cut(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", before.alias("_before"))  # one row a partition
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)))
    return inside.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def bucket(key: Column, salt: str = "legal:", buckets: int = 100) -> Column:
    """The 128-bit MD5 of salt and key modulo `buckets`, folded from four 32-bit chunks."""
    h = F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary"))
    out = F.lit(0).cast("long")
    for i in range(4):
        out = (out * ((1 << 32) % buckets) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")) % buckets
    return out


def hash_split(df: DataFrame, key: str, salt: str = "legal:") -> DataFrame:
    """Adds `bucket` (0..99) and `part`: train below 80, val below 90, test above; null keys get null."""
    b = bucket(F.col(key), salt)
    df = df.withColumn("bucket", b)
    return df.withColumn("part", F.when(F.col("bucket") < 80, "train").when(F.col("bucket") < 90, "val").when(F.col("bucket").isNotNull(), "test"))


def group_split(df: DataFrame, groups: list[str], seed: int = 42) -> DataFrame:
    """Adds `part`: whole groups in hash order, 80 % of them train, 10 % val, the rest test. Nulls group together."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(g), F.lit("")) for g in groups])
    keyed = df.withColumn("_g", F.md5(key.cast("binary")))
    ranked = numbered(keyed.select("_g").distinct(), ["_g"], "_r")
    n = ranked.count()
    part = F.when(F.col("_r") <= int(0.8 * n), "train").when(F.col("_r") <= int(0.8 * n) + int(0.1 * n), "val").otherwise("test")
    return keyed.join(ranked.select("_g", part.alias("part")), "_g").drop("_g")


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, int(n * fraction)) rows of a table with unique keys, the least by MD5 of seed and key.

    Counts by the first four hex digits find the digit group that holds the last row wanted; only that
    group is ordered.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    counts = hashed.groupBy(F.substring("_h", 1, 4).alias("p")).count().orderBy("p").collect()  # at most 65,536 rows
    want = max(1, int(sum(r["count"] for r in counts) * fraction))
    edge, left = None, want
    for r in counts:
        edge = r.p
        if left <= r["count"]:
            break
        left -= r["count"]
    if edge is None:
        return hashed.drop("_h")
    sure = hashed.where(F.substring("_h", 1, 4) < edge)
    rest = hashed.where(F.substring("_h", 1, 4) == edge).orderBy("_h", key).limit(left)
    return sure.unionByName(rest).drop("_h")


def n_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows of a table with unique keys, the least by MD5 of seed and key; each task sends at most `n` rows."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.where(F.col(key).isNotNull()).orderBy(h, key).limit(n)


def capped(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group (the operator's purpose is the cap)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def complete_keys(df: DataFrame, key: str, level: str, wanted: int) -> DataFrame:
    """Keys that have all `wanted` levels."""
    return df.groupBy(key).agg(F.count_distinct(level).alias("_n")).where(F.col("_n") == wanted).select(key)


def preferred(variants: DataFrame, group: str, priority: str) -> DataFrame:
    """All rows of the variant of least priority number of each group."""
    best = variants.groupBy(group).agg(F.min(priority).alias(priority))
    return variants.join(best, [group, priority])


def best_attempts(df: DataFrame, keys: list[str], attempt: str, score: str, passed: str, limit: int) -> DataFrame:
    """Of each key the first attempt of greatest score, among the attempts up to the first pass or the limit."""
    first = F.min(F.when(F.col(passed), F.col(attempt))).over(Window.partitionBy(*keys))
    tried = df.withColumn("_first", first).where((F.col(attempt) <= limit) & (F.col("_first").isNull() | (F.col(attempt) <= F.col("_first"))))
    rest = [c for c in tried.columns if c not in keys and c != "_first"]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col(attempt))).alias("_b")
    return tried.groupBy(*keys).agg(best, F.count("*").alias("tried")).select(*keys, "_b.*", "tried")
