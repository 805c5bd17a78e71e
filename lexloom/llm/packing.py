"""Filling fixed-capacity sequences with whole documents (problem 8).

Bound-certified repacking. Documents are spread over partitions of bounded size, each is packed by
best-fit decreasing, and dual feasible functions give a lower bound on the containers that its documents
need. A partition that meets its bound is certified; one with a gap gives its emptiest containers up, and
the documents of all such containers are exchanged and packed again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.components import cut
from lexloom.llm.tokenizer import token_counts

CAPACITY = 2048
PART_TOKENS = 4_000_000  # tokens of a partition, about
PART_ROWS = 50_000  # pieces of a partition, about
ROUNDS = 4


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that the sizes need at least: the best of the volume bound and dual feasible functions.

    The functions are the classical pair: sizes above capacity - e count whole and sizes below e count
    nothing; and sizes rounded to steps of 1/(k+1), where a size of a whole number of steps keeps its share.
    """
    u, n = np.unique(sizes[sizes > 0], return_counts=True)
    return histogram_bound(u.astype(np.int64), n.astype(np.int64), capacity)


def histogram_bound(u: np.ndarray, n: np.ndarray, capacity: int = CAPACITY) -> int:
    """`lower_bound` of n[i] pieces of each size u[i] > 0."""
    if not len(u):
        return 0
    best = -(-int((u * n).sum()) // capacity)
    for e in np.unique(u[u <= capacity // 2]):
        total = int((n[u > capacity - e]).sum()) * capacity + int((u * n)[(u >= e) & (u <= capacity - e)].sum())
        best = max(best, -(-total // capacity))
    for k in range(1, 31):
        whole = (u * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity), to stay with integers
        value = np.where(whole, u * k, (u * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container of each size (all at most `capacity`); ties in size keep their order."""
    out = np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a container with r places free
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            c = free[r].pop()
            if not free[r]:
                rooms &= ~(1 << r)
        else:
            r, c, n = capacity, n, n + 1
        out[i] = c
        free[r - size].append(c)
        rooms |= 1 << (r - size)
    return out


_PACKED = "doc_id long, piece int, n_tokens int, part long, bin long, keep boolean"


def _pack(pieces: DataFrame, last: bool, capacity: int) -> DataFrame:
    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = df["n_tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        used = bins.max() + 1
        gap = int(used) - max(lower_bound(sizes, capacity), 1)
        keep = np.ones(len(df), bool)
        if gap > 0 and not last:
            fill = np.bincount(bins, weights=sizes, minlength=used)
            poor = np.argsort(fill, kind="stable")[: 4 * gap + 4]
            keep = ~np.isin(bins, poor[fill[poor] < capacity])
        return df.assign(bin=bins, keep=keep)[["doc_id", "piece", "n_tokens", "part", "bin", "keep"]]

    return pieces.groupBy("part").applyInPandas(pack, _PACKED)


def pack(counts: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of documents (doc_id, n_tokens).

    A document of at most `capacity` tokens is one piece 0; a longer one fills containers of its own with its
    first pieces and gives the rest, if any, as a last piece to be packed. A document without tokens (or of null
    count) is a piece of 0 tokens in some container. Rows of null doc_id are left out; repeated rows of one
    doc_id and count are one document. An empty table gives no rows.
    """
    docs = counts.where("doc_id is not null").select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n")).distinct()
    docs = cut(docs)
    whole = docs.where(F.col("n") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("int") - 1)).alias("piece"), F.lit(capacity).alias("n_tokens"))
    whole = whole.select("doc_id", "piece", "n_tokens", F.concat_ws("/", F.lit("w"), "doc_id", "piece").alias("container"))
    rest = docs.where((F.col("n") < capacity) | (F.col("n") % capacity > 0)).select("doc_id", (F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).cast("int").alias("n_tokens"))
    done = whole
    for r in range(rounds):
        total = rest.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).first()
        if not total.c:
            break
        parts = max(1, -(-int(total.t or 0) // part_tokens), -(-int(total.c) // PART_ROWS))
        last = r == rounds - 1 or (r > 0 and parts == 1)
        packed = cut(_pack(rest.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(parts))), last, capacity))
        done = done.unionByName(packed.where("keep").select("doc_id", "piece", "n_tokens", F.concat_ws("/", F.lit(str(r)), "part", "bin").alias("container")))
        if last:
            break
        rest = packed.where("not keep").select("doc_id", "piece", "n_tokens")
    return done


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_counts(spark, sf_dir))


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the lower bound for all documents together, tokens and mean fill."""
    packed = cut(pack(_counts(spark, sf_dir)))
    hist = packed.where("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most CAPACITY rows
    bound = histogram_bound(np.array([r.n_tokens for r in hist], np.int64), np.array([r["count"] for r in hist], np.int64))
    total = packed.agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return total.select("n_containers", F.lit(bound).cast("long").alias("lower_bound"), "n_tokens", F.round(F.try_divide(F.col("n_tokens"), F.col("n_containers") * CAPACITY), 6).alias("fill"))


QUERIES = {"p8_packed": p8_packed, "p8_certificate": p8_certificate}
