"""Held-out passages inside training documents (problem 4).

Containment search by MinHash over a size-partitioned collection. A leak is a run of `RUN` words that a
document shares with a passage, so the domains are the runs of `RUN` words, each the set of its
`RUN - SHINGLE + 1` shingles of `SHINGLE` words; equal runs have Jaccard similarity 1 and agree on every
MinHash, so a single band finds each of them. Documents are partitioned by length: the longer a
document, the more runs it has that could meet a passage by chance, hence the more hash functions its
band joins. Every candidate is verified by exact containment of a run, word by word.

Passages of at most `BLOCK_WORDS` words together travel with the tasks as an index, and the documents are read
once; more of them are joined with the documents by band key, with the same result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K

RUN = 20
SHINGLE = 5
#: Upper document lengths in words, and the number of MinHash functions a band joins up to there.
PARTITIONS = ((256, 1), (4096, 2), (1 << 62, 3))
BLOCK_WORDS = 2_000_000  # words of the passages up to which their index travels with the tasks

_SALT = (np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _minima(words: np.ndarray, r: int, run: int, k: int) -> np.ndarray:
    """Band key of each run of `run` words: its `r` MinHashes over shingles of `k` words, joined."""
    sh = K.shingle(words, k)
    key = K.sliding_min(sh, run - k + 1)
    for salt in _SALT[1:r]:
        key = K.mix(key ^ (K.sliding_min(K.mix(sh ^ salt), run - k + 1) * np.uint64(0x94D049BB133111EB)))
    return key


class Passages:
    """Band keys and exact runs of passages; bounded by BLOCK_WORDS."""

    def __init__(self, ids: list[str], texts: list[str], run: int, k: int):
        self.ids, self.run, self.k = ids, run, k
        low, s, e, h, first = K.ascii_words(pa.array(texts, pa.large_string()))
        chars = low.tobytes()
        self.words = [[chars[a:b] for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])]
        self.keys: dict[int, np.ndarray] = {}
        grams, of, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (a, b) in enumerate(zip(first, first[1:])):
            if b - a >= run:
                g = K.shingle(h[a:b], run)
                grams.append(g)
                of.append(np.full(len(g), i))
                at.append(np.arange(len(g)))
        grams, of, at = np.concatenate(grams), np.concatenate(of), np.concatenate(at)
        o = np.argsort(grams, kind="stable")
        self.grams, self.of, self.at = grams[o], of[o], at[o]
        for r in {r for _, r in PARTITIONS}:
            found = [np.zeros(0, np.uint64)] + [_minima(h[a:b], r, run, k) for a, b in zip(first, first[1:]) if b - a >= run]
            self.keys[r] = np.unique(np.concatenate(found))

    def search(self, doc_ids: pa.Array, col: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, passage, runs shared, runs of the passage) of each document row and passage that share a run."""
        low, s, e, h, first = K.ascii_words(col)
        run = self.run
        size = np.diff(first)
        owner = np.repeat(np.arange(len(size)), size)
        lower = 0
        for upper, r in PARTITIONS:
            keys = self.keys[r]
            rows = np.flatnonzero((size >= max(run, lower + 1)) & (size <= upper))
            lower = upper
            if not len(rows) or not len(keys):
                continue
            inside = np.zeros(len(size), bool)
            inside[rows] = True
            pick = np.flatnonzero(inside[owner])
            m = _minima(h[pick], r, run, self.k)
            if not len(m):
                continue
            own = owner[pick]
            new = np.flatnonzero(np.append(True, m[1:] != m[:-1]) | np.append(True, own[1 : len(m)] != own[: len(m) - 1]))
            i = np.minimum(np.searchsorted(keys, m[new]), len(keys) - 1)
            for row in np.unique(own[new[keys[i] == m[new]]]):
                yield from self._verify(int(row), low, s, e, h, int(first[row]), int(first[row + 1]))

    def _verify(self, row: int, low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        run = self.run
        g = K.shingle(h[a:b], run)
        left, right = np.searchsorted(self.grams, g), np.searchsorted(self.grams, g, side="right")
        shared: dict[int, set[int]] = {}
        for p in np.flatnonzero(right > left):
            words = None
            for q in range(left[p], right[p]):
                i, at = int(self.of[q]), int(self.at[q])
                if at in shared.get(i, ()):
                    continue
                if words is None:
                    words = [low[x:y].tobytes() for x, y in zip(s[a + p : a + p + run], e[a + p : a + p + run])]
                if self.words[i][at : at + run] == words:
                    shared.setdefault(i, set()).add(at)
        for i, at in shared.items():
            yield row, i, len(at), len(self.words[i]) - run + 1


def contained(documents: DataFrame, passages: DataFrame, run: int = RUN, k: int = SHINGLE) -> DataFrame:
    """(doc_id, id, containment): passages that share at least `run` consecutive words with a document.

    `containment` is the share of the passage's runs that the document holds. Null and empty texts, and
    passages shorter than a run, match nothing; ids of null are left out; repeated rows give one row, with the
    greatest containment where rows of one id differ; other columns are ignored.
    """
    q = passages.where("id is not null and src is not null").select(F.col("id").cast("string").alias("id"), F.col("src").cast("string").alias("src"))
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = q.agg(F.sum(F.length("src") / 6 + 1)).first()[0] or 0
    found = _indexed(docs, q.collect(), run, k) if words <= BLOCK_WORDS else _joined(docs, q, run, k)
    return found.groupBy("doc_id", "id").agg(F.max("containment").alias("containment"))


_FOUND = "doc_id long, id string, containment double"


def _indexed(docs: DataFrame, rows: list, run: int, k: int) -> DataFrame:
    """Matches by an index of the passages that is built once and travels with the tasks."""
    ids = [r.id for r in rows]
    blob = pickle.dumps(Passages(ids, [r.src for r in rows], run, k))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(blob)
        for batch in batches:
            col, key = batch.column("text"), batch.column("doc_id")
            found = []
            for a, b in K.chunks(col, 1 << 17):
                found += [(a + row, i, n / m) for row, i, n, m in index.search(key, col.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([key.take(pa.array([x[0] for x in found])), pa.array([ids[x[1]] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64())], ["doc_id", "id", "containment"])

    return docs.mapInArrow(search, _FOUND)


def _band_keys(col: pa.Array, run: int, k: int, all_parts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash functions joined, key) of each distinct band key of the texts: by the text's own length, or for every partition."""
    _, _, _, h, first = K.ascii_words(col)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for row, (a, b) in enumerate(zip(first, first[1:])):
        if b - a >= run:
            for r in sorted({r for _, r in PARTITIONS} if all_parts else {next(r for upper, r in PARTITIONS if b - a <= upper)}):
                keys = np.unique(_minima(h[a:b], r, run, k))
                out.append((np.full(len(keys), row), np.full(len(keys), r), keys))
    return tuple(np.concatenate(x) for x in zip(*out))


def shared_runs(text: str, passage: str, run: int) -> tuple[int, int]:
    """(runs of the passage that stand in the text, runs of the passage)."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    w, q = words(text), words(passage)
    held = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    return sum(tuple(q[i : i + run]) in held for i in range(len(q) - run + 1)), max(len(q) - run + 1, 0)


def _joined(docs: DataFrame, q: DataFrame, run: int, k: int) -> DataFrame:
    """Matches by a join on the band keys; a key that many documents hold is split by the adaptive join."""

    def keys(all_parts: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in K.chunks(batch.column(1), 1 << 17):
                    row, r, key = _band_keys(batch.column(1).slice(a, b - a), run, k, all_parts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(r), pa.array(key.view(np.int64))], [batch.schema.names[0], "r", "key"])

        return each

    mine = q.select("id", "src").mapInArrow(keys(True), "id string, r long, key long").distinct()
    theirs = docs.mapInArrow(keys(False), "doc_id long, r long, key long")
    pairs = theirs.join(mine, ["r", "key"]).select("doc_id", "id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [shared_runs(t, p, run) for t, p in zip(batch.column("text").to_pylist(), batch.column("src").to_pylist())]
            hit = pa.array([i for i, (n, _) in enumerate(counts) if n], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(hit), batch.column("id").take(hit), pa.array([n / m for n, m in counts if n], pa.float64())], ["doc_id", "id", "containment"])

    both = pairs.join(docs, "doc_id").join(q, "id").select("doc_id", "id", "text", "src")
    return both.mapInArrow(verify, _FOUND)


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/heldout.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", "id")


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out item that leaked: the documents that hold part of it and the greatest containment."""
    return _tables(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n_documents"), F.round(F.max("containment"), 6).alias("max_containment"))


_PAIRS = """
with q as (select distinct id, regexp_extract_all(lower(src), '[a-z0-9]+') as w from heldout where id is not null and src is not null),
     d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where doc_id is not null and text is not null),
     qg as (select distinct id, array_to_string(w[i:i + 19], ' ') as g from (select id, w, unnest(range(1, len(w) - 18)) as i from q where len(w) >= 20)),
     dg as (select doc_id, array_to_string(w[i:i + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20))
"""

QUERIES = {"p4_found": p4_found, "p4_items": p4_items}
SQL = {"p4_found": _PAIRS + "select distinct doc_id, id from dg join qg using (g)"}
