"""Reading level of texts (problem 2).

A familiar-word formula: the share of words outside a list of words of high document frequency in the
corpus, and the average sentence length, weighed by a discriminant that is fitted to the levels asked for.
Each language has a list of its own, as a word of a small language stands in few documents of all. The lists
and the fit are counted over all rows.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.llm import responses
from lexloom.llm.components import cut

LEVELS = ("beginner", "intermediate", "advanced")
FAMILIAR_DF = 0.10  # share of a language's documents that must hold a familiar word; so a list has at most mean-distinct-words / FAMILIAR_DF words
LIST_BOUND = 2_000_000  # words (16 MB) that the lists may have, as they travel with the tasks; more are an error, never cut
MIN_WORDS = 25  # words of a case of `p2_found`, as the problem states; levels are given to shorter texts, too
CHUNK = 1 << 17
NEVER = -1e9  # score of a level that no row asks for
LONGEST = 45.0  # average sentence lengths beyond say that stops are missing, not that sentences are longer


def _languages() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent short words, and the languages of each as bits."""
    if not _known:
        lists = [responses.ENGLISH, *responses.OTHER_LANGUAGES]
        every = sorted({w for x in lists for w in x})
        h = responses._hash_words(every)
        bits = np.array([sum(1 << i for i, x in enumerate(lists) if w in x) for w in every])
        o = np.argsort(h)
        _known.extend((h[o], bits[o], len(lists)))
    return _known[0], _known[1]


_known: list = []


def language(low: np.ndarray, s: np.ndarray, h: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
    """The language of each text by its frequent short words, or its script where that is not Latin; a number, 0 for English and in doubt."""
    keys, bits = _languages()
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[i] == h)
    score = np.zeros((_known[2], rows))
    for k in range(_known[2]):
        score[k] = np.bincount(own[hit], weights=(bits[i[hit]] >> k) & 1, minlength=rows)
    out = score.argmax(0)
    far = np.flatnonzero(low[s] > 0x24F)
    if len(far):
        most = np.bincount(own[far], minlength=rows) * 2 > np.bincount(own, minlength=rows)
        script = np.zeros(rows, np.int64)
        script[own[far]] = np.searchsorted([0x400, 0x530, 0x600, 0x700, 0x2E80], low[s[far]], side="right")
        out = np.where(most, _known[2] + script, out)
    return out


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, starts, ends, hashes with their language, first words, row of each word, language of each text)."""
    low, s, e, h, first = K.words(col)
    own = np.repeat(np.arange(len(col)), np.diff(first))
    lang = language(low, s, h, own, len(col))
    return low, s, e, h ^ K.mix(lang[own].astype(np.uint64) + np.uint64(9)), first, own, lang


def familiar_words(documents: DataFrame, share: float = FAMILIAR_DF) -> DataFrame:
    """(hash of word and language `h`, `df`) of the words in at least `share` of the texts of a language that have words, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            keys, of, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(64, np.int64)
            for a, b in K.chunks(col, CHUNK):
                low, s, e, h, first, own, lang = _texts(col.slice(a, b - a))
                word = ~((low[s] >= 48) & (low[s] <= 57))
                pair = np.unique(h[word] ^ K.mix(own[word].astype(np.uint64) + np.uint64(1)), return_index=True)[1]
                keys.append(h[word][pair])
                of.append(lang[own[word][pair]])
                n += np.bincount(lang[np.diff(first) > 0], minlength=64)
            u, at, df = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            # h = 0 carries the number of texts of a language
            many = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(u.view(np.int64), np.zeros(len(many), np.int64))), pa.array(np.append(np.concatenate(of)[at], many)), pa.array(np.append(df, n[many]))], ["h", "lang", "df"])

    counts = cut(documents.select("text").where("text is not null").mapInArrow(count, "h long, lang long, df long").groupBy("h", "lang").agg(F.sum("df").alias("df")))
    total = counts.where("h = 0").select("lang", F.col("df").alias("n"))
    return counts.where("h <> 0").join(F.broadcast(total), "lang").where(F.col("df") >= F.lit(share) * F.col("n")).select("h", "df")  # one row a language


@dataclass
class Formula:
    """Linear discriminants over (share of unfamiliar words, log of the average sentence length)."""

    words: np.ndarray
    weight: np.ndarray  # 3 levels x (share, log length, 1)

    def level(self, share: np.ndarray, length: np.ndarray) -> np.ndarray:
        x = np.stack([share, np.log(np.clip(length, 1, LONGEST)), np.ones(len(share))], 1)
        return (x @ self.weight.T).argmax(1)


def _word_list(documents: DataFrame) -> np.ndarray:
    top = familiar_words(documents).select("h").limit(LIST_BOUND + 1).toPandas()["h"].to_numpy(np.int64)
    if len(top) > LIST_BOUND:
        raise ValueError(f"more than {LIST_BOUND} familiar words: raise FAMILIAR_DF")
    return np.sort(top.view(np.uint64))


def _vowels() -> np.ndarray:
    if not _vowel:
        t = np.zeros(1 << 16, bool)
        for c in range(1 << 16):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                t[c] = unicodedata.normalize("NFKD", chr(c))[0] in "aeiouyæœøıаеиоуыэюяієαεηιουω"
        _vowel.append(t)
    return _vowel[0]


_vowel: list[np.ndarray] = []


def measures(col: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, share of unfamiliar words, words a sentence, syllables a word) of each text.

    A sentence ends at a stop before white space, at an empty line or at a wide full stop. Numbers are familiar.
    """
    n, share, length, syll = [], [], [], []
    for a, b in K.chunks(col, CHUNK):
        part = col.slice(a, b - a)
        low, s, e, h, first, own, _ = _texts(part)
        cps, starts = K.code_points(part)
        rows = b - a
        strange = ~responses._in(h, words) & ~((low[s] >= 48) & (low[s] <= 57)) if len(h) else np.zeros(0, bool)
        size = np.diff(first)
        n.append(size)
        share.append(np.bincount(own, weights=strange, minlength=rows) / np.maximum(size, 1))
        m = len(cps)
        ends = np.zeros(rows)
        if m:
            blank = np.append((cps[1:] == 32) | ((cps[1:] >= 9) & (cps[1:] <= 13)) | (cps[1:] == 34) | (cps[1:] == 0x201D) | (cps[1:] == 41), True)
            edge = np.zeros(m + 1, bool)
            edge[starts[1:]] = True
            stop = (np.isin(cps, [46, 33, 63]) & (blank | edge[1:])) | np.isin(cps, [0x3002, 0x2026]) | ((cps == 10) & np.append(cps[1:] == 10, False))
            # stops without a word between them end one sentence
            at = np.flatnonzero(stop)
            before = np.searchsorted(s, at)
            row = K.owner(at, starts)
            new = np.append(True, (before[1:] != before[:-1])) & (before > first[row]) if len(at) else np.zeros(0, bool)
            ends = np.bincount(row[new], minlength=rows).astype(float)
            lastword = np.zeros(rows, np.int64)
            lastword[:] = -1
            lastword[row[new]] = before[new]
            ends += (size > 0) & (lastword < first[1:])
        length.append(size / np.maximum(ends, 1))
        vowel = _vowels()[low]
        start = vowel.copy()
        if len(low):
            start[1:] &= ~vowel[:-1]
            start[s[vowel[s]]] = True
        cum = np.concatenate([[0], np.cumsum(start)])
        v = np.maximum(cum[e] - cum[s] - ((low[e - 1] == 101) if len(e) else 0), 1)
        v = np.where(e - s <= 3, 1, v)
        syll.append(np.bincount(own, weights=v, minlength=rows) / np.maximum(size, 1))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0)
    return cat(n), cat(share), cat(length), cat(syll)


_MEASURED = "key long, n_words long, unfamiliar double, sentence_words double, syllables double"


def _measured(df: DataFrame, key: str, text: str, words: np.ndarray, extra: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, share, length, syll = measures(K.as_array(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(length, pa.float64()), pa.array(syll, pa.float64()), *[batch.column(c) for c in extra]], ["key", "n_words", "unfamiliar", "sentence_words", "syllables", *extra])

    more = "".join(f", {c} string" for c in extra)
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in extra]).mapInArrow(run, _MEASURED + more)


def fit(scored: DataFrame, words: np.ndarray) -> Formula:
    """Discriminants from group sums over all rows that have words and a level, each row weighted by its words.

    The sums are trimmed once: a first fit's clear misfits (rows two levels off) are left out of the second,
    so that rewrites which miss their level do not shift the levels. A level that no row asks for is never read;
    without any level there is none to read.
    """
    rows = scored.select("rew", F.lower(F.trim("lv")).alias("lv"), F.lit(0).alias("k")).where(F.col("lv").isin(*LEVELS))
    m = cut(_measured(rows, "k", "rew", words, ("lv",)).where("n_words > 0").select("lv", F.col("n_words").cast("double").alias("w"), "unfamiliar", F.log(F.least(F.greatest("sentence_words", F.lit(1.0)), F.lit(LONGEST))).alias("len")))
    weight = None
    for _ in range(2):
        kept = m
        if weight is not None:
            scores = [F.col("unfamiliar") * float(w[0]) + F.col("len") * float(w[1]) + float(w[2]) for w in weight]
            top = F.greatest(*scores)
            level = F.when(scores[0] == top, 0).when(scores[1] == top, 1).otherwise(2)
            asked = F.when(F.col("lv") == LEVELS[0], 0).when(F.col("lv") == LEVELS[1], 1).otherwise(2)
            kept = m.where(F.abs(level - asked) < 2)
        w, u, x = F.col("w"), F.col("unfamiliar"), F.col("len")
        got = {r.lv: r for r in kept.groupBy("lv").agg(F.sum(w).alias("w"), F.sum(w * u).alias("u"), F.sum(w * x).alias("l"), F.sum(w * u * u).alias("uu"), F.sum(w * x * x).alias("ll"), F.sum(w * u * x).alias("ul")).collect()}
        mean = {lv: np.array([r.u, r.l]) / r.w for lv, r in got.items()}
        cov = sum((np.array([[r.uu, r.ul], [r.ul, r.ll]]) - r.w * np.outer(mean[lv], mean[lv]) for lv, r in got.items()), np.zeros((2, 2))) / max(sum(r.w for r in got.values()), 1) + np.diag([1e-5, 1e-4])
        inv = np.linalg.inv(cov)
        weight = np.array([[*(inv @ mean[lv]), -0.5 * mean[lv] @ inv @ mean[lv]] if lv in mean else [0.0, 0.0, NEVER] for lv in LEVELS])
    return Formula(words, weight)


def off_level(scored: DataFrame, formula: Formula) -> DataFrame:
    """(row_id, lv, reads): rows whose rewrite is English prose of MIN_WORDS words or more and reads two levels away from `lv`.

    Refusals, remarks, foreign rewrites (by the cues that stand in their clauses) and template residue are left
    out, copies and cut-off rewrites are not. A null or unknown `lv` and a null text are no case; repeated rows
    each count.
    """
    blob = pickle.dumps(formula)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(blob)
        for batch in batches:
            rew = K.as_array(batch.column("rew"))
            lv = np.array([LEVELS.index(x) for x in batch.column("lv").to_pylist()])
            n, share, length, _ = measures(rew, f.words)
            reads = f.level(share, length) if len(n) else np.zeros(0, int)
            rows = np.flatnonzero((n >= MIN_WORDS) & (np.abs(reads - lv) == 2))
            if not len(rows):
                continue
            part = rew.take(pa.array(rows))
            keep = np.zeros(len(rows), bool)
            for a, b in K.chunks(part, 1 << 19):
                keep[a:b] = responses.prose(part.slice(a, b - a))
            rows = rows[keep]
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(rows)), pa.array([LEVELS[i] for i in lv[rows]], pa.string()), pa.array([LEVELS[i] for i in reads[rows]], pa.string())], ["row_id", "lv", "reads"])

    rows = scored.where("row_id is not null and rew is not null").select(F.col("row_id").cast("long").alias("row_id"), "rew", F.lower(F.trim("lv")).alias("lv")).where(F.col("lv").isin(*LEVELS))
    return rows.mapInArrow(run, "row_id long, lv string, reads string")


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Formula]:
    scored = spark.read.parquet(f"{sf_dir}/scored.parquet")
    return scored, fit(scored, _word_list(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, formula = _models(spark, sf_dir)
    return off_level(scored, formula).select("row_id")


def _levels(df: DataFrame, key: str, text: str, formula: Formula, extra: tuple[str, ...] = ()) -> DataFrame:
    """Measures, the estimated reading ease and the level of each text; null without words."""
    scores = [F.col("unfamiliar") * float(w[0]) + F.log(F.least(F.greatest("sentence_words", F.lit(1.0)), F.lit(LONGEST))) * float(w[1]) + float(w[2]) for w in formula.weight]
    top = F.greatest(*scores)
    level = F.when((F.col("n_words") == 0) | F.lit(bool((formula.weight[:, 2] <= NEVER).all())), None).when(scores[0] == top, LEVELS[0]).when(scores[1] == top, LEVELS[1]).otherwise(LEVELS[2])
    ease = F.when(F.col("n_words") > 0, 206.835 - 1.015 * F.col("sentence_words") - 84.6 * F.col("syllables"))
    m = _measured(df.where(f"{key} is not null"), key, text, formula.words, extra)
    return m.select(F.col("key").alias(key), "n_words", F.round("unfamiliar", 6).alias("unfamiliar"), F.round("sentence_words", 6).alias("sentence_words"), F.round(ease, 4).alias("ease"), level.alias("reads"), *extra)


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rewrite and document: unfamiliar words, sentence length, reading ease and level."""
    scored, formula = _models(spark, sf_dir)
    rew = _levels(scored, "row_id", "rew", formula).withColumnRenamed("row_id", "rec_id").withColumn("field", F.lit("rew"))
    docs = _levels(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", formula).withColumnRenamed("doc_id", "rec_id").withColumn("field", F.lit("text"))
    return rew.unionByName(docs)


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level mix of each document source (lower case, null kept)."""
    _, formula = _models(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("origin", F.lower(F.trim("source")))
    return _levels(docs, "doc_id", "text", formula, ("origin",)).groupBy(F.col("origin").alias("source"), "reads").agg(F.count("*").alias("n"), F.round(F.avg("ease"), 4).alias("mean_ease"))


QUERIES = {"p2_found": p2_found, "p2_levels": p2_levels, "p2_sources": p2_sources}
