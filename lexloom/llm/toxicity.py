"""Abusive, hateful and sexual content (problem 9).

Non-negative positive-unlabelled learning: a numpy classifier over word n-grams of short windows is
trained from confirmed examples (windows of the documents that a reader marked) and from the unlabelled
windows of all documents, with the class-prior-corrected risk estimator. A marked document is a bag of
windows; its telling ones are those whose n-grams other marked documents hold and clean ones lack, so that
a document that only its own words speak for confirms nothing. Spelling is folded first: accents,
look-alike letters, digits for letters, doubled letters, letters set apart, masked letters and invisible
characters.

One pass over the texts keeps, of each document, the places of the telling n-grams; the risk, its gradient,
the class prior and the scores are sums over those places.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.llm.components import cut
from lexloom.llm.sampling import least_hashed

MARKED = 2000  # documents marked as abusive that the classifier is fitted on, those of least hash of their key; all where there are fewer
CLEAN = 6000  # documents marked as clean that it is fitted on, likewise
WINDOW = 8  # words of a window
SEEN = 3  # labelled documents that must hold a word for it to be a feature of its own
DOUBT = 1.0  # documents' worth of prior belief that a word n-gram tells nothing
TELLING = 0.5  # log odds from which an n-gram of a confirmed window is a feature
TYPICAL = 0.98  # share of the clean documents that have no window as telling as a confirmed one must be
BACK = 0.3  # weight of the step back where the estimated negative risk would fall below zero
STEPS = 30
RATE = 0.4
CHUNK = 1 << 16  # characters that are folded at once; small arrays stay in the processor's cache

STAR, NUMBER, UNKNOWN = 127, 1, 2

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "һ": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "s", "æ": "a", "œ": "o", "đ": "d"}
# Digits and signs that stand for letters within a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}

def _letters() -> np.ndarray:
    """Fold table: letters as code points of their base letter, digits, signs that may stand for letters, 0 for separators, 255 << 8 for what vanishes."""
    t = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Mn", "Me", "Cf"):
            t[c] = 0xFF00
        elif cat[0] == "L":
            low = ch.lower()
            low = LOOKALIKES.get(low, low)
            base = unicodedata.normalize("NFKD", low)[:1].lower()
            base = LOOKALIKES.get(base, base)
            t[c] = ord(base) if base and ord(base) < 0xFF00 else c
        elif cat == "Nd":
            t[c] = 48 + unicodedata.digit(ch)
    for ch in "$@":
        t[ord(ch)] = ord(ch)
    for ch in "*_#":
        t[ord(ch)] = STAR
    return t


_cache: dict = {}


def _table() -> np.ndarray:
    if "fold" not in _cache:
        _cache["fold"] = _letters()
        leet = np.arange(1 << 16).astype(np.uint16)
        for a, b in LEET.items():
            leet[ord(a)] = ord(b)
        _cache["leet"] = leet
    return _cache["fold"]


def _far(cps: np.ndarray) -> np.ndarray:
    """Folded values of code points beyond the table: styled letters as the letters they style, other letters as wide ones."""
    u, inv = np.unique(cps, return_inverse=True)
    out = np.zeros(len(u), np.uint16)
    for i, c in enumerate(u.tolist()):
        base = unicodedata.normalize("NFKD", chr(c))[0]
        if ord(base) < 1 << 16:
            out[i] = _cache["fold"][ord(base)]
        elif unicodedata.category(base)[0] == "L":
            out[i] = 0x4E00 + c % 0x5000
    return out[inv]


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64))


def words(col: pa.Array, masked: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, row, break before it) of each word of the folded texts; numbers are one class.

    With `masked` also the key that a masked spelling of the word has, 0 for words that are not masked.
    """
    table = _table()
    cps, starts = K.code_points(col)
    rows = len(starts) - 1
    if cps.dtype == np.uint8:
        f = table[cps]
    else:
        f = table[np.minimum(cps, 0xFFFF)]
        far = np.flatnonzero(cps > 0xFFFF)
        if len(far):
            f[far] = _far(cps[far])
    stop = (cps == 10) | (cps == 46) | (cps == 33) | (cps == 63)
    if cps.dtype != np.uint8:
        stop |= cps == 0x3002
    own = np.repeat(np.arange(rows, dtype=np.int32), np.diff(starts))
    gone = f == 0xFF00
    if gone.any():
        f, own, stop = f[~gone], own[~gone], stop[~gone]
    nothing = _NOTHING if masked else _NOTHING[:3]
    if not len(f):
        return nothing

    def bounds(f: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = f > 0
        if len(f) and f.max() >= 0x2E80:  # each character of a script without spaces is a word
            kind = np.where((f >= 0x2E80) & (f < 0xFF00), 2 + (np.arange(len(f)) & 1), kind)
        new = np.append(True, (kind[1:] != kind[:-1]) | (own[1:] != own[:-1]))
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(f))
        k = kind[s] > 0
        return s[k], e[k]

    s, e = bounds(f, own)
    # stars, underlines and signs count only inside words
    odd = np.flatnonzero((f == STAR) | (f == 36) | (f == 64))
    if len(odd):
        plain = np.concatenate([[0], np.cumsum((f > 57) & (f != STAR) & (f != 64), dtype=np.int32)])
        word = np.searchsorted(s, odd, side="right") - 1
        f[odd[plain[e[word]] == plain[s[word]]]] = 0
        s, e = bounds(f, own)
        for _ in range(4):  # stars at the edges are marks of emphasis
            first, last = f[s] == STAR, f[e - 1] == STAR
            f[s[first]] = 0
            f[e[last] - 1] = 0
            s, e = s + first, e - last
            s, e = s[e > s], e[e > s]
    # letters set apart: three or more single letters with one separator between them become a word
    if len(s) > 2:
        single = (e - s == 1) & (f[s] > 57) & (f[s] < 0x2E80)
        link = single[1:] & single[:-1] & (s[1:] - e[:-1] == 1) & (own[s[1:]] == own[s[:-1]])
        two = np.zeros(len(link), bool)
        two[1:] |= link[1:] & link[:-1]
        two[:-1] |= link[1:] & link[:-1]
        gone = e[:-1][link & two]
        if len(gone):
            keep = np.ones(len(f), bool)
            keep[gone] = False
            f, own, stop = f[keep], own[keep], stop[keep]
            s, e = bounds(f, own)
    if not len(s):
        return nothing
    # digits and signs within words stand for letters
    lettered = np.ones(len(s), bool)
    low = np.flatnonzero((f > 0) & ((f < 58) | (f == 64)))
    if len(low):
        word = np.searchsorted(s, low, side="right") - 1
        sign = np.bincount(word[(f[low] == 36) | (f[low] == 64)], minlength=len(s)) > 0
        lettered = (np.bincount(word, minlength=len(s)) < e - s) | (sign & (e - s > 1))
        change = low[lettered[word]]
        f[change] = _cache["leet"][f[change]]
    # doubled letters count once
    keep = np.append(True, (f[1:] != f[:-1]) | (own[1:] != own[:-1]) | (f[1:] < 58))
    at = np.cumsum(keep, dtype=np.int32) - 1
    s2, e2 = at[s].astype(np.int64), at[e - 1].astype(np.int64) + 1
    f2 = f[keep]
    h = np.where(lettered, K.span_hash(K.prefix(f2.astype(np.uint8 if f2.max() < 256 else np.uint32)), s2, e2), np.uint64(NUMBER))
    key = None
    star = np.flatnonzero(f2 == STAR)
    if len(star) or masked:
        key = K.mix(f2[s2].astype(np.uint64) * np.uint64(131) + f2[e2 - 1].astype(np.uint64) + np.uint64(1 << 40))
    if len(star):  # a masked word is known by its first and last letter
        word = np.searchsorted(s2, star, side="right") - 1
        word = word[(star < e2[word]) & lettered[word]]
        h[word] = key[word]
    stops = np.concatenate([[0], np.cumsum(stop, dtype=np.int32)])
    row = own[s].astype(np.int64)
    brk = np.append(True, (stops[s[1:]] > stops[e[:-1]]) | (row[1:] != row[:-1]))
    if not masked:
        return h, row, brk
    plain = lettered & (e2 - s2 > 2) & (f2[s2] < 128) & (f2[e2 - 1] < 128)
    return h, row, brk, np.where(plain, key, np.uint64(0))


@dataclass
class Telling:
    """What the labelled documents tell: known words, masked spellings, telling n-grams and the confirmed windows."""

    vocabulary: np.ndarray  # sorted hashes of the words that are features; all others are one class
    features: np.ndarray  # sorted hashes of the telling n-grams
    odds: np.ndarray  # log odds of each among marked against clean documents
    windows: list[np.ndarray]  # telling n-grams (as indices) of each confirmed window
    masks: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))  # keys of masked words, and the word each is read as

    def tokens(self, h: np.ndarray) -> np.ndarray:
        if len(self.masks[0]):
            i = np.minimum(np.searchsorted(self.masks[0], h), len(self.masks[0]) - 1)
            h = np.where(self.masks[0][i] == h, self.masks[1][i], h)
        return np.where(_in(h, self.vocabulary) | (h == NUMBER), h, np.uint64(UNKNOWN))

    def places(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, n-gram) of each telling n-gram of the texts, in order, and the number of words of each text."""
        rows, at, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = np.zeros(len(col), np.int64)
        for a, b in K.chunks(col, CHUNK):
            h, row, brk = words(col.slice(a, b - a))
            if not len(h):
                continue
            first = np.searchsorted(row, np.arange(b - a + 1))
            size[a:b] = np.diff(first)
            if not len(self.features):
                continue
            place, kind = np.nonzero(_in(f := _grams(self.tokens(h), brk), self.features))
            rows.append(row[place] + a)
            at.append(place - first[row[place]])
            gram.append(np.searchsorted(self.features, f[place, kind]))
        return np.concatenate(rows), np.concatenate(at), np.concatenate(gram), size


def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(h.shape, bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h


def _grams(t: np.ndarray, brk: np.ndarray) -> np.ndarray:
    """Hashes of the word, the pair and the triple that end at each word; breaks cut the history."""
    p1 = np.where(brk, np.uint64(7), np.concatenate([t[:1], t[:-1]]))
    b2 = brk | np.append(True, brk[:-1])
    p2 = np.where(b2, np.uint64(7), np.concatenate([t[:1], t[:1], t[:-2]])[: len(t)])
    before = K.mix(p1 + np.uint64(101))
    return np.stack([K.mix(t * np.uint64(3)), K.mix(t ^ before), K.mix(t ^ K.mix(before ^ K.mix(p2 + np.uint64(303))))], 1)


def _per_document(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each distinct value of each row once."""
    key = h ^ K.mix(row.astype(np.uint64) + np.uint64(5)).reshape(-1, *[1] * (h.ndim - 1))
    return h.ravel()[np.unique(key, return_index=True)[1]]


def _all_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, break, masked spelling) of the words of all texts."""
    col = pa.array(texts, pa.large_string())
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64))]
    for a, b in K.chunks(col, CHUNK):
        h, row, brk, mask = words(col.slice(a, b - a), masked=True)
        parts.append((h, row + a, brk, mask))
    return tuple(np.concatenate(x) for x in zip(*parts))


def learn(marked: list[str], clean: list[str]) -> Telling:
    """Telling n-grams and confirmed windows from texts marked as abusive and texts marked as clean; repeated texts count once.

    The log odds of an n-gram leave out the document whose window they weigh. A window is confirmed where their
    sum exceeds that of the most telling window of the share TYPICAL of the clean texts.
    """
    marked, clean = list(dict.fromkeys(marked)), list(dict.fromkeys(clean))
    (hp, rp, bp, kp), (hn, rn, bn, _) = _all_words(marked), _all_words(clean)
    u, n = np.unique(np.concatenate([_per_document(hp, rp), _per_document(hn, rn)]), return_counts=True)
    none = Telling(u[n >= SEEN], np.zeros(0, np.uint64), np.zeros(0), [])
    if not len(hp):
        return none
    fp, fn = _grams(none.tokens(hp), bp), _grams(none.tokens(hn), bn)
    prior = len(marked) / (len(marked) + len(clean) + 1)
    every = np.unique(np.concatenate([fp.ravel(), fn.ravel()]))
    (up, m_), (un, c_) = (np.unique(_per_document(f, r), return_counts=True) for f, r in ((fp, rp), (fn, rn)))
    m, c = np.zeros(len(every)), np.zeros(len(every))
    m[np.searchsorted(every, up)], c[np.searchsorted(every, un)] = m_, c_
    odds = lambda m, c: np.log((m + DOUBT * prior) / (c + DOUBT * (1 - prior))) - np.log(prior / (1 - prior))
    ip, in_ = np.searchsorted(every, fp), np.searchsorted(every, fn)
    score, end = _sums(odds(np.maximum(m[ip] - 1, 0), c[ip]).sum(1), rp)
    usual, _ = _sums(odds(m[in_], np.maximum(c[in_] - 1, 0)).sum(1), rn)
    most = np.full(len(clean), -np.inf)
    np.maximum.at(most, rn, usual)
    level = np.quantile(most[np.isfinite(most)], TYPICAL) if np.isfinite(most).any() else 0.0
    chosen = np.flatnonzero(score > max(level, 0.0))
    depth = np.zeros(len(hp) + 1, np.int64)
    np.add.at(depth, chosen, 1)
    np.add.at(depth, end[chosen], -1)
    inside = np.cumsum(depth)[:-1] > 0
    held = np.unique(fp[inside])
    lift = odds(m, c)[np.searchsorted(every, held)]
    features, lift = held[lift > TELLING], lift[lift > TELLING]
    windows = []
    for a, b in zip(chosen, end[chosen]):
        g = fp[a:b].ravel()
        windows.append(np.searchsorted(features, g[_in(g, features)]))
    # masked spellings are read as the telling word with the same first and last letter, where that is one word
    single = inside & _in(fp[:, 0], features) & (kp != 0)
    pairs = np.unique(np.stack([kp[single], hp[single]]), axis=1)
    keys, first, count = np.unique(pairs[0], return_index=True, return_counts=True)
    masks = (keys[count == 1], pairs[1][first[count == 1]])
    return Telling(none.vocabulary, features, lift, windows, masks)


def _sums(w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the values of the window that begins at each word, its end)."""
    end = np.minimum(np.arange(len(w)) + WINDOW, np.searchsorted(row, row, side="right"))
    cum = np.concatenate([[0.0], np.cumsum(w)])
    return cum[end] - cum[:-1], end


def fit(documents: DataFrame, labels: DataFrame) -> Telling:
    """What at most MARKED abusive and CLEAN clean labelled documents tell, those of least hash of doc_id."""
    marks = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.max("abusive").alias("abusive"))
    mark = least_hashed(marks.where("abusive > 0"), "doc_id", MARKED).unionByName(least_hashed(marks.where("abusive = 0"), "doc_id", CLEAN))
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = docs.join(F.broadcast(mark), "doc_id").orderBy("doc_id").toPandas()  # `mark` has at most MARKED + CLEAN rows
    return learn(got[got.abusive > 0].text.tolist(), got[got.abusive == 0].text.tolist())


_PLACES = "doc_id long, source string, n_words long, word array<int>, gram array<int>"


def places(documents: DataFrame, told: Telling) -> DataFrame:
    """(doc_id, source, n_words, word, gram) of each document: the places of its telling n-grams."""
    blob = pickle.dumps(Telling(told.vocabulary, told.features, told.odds, [], told.masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pickle.loads(blob)
        for batch in batches:
            row, at, gram, size = t.places(K.as_array(batch.column("text")))
            off = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int32())) for x in (at, gram)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size), *lists], ["doc_id", "source", "n_words", "word", "gram"])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PLACES)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first and end place) of the window that begins at each word with a telling n-gram, and the n-grams of all places."""
    col, grams = batch.column("word"), batch.column("gram")
    at, gram = col.flatten().to_numpy(), grams.flatten().to_numpy()
    size = np.diff(col.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    key = row.astype(np.int64) << 32 | at
    begin, lo = np.unique(key, return_index=True)
    return row[lo], lo, np.searchsorted(key, begin + WINDOW), gram


def distinct_windows(found: DataFrame) -> DataFrame:
    """(grams, n): the n-grams of each distinct window (as 32-bit numbers) and how often it stands in the documents; `grams` null counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lo, hi, gram = _windows(batch)
            raw = gram.astype("<i4").tobytes()
            seen: dict[bytes | None, int] = {None: int(batch.column("n_words").to_numpy().sum())}
            for a, b in zip((4 * lo).tolist(), (4 * hi).tolist()):
                k = raw[a:b]
                seen[k] = seen.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["grams", "n"])

    return found.select("n_words", "word", "gram").mapInArrow(run, "grams binary, n long").groupBy("grams").agg(F.sum("n").alias("n"))


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of all windows, bounds of each window, number of each)."""
    col = batch.column("grams")
    ind = np.frombuffer(b"".join(col.to_pylist()), "<i4")
    size = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return ind, (size - size[0]) // 4, batch.column("n").to_numpy().astype(float)


def _margins(w: np.ndarray, ind: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0.0], np.cumsum(w[ind])])
    return cum[ptr[1:]] - cum[ptr[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(told: Telling, windows: DataFrame, words_: int) -> float:
    """Share of abusive windows: the least ratio of the unlabelled to the confirmed windows beyond a log odds, over all documents."""
    size = [len(x) for x in told.windows]
    mine = _margins(told.odds, np.concatenate(told.windows), np.concatenate([[0], np.cumsum(size)]))
    levels = np.quantile(mine, [0.05, 0.1, 0.25, 0.5])
    odds = told.odds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(levels))
        for batch in batches:
            ind, ptr, n = _unpack(batch)
            z = _margins(odds, ind, ptr)
            total += [(n * (z > x)).sum() for x in levels]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(levels))), pa.array(total)], ["i", "n"])

    got = windows.mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return float(min(max(r.n, 1.0) / words_ / max((mine > levels[r.i]).mean(), 1e-9) for r in got))


@dataclass
class Classifier:
    told: Telling
    weight: np.ndarray
    bias: float

    def places(self, found: DataFrame) -> DataFrame:
        """(doc_id, source, margin) of the documents of `places`: that of the most telling window; null without words."""
        w, bias = self.weight, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, lo, hi, gram = _windows(batch)
                cum = np.concatenate([[0.0], np.cumsum(w[gram])])
                best = np.zeros(batch.num_rows)
                np.maximum.at(best, row, cum[hi] - cum[lo])
                none = batch.column("n_words").to_numpy() == 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(best + bias, mask=none)], ["doc_id", "source", "margin"])

        return found.mapInArrow(run, "doc_id long, source string, margin double")


def train(told: Telling, found: DataFrame, steps: int = STEPS) -> Classifier:
    """Weights of minimal non-negative positive-unlabelled risk with the logistic loss, by Adam, over the windows of all documents.

    Each step is one sum over the distinct windows. Words without a telling n-gram begin windows whose margin is
    the bias; they enter as a number.
    """
    k = len(told.features)
    w, bias = np.zeros(k), -4.0
    counted = cut(distinct_windows(found)) if told.windows else None
    total = counted.where("grams is null").agg(F.sum("n")).first()[0] if told.windows else 0
    if not total:
        return Classifier(told, w, bias)
    windows = counted.where("grams is not null")
    prior = class_prior(told, windows, total)
    pind, psize = np.concatenate(told.windows), np.array([len(x) for x in told.windows])
    pptr = np.concatenate([[0], np.cumsum(psize)])
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, bias: float = bias) -> Iterator[pa.RecordBatch]:
            # gradient over the features, then of the bias, the risk and the number of windows; beside it the part of telling windows
            g, telling = np.zeros(k + 3), np.zeros(k + 3)
            for batch in batches:
                ind, ptr, n = _unpack(batch)
                z = _margins(w, ind, ptr) + bias
                s = n * _sigmoid(z)
                size = np.diff(ptr)
                g[:k] += np.bincount(ind, np.repeat(s, size), k)
                telling[:k] += np.bincount(ind, np.repeat(s * (z > 0), size), k)
                g[k:] += [s.sum(), (n * np.logaddexp(0, z)).sum(), n.sum()]
                telling[k] += (s * (z > 0)).sum()
            i = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(g[i]), pa.array(telling[i])], ["i", "g", "t"])

        got = windows.mapInArrow(run, "i long, g double, t double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("t").alias("t")).toPandas()
        g, telling = np.zeros(k + 3), np.zeros(k + 3)
        g[got["i"]], telling[got["i"]] = got["g"], got["t"]
        rest = total - g[k + 2]
        zp = _margins(w, pind, pptr) + bias
        sp = _sigmoid(zp)
        risk = (g[k + 1] + rest * np.logaddexp(0, bias)) / total - prior * np.logaddexp(0, zp).mean()
        if risk >= 0:
            gp, gu = prior * ((sp - 1) - sp) / len(sp), g[: k + 1] / total  # loss as positive, less the loss as negative
            gu[k] += rest * _sigmoid(bias) / total
        else:  # the estimate of the negative risk must not fall below zero: it steps back while the positive risk still falls
            gp, gu = prior * ((sp - 1) + BACK * sp) / len(sp), -BACK * telling[: k + 1] / total  # for the telling windows; doubtful ones are not lifted
        grad = gu.copy()
        grad[:k] += np.bincount(pind, np.repeat(gp, psize), k)
        grad[k] += gp.sum()
        grad /= prior
        grad[:k] += 1e-3 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:k], bias - move[k] / 2
    return Classifier(told, w, bias)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, abusive) of each document.

    `score` is the estimated probability that the document's most telling window is abusive, 0 for null, empty
    and wordless texts; `abusive` says that it exceeds one half. Without any marked document nothing is abusive.
    Rows of null doc_id are left out, repeated rows each count, other columns are ignored.
    """
    told = fit(documents, labels)
    found = cut(places(documents, told))
    margins = train(told, found).places(found)
    return margins.select("doc_id", "source", F.coalesce(1 / (1 + F.exp(-F.col("margin"))), F.lit(0.0)).alias("score"), F.coalesce(F.col("margin") > 0, F.lit(False)).alias("abusive"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/doc_labels.parquet"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("abusive").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "abusive")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and rate of abusive ones by source (lower case, null kept)."""
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_sources": p9_sources}
