"""Broken prompt and response pairs (problem 5).

A linear-chain conditional random field tags the clauses of a response as answer, refusal, remark on the
task, echo of the prompt, foreign or unfinished. It is trained on a bounded sample of rows whose clauses
carry partial labels (clear cues fix a clause's tag, cut copies of sound rows supply unfinished ends, all
other clauses are left open). The coverage of the tags decides on the defect of a pair.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.llm.residue import findings
from lexloom.llm.sampling import least_hashed
from lexloom.llm.tokenizer import kinds

STATES = ("answer", "refusal", "remark", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, REMARK, ECHO, FOREIGN, UNFINISHED = range(6)
SAMPLE = 1500  # rows that the field is trained on, the least by hash of their key; all rows where there are fewer
COPIED = 0.75  # share of the prompt's words that a copy holds
STEPS = 90
SHORT = 40  # words of a short row
DECLINED = 2.0  # log odds of a clause's words, over the root of their number, from which they are those of refusals

# Cues of a refusal, as words without punctuation.
REFUSALS = """
i can not|i cannot|i can t|i cant|i could not|i am unable|i m unable|i won t|i will not be able|i am not able|i m not able|i m sorry|i am sorry|sorry i|sorry but|my apologies|i apologise|i apologize|apologies but|regrettably|unfortunately i|i regret|
i d rather not|i would rather not|i must decline|i have to decline|i decline|i refuse|not something i can|beyond my abilities|beyond my|outside my|go against policy|goes against|against policy|against my|can be offered by me|cannot be offered|not permitted to|not allowed to paraphrase|assistant is not|
as an ai|as a language model|let us stop here|must not be altered|consult a qualified|consult a lawyer|seek professional|as i lack|lack enough context|guidelines do not allow|do not allow it|please try another|try another passage|if you share|cannot assist|can t assist|cannot help|can t help|cant help|cannot fulfil|cannot fulfill|cannot comply|cannot provide|can not provide|cannot rewrite|can t rewrite|no rewrite of|i have no|t feel comfortable|not comfortable|not be appropriate|not appropriate for|inappropriate for me|decline to|not going to|nobody here will|stays as it is|out of scope|not able to offer|you could ask a|ask a teacher|ask a lawyer|it may count as|count as legal|its sensitive content|due to its sensitive
"""
# Cues of talk about the task, as words without punctuation.
REMARKS = """
here is the rewrite|here is a|here is the version|here is the simplified|here is my|here is how|here s the|here s a|here s my|sure here|certainly here|of course here|okay the user|ok the user|the user wants|the user asks|the user asked|you asked for|as you asked|as requested|i need to|i should|i will|i ll|i would|i have rewritten|i have simplified|i want to|we should|we need to|we could|we must check|let me|let us|
this rewrite|the rewrite|my rewrite|rewrite for|rewrite the|simplified version|simplified text|plain english|reading ease|reading level|key term|key terms|planning notes|drafting|first draft|final draft|original text|text analysis|the passage is|the passage on|this passage|the text is about|the source text|the part on|maybe split|split the part|is hard for|for beginner|for intermediate|for advanced|is there anything else|anything else you need|let me know|thank you for the|hope this helps|note that i|step 1|step one|
first look at|into plain|but change the order|with a simple noun|simple noun|check which terms|terms must stay|ease should go|should go up by|shorter sentences|shorten sentence|too long|avoid copying|keep the term|keep the terms|thinking about the task|word count|target level|to simplify|to rewrite|would approach|a simplified version|a beginner version|a intermediate version|a advanced version|an intermediate version|an advanced version|user wants a
"""
# Frequent short words of English and of other languages written in Latin letters.
ENGLISH = "the of and to in a is that for it was on with as by be at this from or had not but an are which have has were their they he she his her its if may must when because who no under any shall such been would can will".split()
OTHER_LANGUAGES = [line.split() for line in """
le la les des du un une et est que qui dans pour pas sur au aux avec ce cette ne se il elle sont ou par plus mais son sa ses nous vous leur envers selon
der die das und ist nicht ein eine einer eines dem den des zu mit von auf für im sich auch es an werden wird aus bei nach wie aber sobald gegenüber konnte muss
el los las una y es en con por para su del al lo como más pero sus este esta son fue ha cuando sobre entre también frente según debe
il lo gli e di che è un una per non con del della nel sono alla dal da si come più anche ma verso quando secondo deve davanti
o os as um uma do da dos das em no na com não para por que se foi mais mas ao pelo
de het een en van ik te dat op aan met voor zijn er niet om ook bij naar door
och att det som en på är av för med den till inte har de om ett han var jag
nie się na w z do jest że to jak od po przez dla
""".strip().splitlines()]
OTHERS = [w for line in OTHER_LANGUAGES for w in line]
# Words of the last list that English text holds too.
SHARED = "do no so am also come son per non war door met van man on os as a i o e y ha to an me all".split()
# Stand-ins for an answer.
STANDINS = frozenset(["n a", "na", "null", "none", "nil", "nan", "empty", "undefined", "no answer", "no response", "no output", "no text", "not available", "not applicable", "unknown", "blank", "missing", "void", "nothing", "no rewrite", "no data", "no content", "no result", "leer", "vide", "vacio", "vuoto"])
# Words that open a clause which needs a second one.
OPENERS = "when although because since while if where unless though whereas".split()

_FIRST = "i me my mine myself we us our im ill ive id".split()


def _hash_words(words: list[str]) -> np.ndarray:
    """Hashes of words as `_words` gives them."""
    col = pa.array(words, pa.large_string())
    cps, starts = K.code_points(col)
    low, _ = _fold(cps)
    return K.span_hash(K.prefix(low), starts[:-1], starts[1:])


_cache: dict = {}


def _fold(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased letters and digits, 0 elsewhere; the kind of each character)."""
    return K.lower(cps), kinds(cps)


def _cues(text: str) -> dict[int, np.ndarray]:
    """Sorted hashes of the phrases of each number of words."""
    out: dict[int, list] = {}
    for p in text.replace("\n", "").split("|"):
        if p.strip():
            w = _hash_words(p.split())
            out.setdefault(len(w), []).append(K.shingle(w, len(w))[0] if len(w) > 1 else w[0])
    return {n: np.sort(np.array(v, np.uint64)) for n, v in out.items()}


def _lexicon() -> dict:
    if "lex" not in _cache:
        _cache["lex"] = {
            "refusal": _cues(REFUSALS), "remark": _cues(REMARKS), "english": np.sort(_hash_words(ENGLISH)), "others": np.sort(_hash_words(sorted(set(OTHERS) - set(ENGLISH) - set(SHARED)))),
            "first": np.sort(_hash_words(_FIRST)), "openers": np.sort(_hash_words(OPENERS)), "said": np.sort(_hash_words("said wrote claimed told answered replied asked argued added".split())),
        }
    return _cache["lex"]


def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[i] == h


def _phrase_hits(h: np.ndarray, own: np.ndarray, cues: dict[int, np.ndarray], quoted: np.ndarray) -> np.ndarray:
    """For each word, the number of cue phrases that begin there, outside quotation marks."""
    out = np.zeros(len(h))
    for n, keys in cues.items():
        g = h if n == 1 else K.shingle(h, n)
        if len(g):
            hit = _in(g, keys) & (own[: len(g)] == own[n - 1 :]) & ~quoted[: len(g)]
            out[: len(g)] += hit
    return out


@dataclass
class Text:
    """Words, clauses and features of the responses of a chunk."""

    rows: int
    first: np.ndarray  # first clause of each row and the end
    own: np.ndarray  # row of each clause
    weight: np.ndarray  # letters of each clause
    words: np.ndarray  # words of each clause
    x: np.ndarray  # features
    copied: np.ndarray  # share of the prompt's words that the response holds, by row; 0 where it cannot reach COPIED
    letters: np.ndarray  # letters and digits by row
    standin: np.ndarray  # rows whose whole text stands in for an answer
    latin_words: np.ndarray
    english: np.ndarray  # share of short English words by row
    sentences: np.ndarray  # ends of sentences by row
    declined: np.ndarray  # how much the words of each clause are those of refusals


_NO_TABLE = (np.zeros(0, np.uint64), np.zeros(0))
NAMES = ("bias", "refusal", "remark", "first person", "quoted", "echo", "others", "english", "non-latin", "open end", "finality", "cut word", "ellipsis", "first", "last", "short", "colon", "talk", "opener", "bullet", "firm end", "declined")
_COL = {n: i for i, n in enumerate(NAMES)}


def analyse(src: pa.Array, rew: pa.Array, talk: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], declines: tuple[np.ndarray, np.ndarray] = _NO_TABLE) -> Text:
    """Clauses and their features. talk, declines: (hashes, log odds) of words of remarks and of refusals; ends: (keys, log odds) of word pairs that end sentences."""
    lex = _lexicon()
    n_rows = len(rew)
    cps, starts = K.code_points(rew)
    n = len(cps)
    low, kind = _fold(cps)
    is_word = low > 0
    # words; a character of a script without spaces is a word of its own
    wide = np.zeros(n, bool) if cps.dtype == np.uint8 else (cps >= 0x2E80) & is_word
    group = is_word.astype(np.int64)
    if wide.any():
        group = np.where(wide, 2 + (np.arange(n) & 1), group)
    s, e = K.runs(group, starts)
    h = K.span_hash(K.prefix(low), s, e)
    wrow = np.repeat(np.arange(n_rows), np.diff(np.searchsorted(s, starts)))
    # clause ends: a stop before white space or the end, a line end, a colon before white space, a wide full stop
    space = np.append((kind[1:] == 4) if n else np.zeros(0, bool), True) if n else np.zeros(0, bool)
    text_end = np.zeros(n + 1, bool)
    text_end[starts[1:]] = True
    before_end = text_end[1 : n + 1]
    stop = np.isin(cps, [46, 33, 63, 0x2026])
    closer = np.isin(cps, [34, 39, 41, 93, 0x201D, 0x2019])
    after_closer = np.zeros(n, bool)
    if n > 1:
        after_closer[:-1] = closer[1:] & (space[1:] | before_end[1:])
    cut = (stop & (space | before_end)) | np.isin(cps, [10, 0x3002, 0xFF01, 0xFF1F]) | ((cps == 58) & (space | before_end))
    shifted = np.flatnonzero(stop & after_closer & ~before_end) + 1
    cut[shifted] = True
    bounds = np.zeros(n + 1, bool)
    bounds[np.flatnonzero(cut) + 1] = True
    bounds[starts[:-1]] = True
    bounds[n] = False
    # number of the stretch of each word; stretches without words vanish
    stretch = np.cumsum(bounds)[s] if len(s) else np.zeros(0, np.int64)
    new = np.append(True, (stretch[1:] != stretch[:-1]) | (wrow[1:] != wrow[:-1])) if len(s) else np.zeros(0, bool)
    cl = np.flatnonzero(new)  # first word of each clause
    cw = np.cumsum(new) - 1  # clause of each word
    nc = len(cl)
    own = wrow[cl] if nc else np.zeros(0, np.int64)
    first = np.searchsorted(own, np.arange(n_rows + 1))
    size = np.diff(np.append(cl, len(s)))
    letter = (kind == 1).astype(np.int64)
    cum = np.concatenate([[0], np.cumsum(letter)])
    wl = cum[e] - cum[s]
    add = lambda v: np.add.reduceat(v, cl) if nc else np.zeros(0)
    weight = add(np.maximum(wl, 1)).astype(float)
    last_word = np.append(cl[1:], len(s)) - 1 if nc else np.zeros(0, np.int64)
    # quotation: an odd number of marks since the clause began
    marks = np.concatenate([[0], np.cumsum(np.isin(cps, [34, 0x201C, 0x201D]))])
    quoted = ((marks[s] - marks[s[cl]][cw]) % 2 == 1) | ((marks[s] > marks[np.maximum(s[cl][cw] - 1, 0)]) & ((marks[s] - marks[np.maximum(s[cl][cw] - 1, 0)]) % 2 == 1)) if nc else np.zeros(0, bool)
    closing = marks[np.minimum(np.append(e[last_word], 0)[:nc] + 2, n)] if nc else np.zeros(0)
    pairs = closing - marks[np.maximum(s[cl] - 1, 0)] >= 2 if nc else np.zeros(0, bool)
    quoted &= pairs[cw] if nc else False
    x = np.zeros((nc, len(NAMES)))
    declined = np.zeros(nc)
    x[:, 0] = 1
    if nc:
        sz = np.maximum(size, 1)
        x[:, 1] = np.minimum(add(_phrase_hits(h, cw, lex["refusal"], quoted)), 2)
        x[:, 2] = np.minimum(add(_phrase_hits(h, cw, lex["remark"], quoted)), 2)
        x[:, 3] = np.minimum(add((_in(h, lex["first"]) & ~quoted).astype(float)), 2)
        x[:, 4] = (add(quoted.astype(float)) > 0) & (add(_in(h, lex["said"]).astype(float)) > 0)
        x[:, 6] = add(_in(h, lex["others"]).astype(float)) / sz
        en = _in(h, lex["english"]).astype(float)
        x[:, 7] = add(en) / sz
        far = (low[s] > 0x24F) & (kind[s] == 1)
        x[:, 8] = add(np.where(far, np.maximum(wl, 1), 0)) / np.maximum(weight, 1)
        # the end of the row
        tail = np.zeros(nc, bool)
        tail[first[1:][first[1:] > first[:-1]] - 1] = True
        stops = np.concatenate([[0], np.cumsum(np.isin(cps, [46, 33, 63, 0x3002, 0xFF01, 0xFF1F]))])
        end_of = starts[own + 1]
        closed = stops[end_of] > stops[e[last_word]]
        dots = np.concatenate([[0], np.cumsum(cps == 0x2026)])
        three = np.concatenate([[0], np.cumsum(cps == 46)])
        open_end = tail & ~closed & ~(wide[s[last_word]] & False)
        ell = tail & ((dots[end_of] > dots[e[last_word]]) | (three[end_of] - three[e[last_word]] >= 3))
        colon_after = np.concatenate([[0], np.cumsum(cps == 58)])
        x[:, 16] = colon_after[np.minimum(e[last_word] + 3, n)] > colon_after[e[last_word]]
        open_end |= ell
        c = np.append(cps, [0, 0])
        bracketed = np.isin(np.where(s[cl] > 0, cps[np.maximum(s[cl] - 1, 0)], 0), [40, 91]) & np.isin(c[e[last_word]], [41, 93])
        open_end &= ~bracketed  # a remark in brackets after the last sentence
        x[:, 9] = open_end
        key = _end_keys(cps, s, h, cw, cl, low)
        score = np.zeros(nc)
        for k in (2, 1, 0):
            i = np.minimum(np.searchsorted(ends[0], key[k][last_word]), max(len(ends[0]) - 1, 0)) if len(ends[0]) else None
            if i is not None:
                hit = ends[0][i] == key[k][last_word]
                score = np.where(hit & (score == 0), ends[1][i], score)
        x[:, 10] = np.where(open_end, score, 0)
        x[:, 12] = ell
        x[np.minimum(first[:-1], nc - 1)[first[1:] > first[:-1]], 13] = 1
        x[:, 14] = tail
        x[:, 15] = size < 6
        if len(talk[0]):
            i = np.minimum(np.searchsorted(talk[0], h), len(talk[0]) - 1)
            odds = np.where((talk[0][i] == h) & ~quoted, talk[1][i], 0.0)
            x[:, 17] = np.clip(add(odds) / np.sqrt(sz), -4, 4)
        if len(declines[0]):
            i = np.minimum(np.searchsorted(declines[0], h), len(declines[0]) - 1)
            declined = add(np.where((declines[0][i] == h) & ~quoted, declines[1][i], 0.0)) / np.sqrt(sz)
            x[:, 21] = np.clip(declined, 0, 4)
        commas = np.concatenate([[0], np.cumsum(cps == 44)])
        x[:, 18] = open_end & _in(h[cl], lex["openers"]) & (commas[e[last_word]] == commas[s[cl]])
        lead = np.where(s[cl] > 0, cps[np.maximum(s[cl] - 1, 0)], 0)
        x[:, 19] = (lead == 42) | ((kind[s[cl]] == 2) & (np.append(cps, [0, 0])[e[cl]] == 41))
        x[:, 20] = tail & closed & ~ell
    # the prompt's words in the response, and the response's words in the prompt
    enc = K.as_array(src).dictionary_encode()
    low2, s2, e2, h2, f2 = K.ascii_words(enc.dictionary.cast(pa.large_string()))
    which = enc.indices.to_numpy(zero_copy_only=False)
    src2 = np.repeat(np.arange(len(f2) - 1), np.diff(f2))
    salt = lambda r: K.mix(r.astype(np.uint64) + np.uint64(77))
    t2 = K.shingle(h2, 3)
    k2, at2, n2 = np.unique((t2 ^ salt(src2[: len(t2)]))[src2[2:] == src2[:-2]], return_index=True, return_counts=True) if len(t2) else (t2, t2, t2)  # the triples of each distinct prompt
    copied = np.zeros(n_rows)
    low3, s3, e3, h3, f3 = K.ascii_words(rew)
    row3 = np.repeat(np.arange(n_rows), np.diff(f3))
    if len(k2) and len(h3) >= 3:
        t3 = K.shingle(h3, 3)
        k3 = t3 ^ salt(which[row3[: len(t3)]])
        m3 = _in(k3, k2) & (row3[2:] == row3[:-2])
        c3 = np.zeros(len(h3), bool)
        c3[: len(m3)] |= m3
        c3[1 : len(m3) + 1] |= m3
        c3[2 : len(m3) + 2] |= m3
        # the share of the prompt that is copied, of the rows that hold triples enough for COPIED of it
        count2 = np.diff(f2)[which]
        often = np.zeros(len(f2) - 1)
        np.maximum.at(often, src2[:-2][src2[2:] == src2[:-2]][at2], n2)
        for r in np.flatnonzero((3 * often[which] * np.bincount(row3[2:][m3], minlength=n_rows) >= COPIED * count2) & (count2 > 2)):
            p = t2[f2[which[r]] : f2[which[r] + 1] - 2]
            c2 = np.zeros(len(p) + 2, bool)
            hit = _in(p, np.sort(t3[f3[r] : f3[r + 1] - 2]))
            for k in range(3):
                c2[k : k + len(p)] |= hit
            copied[r] = c2.mean()
        if nc:
            # by character position, as the two tokenisations differ outside ASCII
            cov = np.zeros(n + 1, np.int64)
            np.add.at(cov, np.minimum(s3, n), c3.astype(np.int64))
            tot = np.zeros(n + 1, np.int64)
            np.add.at(tot, np.minimum(s3, n), 1)
            cc, ct = np.concatenate([[0], np.cumsum(cov)]), np.concatenate([[0], np.cumsum(tot)])
            lo, hi = s[cl], e[last_word]
            x[:, 5] = (cc[hi] - cc[lo]) / np.maximum(ct[hi] - ct[lo], 1)
            # the last words of open ends that stand in the row's prompt
            kn = np.zeros(nc, bool)
            last = np.flatnonzero(x[:, 9] > 0)
            at3 = np.minimum(np.searchsorted(s3, s[last_word[last]]), len(s3) - 1)
            same = s3[at3] == s[last_word[last]]
            kn[last[same]] = _in(h3[at3[same]] ^ salt(which[own[last[same]]]), np.sort(h2 ^ salt(src2)))
            i1 = np.minimum(np.searchsorted(ends[0], key[0][last_word]), max(len(ends[0]) - 1, 0)) if len(ends[0]) else np.zeros(nc, int)
            seen = (ends[0][i1] == key[0][last_word]) if len(ends[0]) else np.zeros(nc, bool)
            x[:, 11] = (x[:, 9] > 0) & ~kn & ~seen
    by_row = lambda v: np.bincount(own, weights=v, minlength=n_rows)
    total_words = by_row(size.astype(float)) if nc else np.zeros(n_rows)
    alnum = np.bincount(np.repeat(np.arange(n_rows), np.diff(starts)), weights=is_word, minlength=n_rows) if n else np.zeros(n_rows)
    standin = np.zeros(n_rows, bool)
    short = np.flatnonzero((alnum > 0) & (alnum <= 16) & (total_words <= 3))
    for r in short:
        a, b = np.searchsorted(s, starts[r]), np.searchsorted(s, starts[r + 1])
        standin[r] = " ".join("".join(map(chr, low[i:j])) for i, j in zip(s[a:b], e[a:b])) in STANDINS
    stop_count = np.bincount(np.repeat(np.arange(n_rows), np.diff(starts))[np.flatnonzero(cut & (cps != 58))] if n else np.zeros(0, int), minlength=n_rows)
    return Text(n_rows, first, own, weight, size, x, copied, alnum, standin, total_words, by_row(x[:, 7] * size) / np.maximum(total_words, 1) if nc else np.zeros(n_rows), stop_count, declined)


def _end_keys(cps: np.ndarray, s: np.ndarray, h: np.ndarray, cw: np.ndarray, cl: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word a key of it alone, of it with the word before, and of it with the two before; numbers and names are classes."""
    upper = (cps[s] != low[s]) & (cps[s] < 0x250)
    start = np.zeros(len(s), bool)
    start[cl] = True
    k = np.where((low[s] >= 48) & (low[s] <= 57), np.uint64(11), np.where(upper & ~start, np.uint64(13), h))
    before = np.where(start, np.uint64(17), np.concatenate([k[:1], k[:-1]]))
    before2 = np.where(start | np.append(True, start[:-1]), np.uint64(19), np.concatenate([k[:1], k[:1], k[:-2]])[: len(k)])
    pair = K.mix(k * np.uint64(3) ^ K.mix(before))
    return K.mix(k ^ np.uint64(0x5151)), pair, K.mix(pair ^ K.mix(before2 + np.uint64(23)))


def impossible(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Tags that a clause cannot have: an unfinished clause stands last and open, a foreign one shows foreign words or letters, an echo
    stands in the prompt, a refusal has a cue in its row (`own`) or the words of refusals, and a remark a cue or the words of remarks."""
    out = np.zeros((len(x), len(STATES)), bool)
    out[(x[:, 14] == 0) | (x[:, 9] == 0), UNFINISHED] = True
    out[(x[:, 8] <= 0.2) & (x[:, 6] <= 0.08), FOREIGN] = True
    out[x[:, 5] < 0.5, ECHO] = True
    if len(x):
        has = lambda rows: np.bincount(own[rows], minlength=own.max() + 1)[own] > 0
        out[~(has(x[:, 1] > 0) | ((x[:, 21] >= DECLINED) & (x[:, 2] == 0))), REFUSAL] = True
        out[~has((x[:, 2] > 0) | (x[:, 3] > 0) | (x[:, 17] > 1.5)), REMARK] = True
    return out


class Field:
    """Linear-chain conditional random field over clause features, with partial labels in training."""

    def __init__(self, features: int):
        k = len(STATES)
        self.w, self.t, self.a, self.z = np.zeros((features, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)

    def _padded(self, text: Text, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(text.first)[rows]
        return text.first[rows][:, None] + np.arange(int(n.max()))[None], n

    def train(self, x: np.ndarray, allowed: np.ndarray, first: np.ndarray, weight: np.ndarray, steps: int = STEPS, l2: float = 1e-4) -> None:
        """Adam on the marginal likelihood: `allowed` (clauses, states) says which tags a clause may have. Rows of like length are worked on together."""
        size = np.diff(first)
        if not (size > 0).any():
            return
        weight = np.where(size > 0, weight, 0) / weight[size > 0].sum()
        own = np.repeat(np.arange(len(size)), size)
        never = np.where(impossible(x, own), -60.0, 0.0)
        mask = np.where(allowed, 0.0, -60.0)
        groups, order = [], np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        while len(order):
            k = int(np.searchsorted(size[order], max(2 * size[order[0]], 8), side="right"))
            rows, order = order[:k], order[k:]
            at = np.minimum(first[rows][:, None] + np.arange(int(size[rows].max()))[None], len(x) - 1)
            groups.append((at, np.arange(at.shape[1])[None] < size[rows][:, None], size[rows], weight[rows]))
        theta = [self.w, self.t, self.a, self.z]
        m1, m2 = [np.zeros_like(v) for v in theta], [np.zeros_like(v) for v in theta]
        for step in range(1, steps + 1):
            score = x @ self.w + never
            flat = np.zeros((len(x), len(STATES)))
            gt, ga, gz = np.zeros_like(self.t), np.zeros_like(self.a), np.zeros_like(self.z)
            for at, on, n, w in groups:
                u = score[at]
                free, ft = self._expect(u, on, n, w)
                fixed, xt = self._expect(u + mask[at], on, n, w)
                diff = (fixed - free) * (on * w[:, None])[:, :, None]
                flat[at[on]] = diff[on]
                gt += xt - ft
                ga += diff[:, 0].sum(0)
                gz += diff[np.arange(len(n)), n - 1].sum(0)
            for i, (v, g) in enumerate(zip(theta, [x.T @ flat, gt, ga, gz])):
                g = g - l2 * v
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                v += 0.15 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)

    def _expect(self, u: np.ndarray, on: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each clause, expected transitions)."""
        r, width, k = u.shape
        top = u.max(2, keepdims=True)
        em = np.exp(u - top)
        tr = np.exp(self.t)
        alpha = np.zeros_like(em)
        scale = np.ones((r, width))
        a = em[:, 0] * np.exp(self.a)
        for i in range(width):
            if i:
                a = np.where(on[:, i, None], (alpha[:, i - 1] @ tr) * em[:, i], alpha[:, i - 1])
            end = np.where((n - 1 == i)[:, None], np.exp(self.z), 1.0)
            a = a * end
            scale[:, i] = a.sum(1)
            a = a / np.maximum(scale[:, i, None], 1e-300)
            alpha[:, i] = a
        beta = np.ones((r, k))
        post = np.zeros_like(em)
        trans = np.zeros((k, k))
        for i in range(width - 1, -1, -1):
            live = on[:, i, None]
            p = alpha[:, i] * beta
            post[:, i] = np.where(live, p / np.maximum(p.sum(1, keepdims=True), 1e-300), 0)
            if i:
                end = np.where((n - 1 == i)[:, None], np.exp(self.z), 1.0)
                b = em[:, i] * end * beta
                joint = alpha[:, i - 1][:, :, None] * tr[None] * b[:, None, :]
                joint = joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
                trans += (joint * (live * weight[:, None])[:, :, None]).sum(0)
                nb = b @ tr.T
                beta = np.where(live, nb / np.maximum(nb.max(1, keepdims=True), 1e-300), 1.0)
        return post, trans

    def decode(self, text: Text) -> np.ndarray:
        """Most probable tag of each clause."""
        tags = np.zeros(len(text.x), np.int64)
        n = np.diff(text.first)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        u = text.x @ self.w - 60.0 * impossible(text.x, text.own)
        a = 0
        while a < len(order):
            b = int(np.searchsorted(n[order], max(2 * n[order[a]], 8), side="right"))
            rows = order[a:b]
            at, size = self._padded(text, rows)
            width = at.shape[1]
            on = np.arange(width)[None] < size[:, None]
            e = u[np.minimum(at, len(u) - 1)]
            best = e[:, 0] + self.a
            back = np.zeros((len(rows), width, len(STATES)), np.int8)
            final = best + self.z
            for i in range(1, width):
                step = best[:, :, None] + self.t[None]
                back[:, i] = step.argmax(1)
                best = np.where(on[:, i, None], step.max(1) + e[:, i], best)
                final = np.where((size - 1 == i)[:, None], best + self.z, final)
            tag = final.argmax(1)
            r = np.arange(len(rows))
            for i in range(width - 1, -1, -1):
                live = on[:, i]
                tags[at[live, i]] = tag[live]
                if i:
                    tag = np.where(live, back[r, i, tag], tag)
            a = b
        return tags


def _partial(t: Text, hint: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Tags that each clause may have, from clear cues; hint: rows said to be remarks only; cut: rows whose end was cut off."""
    x, nc = t.x, len(t.x)
    allowed = np.ones((nc, len(STATES)), bool)

    def only(rows: np.ndarray, *states: int) -> None:
        allowed[rows] = False
        for st in states:
            allowed[rows, st] = True

    refusal = (x[:, 1] > 0) & (x[:, 4] == 0)
    remark = (x[:, 2] > 0) & ~refusal & ((x[:, 3] > 0) | (x[:, 17] > 0.5))
    foreign = (x[:, 8] > 0.5) | ((x[:, 6] > 0.15) & (x[:, 6] > 1.5 * x[:, 7]))
    echo = (x[:, 5] > 0.8) & (t.words >= 6)
    plain = ~refusal & (x[:, 2] == 0) & (x[:, 3] == 0) & (t.words >= 8) & (x[:, 7] > 0.15) & (x[:, 17] < 0.5) & ~hint[t.own]
    last = x[:, 14] > 0
    allowed &= ~impossible(x, t.own)
    base = allowed.copy()
    only(plain, ANSWER)
    only(echo, ECHO)
    only(remark, REMARK)
    only(refusal, REFUSAL)
    only(foreign & ~refusal & ~remark, FOREIGN)
    only(last & cut[t.own], UNFINISHED)
    open_end = last & (x[:, 9] > 0) & ~cut[t.own]
    allowed[open_end] = base[open_end]
    return allowed


def _decline_counts(rew: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, rows, refusals) of each word: the rows it stands in, and those of them that are short and hold a cue of a refusal outside quotation marks.
    The hash 0 stands for all rows."""
    cps, starts = K.code_points(rew)
    low, _ = _fold(cps)
    s, e = K.runs((low > 0).astype(np.int64), starts)
    if not len(s):
        return np.zeros(1, np.uint64), np.array([len(rew)]), np.zeros(1, np.int64)
    h, row = K.span_hash(K.prefix(low), s, e), K.owner(s, starts)
    marks = np.bincount(K.owner(np.flatnonzero(np.isin(cps, [34, 0x201C, 0x201D])), starts), minlength=len(rew)) > 0
    flag = np.bincount(row, weights=_phrase_hits(h, row, _lexicon()["refusal"], marks[row]), minlength=len(rew)) > 0
    flag &= np.bincount(row, minlength=len(rew)) <= SHORT
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    once = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
    u, inv, n = np.unique(h[once], return_inverse=True, return_counts=True)
    f = np.bincount(inv, weights=flag[row[once]]).astype(np.int64)
    return np.append(u, np.uint64(0)), np.append(n, len(rew)), np.append(f, flag.sum())


def _decline_odds(u: np.ndarray, n: np.ndarray, f: np.ndarray, rows: int, refusals: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log odds) of words of refusals from their counts."""
    order = np.argsort(u)
    u, n, f = u[order], n[order], f[order]
    odds = np.log(((f + 0.5) / (refusals + 1)) / ((n - f + 0.5) / (rows - refusals + 1)))
    return u, np.clip(odds, 0, 3)


def _sentence_ends(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, keys of it alone, with the word before and the two before, whether it ends a sentence)."""
    cps, starts = K.code_points(col)
    low, _ = _fold(cps)
    s, e = K.runs((low > 0).astype(np.int64), starts)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 3), np.uint64), np.zeros(0, bool)
    h = K.span_hash(K.prefix(low), s, e)
    row = K.owner(s, starts)
    c = np.append(cps, [0, 0])
    final = (c[e] == 46) & ((c[np.minimum(e + 1, len(cps))] == 32) | (c[np.minimum(e + 1, len(cps))] == 10) | (e + 1 >= starts[row + 1]))
    new = np.append(True, final[:-1] | (row[1:] != row[:-1]))
    keys = np.stack(_end_keys(cps, s, h, np.cumsum(new) - 1, np.flatnonzero(new), low), 1)
    keys[np.append(row[1:] != row[:-1], True) & ~final] = 0  # the last word of an open end says nothing
    return h, row, keys, final


def _counted(values: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each of the sorted `known` stands in `values`, and that weighted, as columns."""
    if not len(known) or not len(values):
        return np.zeros((len(known), 2))
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    hit = known[i] == values
    return np.stack([np.bincount(i[hit], minlength=len(known)), np.bincount(i[hit], weights=weight[hit], minlength=len(known))], 1)


def word_tables(pairs: DataFrame, src: pa.Array, rew: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(talk, ends, declines): sorted hashes and log odds, counted over all rows (src, rew, hint) in one pass.

    talk: of words in hinted remarks. ends: that a word, a pair or a triple ends a sentence. Both of the words that the
    training sample (src, rew) holds, as only those have a weight. declines: of words that stand in three short refusals or more.
    """
    (_, _, k1, _), (h2, _, k2, _) = _sentence_ends(src), _sentence_ends(rew)
    words, keys = np.unique(h2), np.unique(np.concatenate([k1.ravel(), k2.ravel()]))
    blob = pickle.dumps((words, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys = pickle.loads(blob)
        talk, ends, places = np.zeros((len(words), 2)), np.zeros((len(keys), 2)), np.zeros(2)
        for batch in batches:
            hint = batch.column("hint").to_numpy(zero_copy_only=False).astype(bool)
            enc = K.as_array(batch.column("src")).dictionary_encode()
            times = np.bincount(enc.indices.to_numpy(zero_copy_only=False), minlength=len(enc.dictionary))
            prompts = enc.dictionary.cast(pa.large_string())
            for a, b in K.chunks(prompts, 1 << 18):
                _, row, k, final = _sentence_ends(prompts.slice(a, b - a))
                t = times[a:b][row].astype(float)
                i = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
                hit = keys[i] == k if len(keys) else np.zeros(k.shape, bool)
                w = np.repeat(t[:, None], 3, 1)
                ends[:, 0] += np.bincount(i[hit], w[hit], len(keys))
                ends[:, 1] += np.bincount(i[hit], (w * final[:, None])[hit], len(keys))
            for a, b in K.chunks(batch.column("rew"), 1 << 18):
                col = batch.column("rew").slice(a, b - a)
                h, row, k, final = _sentence_ends(col)
                talk += _counted(h, words, hint[a:b][row].astype(float))
                ends += _counted(k.ravel(), keys, np.repeat(final, 3).astype(float))
                places += [len(h), hint[a:b][row].sum()]
                u, n, f = _decline_counts(col)
                yield _stats(0, u, np.stack([n, f], 1))
        yield _stats(1, np.arange(len(words)), talk)
        yield _stats(2, np.arange(len(keys)), ends)
        yield _stats(3, np.zeros(1, np.int64), places[None])

    rows = pairs.where("rew is not null").select("src", "rew", F.coalesce(F.col("hint").cast("boolean"), F.lit(False)).alias("hint"))
    counts = rows.mapInArrow(run, "kind int, h long, n long, f long").groupBy("kind", "h").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    got = counts.where("kind > 0 or f >= 3 or h = 0").toPandas()  # the sample's words, and those of refusals
    part = [got[got.kind == k].sort_values("h") for k in range(4)]
    d, t, e, total = ([x[c].to_numpy(np.int64) for c in ("h", "n", "f")] for x in part)
    u, w = d[0].view(np.uint64), d[0] != 0
    declines = _decline_odds(u[w], d[1][w], d[2][w], int(d[1][~w].sum()), int(d[2][~w].sum())) if w.any() else _NO_TABLE
    places, hinted = int(total[1].sum()), int(total[2].sum())
    keep = t[1] >= 4
    odds = np.log(((t[2] + 0.5) / (max(hinted, 1) + 1)) / ((t[1] - t[2] + 0.5) / (max(places - hinted, 1) + 1)))
    talk = (words[t[0][keep]], np.clip(odds[keep], -3, 3))
    keep = (e[1] >= 3) & (keys[e[0]] != 0)
    ends = (keys[e[0][keep]], np.clip(np.log((e[2][keep] + 0.2) / (e[1][keep] - e[2][keep] + 0.2)), -5, 5))
    return talk, ends, declines


def _stats(kind: int, h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    some = counts[:, 0] > 0
    n = counts[some].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind), pa.int32()), pa.array(h[some].astype(np.uint64).view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["kind", "h", "n", "f"])


@dataclass
class Model:
    field: Field
    talk: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    declines: tuple[np.ndarray, np.ndarray] = _NO_TABLE


def fit(pairs: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most `sample` rows (src, rew, hint) of `pairs`, those of least hash of row_id, and word statistics of all rows."""
    rows = least_hashed(pairs.where("rew is not null and src is not null"), "row_id", sample).select("src", "rew", "hint").toPandas()
    src, rew = [str(x) for x in rows["src"]], [str(x) for x in rows["rew"]]
    hint = np.array([x is True or x == 1 for x in rows["hint"]], bool)
    if not len(rows):
        return Model(Field(len(NAMES)), (np.zeros(0, np.uint64), np.zeros(0)), (np.zeros(0, np.uint64), np.zeros(0)))
    talk, ends, declines = word_tables(pairs, pa.array(src, pa.large_string()), pa.array(rew, pa.large_string()))
    rng = np.random.default_rng(5)
    cut = np.zeros(2 * len(rew), bool)
    more = []
    for i, t in enumerate(rew):  # of each row a copy with its last sentence cut off, or with only its full stop gone
        body = t.rstrip().rstrip(".!?")
        begin = max(body.rfind(". "), body.rfind("\n")) + 1
        if len(body) - begin > 30 and t.isascii():
            if rng.random() < 0.6:
                at = int(rng.integers(begin + 8, len(body) - 3))
                more.append(body[:at].rstrip() + rng.choice(["", "", "", "", "…", "...", "-", "—"]))
                cut[len(rew) + i] = True
            else:
                more.append(body)
        else:
            more.append(t)
    t = analyse(pa.array(src + src, pa.large_string()), pa.array(rew + more, pa.large_string()), talk, ends, declines)
    allowed = _partial(t, np.concatenate([hint, hint]), cut)
    # a copy that lost its full stop alone is finished
    bare = np.zeros(len(cut), bool)
    bare[len(rew) :] = ~cut[len(rew) :]
    rows_bare = bare[t.own] & (t.x[:, 9] > 0)
    allowed[rows_bare, UNFINISHED] = False
    field = Field(len(NAMES))
    # rows with a clear rare tag count more, as they are few
    rare = allowed[:, [REFUSAL, REMARK, FOREIGN]].any(1) & ~allowed[:, ANSWER]
    field.train(t.x, allowed, t.first, 1.0 + 7.0 * (np.bincount(t.own[rare], minlength=t.rows) > 0))
    return Model(field, talk, ends, declines)


DEFECTS = ("empty", "truncated", "refusal", "copy", "language", "commentary")


def judge(model: Model, src: pa.Array, rew: pa.Array) -> tuple[np.ndarray, Text, np.ndarray]:
    """(defect of each row as an index into DEFECTS or -1, the analysed texts, rows with template residue)."""
    t = analyse(src, rew, model.talk, model.ends, model.declines)
    tags = model.field.decode(t)
    part = np.stack([np.bincount(t.own[tags == k], weights=t.weight[tags == k], minlength=t.rows) for k in range(len(STATES))], 1) if len(tags) else np.zeros((t.rows, len(STATES)))
    total = np.maximum(part.sum(1), 1)
    answer = part[:, ANSWER] + part[:, ECHO] + part[:, UNFINISHED]
    out = np.full(t.rows, -1)
    has = t.first[1:] > t.first[:-1]
    last = np.zeros(t.rows, np.int64)
    last[has] = tags[t.first[1:][has] - 1]
    out[(last == UNFINISHED) & has] = 1
    out[(part[:, REMARK] > 0) & (answer <= 0.4 * total)] = 5
    out[(part[:, REFUSAL] > 0) & ((answer <= 0.4 * total) | (answer < 60))] = 2
    out[(part[:, FOREIGN] > 0) & (part[:, FOREIGN] >= 0.6 * (part[:, FOREIGN] + answer))] = 4
    out[t.copied >= COPIED] = 3
    out[(t.letters == 0) | t.standin] = 0
    residue = np.zeros(t.rows, bool)
    residue[[r for r, _, _ in findings(rew)]] = True
    out[residue] = -1
    return out, t, residue


def prose(rew: pa.Array) -> np.ndarray:
    """Texts that are mainly English prose: no residue, and clauses with the cues of refusals or remarks, and foreign ones, are the lesser part."""
    t = analyse(pa.array([""] * len(rew), pa.large_string()), rew, _NO_TABLE, _NO_TABLE)
    talk = ((t.x[:, 1] > 0) & (t.x[:, 4] == 0)) | (t.x[:, 2] > 0) | (t.x[:, 3] > 0)
    foreign = (t.x[:, 8] > 0.2) | ((t.x[:, 6] > 0.08) & (t.x[:, 6] > t.x[:, 7]))
    part = lambda rows: np.bincount(t.own[rows], weights=t.weight[rows], minlength=t.rows)
    sound = part(~talk & ~foreign)
    out = (sound > part(talk)) & (sound >= part(foreign))
    out[[r for r, _, _ in findings(rew)]] = False
    return out


def _pairs(scored: DataFrame) -> DataFrame:
    return scored.where("row_id is not null").select(F.col("row_id").cast("long").alias("row_id"), F.col("src").cast("string").alias("src"), F.col("rew").cast("string").alias("rew"), F.col("pure_commentary").alias("hint"))


def defects(pairs: DataFrame, model: Model) -> DataFrame:
    """(row_id, defect) of the broken pairs of (row_id, src, rew).

    A null, blank or invisible response is `empty`; a null prompt is one that nothing echoes. One defect a
    row, the first of empty, copy, language, refusal, commentary, truncated. Rows with template residue are
    left to that operator. Repeated rows each count; other columns are ignored.
    """
    blob = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob)
        for batch in batches:
            src, rew = batch.column("src"), batch.column("rew")
            ids, kinds_ = [], []
            for a, b in K.chunks(rew, 1 << 19):
                out, _, _ = judge(m, src.slice(a, b - a), rew.slice(a, b - a))
                hit = np.flatnonzero(out >= 0)
                ids.append(hit + a)
                kinds_ += [DEFECTS[k] for k in out[hit]]
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(np.concatenate(ids))), pa.array(kinds_, pa.string())], ["row_id", "defect"])

    return pairs.select("row_id", "src", "rew").mapInArrow(run, "row_id long, defect string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark.read.parquet(f"{sf_dir}/scored.parquet"))
    return defects(pairs, fit(pairs))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and share of broken rows of each system and defect."""
    scored = spark.read.parquet(f"{sf_dir}/scored.parquet")
    pairs = _pairs(scored)
    found = defects(pairs, fit(pairs))
    n = scored.where("row_id is not null").groupBy("tag").agg(F.count("*").alias("n_rows"))
    per = scored.select("row_id", "tag").join(found, "row_id").groupBy("tag", "defect").agg(F.count("*").alias("n"))
    return per.join(n, per.tag.eqNullSafe(n.tag)).select(per.tag, "defect", "n", F.round(F.col("n") / F.col("n_rows"), 6).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
