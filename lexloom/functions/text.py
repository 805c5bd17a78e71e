"""Text measures as Column expressions; null text reads as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import config as C

WS = r"[ \t\n\x0B\f\r]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_text(c), WS), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(_text(c), F.lit("[A-Za-z']+"), F.lit(0))


def lower_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z']+"), F.lit(0))


def sentences(c: Column | str) -> Column:
    """Trimmed pieces after . ! ? and white space; empty ones dropped."""
    return F.filter(F.transform(F.split(_text(c), r"(?<=[.!?])" + WS), strip), lambda s: s != "")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{WS}|{WS}$", "")


def sentence_count(c: Column | str) -> Column:
    """The most of: runs of . ! ?, lines that are not blank, one."""
    lines = F.size(F.filter(F.split(_text(c), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    return F.greatest(F.regexp_count(_text(c), F.lit("[.!?]+")), lines, F.lit(1))


def syllables(w: Column) -> Column:
    """Vowel runs less a final e, at least one; short words have one."""
    runs = F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), runs))


def syllable_count(token_array: Column) -> Column:
    return F.aggregate(token_array, F.lit(0), lambda a, w: a + syllables(w))


def flesch(c: Column | str) -> Column:
    """Reading ease; 0 without words."""
    n = F.size(tokens(c)).cast("double")
    ease = 206.835 - 1.015 * F.try_divide(n, sentence_count(c)) - 84.6 * F.try_divide(syllable_count(lower_tokens(c)), n)
    return F.coalesce(ease, F.lit(0.0))


def ngrams(arr: Column, n: int) -> Column:
    """Consecutive n words joined by a space; none where there are fewer."""
    grams = F.transform(F.sequence(F.lit(1), F.size(arr) - (n - 1)), lambda i: F.array_join(F.slice(arr, i, n), " "))
    return F.when(F.size(arr) >= n, grams).otherwise(F.array().cast("array<string>"))


def level_target(lv: Column | str) -> Column:
    c = F.col(lv) if isinstance(lv, str) else lv
    out = F.lit(None).cast("double")
    for k, v in C.TARGETS.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clean_text(c: Column | str) -> Column:
    """Tags replaced by spaces, white space collapsed, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(_text(c), "<[^>]+>", " "), WS, " "))


def first_words(c: Column | str, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def text_without_chrome(html: Column | str) -> Column:
    """Text of a page without its script, style, nav, header and footer elements."""
    out = _text(html)
    for tag in ("script", "style", "nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return clean_text(out)


def main_text(html: Column | str, element: str = "article") -> Column:
    """Text of the first element of that name; empty without one."""
    return clean_text(F.regexp_extract(_text(html), rf"(?is)<{element}\b[^>]*>(.*?)</{element}>", 1))


def page_title(html: Column | str, default: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(_text(html), r"(?is)<title>(.*?)</title>", 1)), F.lit("")), default)


def body_window(c: Column | str, start: str, ends: list[str]) -> Column:
    """Text after the first `start`, cut before each end marker in turn where it stands beyond the first character; empty without `start`."""
    t = _text(c)
    body = F.when(F.instr(t, start) > 0, F.substring(t, F.instr(t, start) + len(start), F.lit(1 << 30))).otherwise("")
    return strip(trim_tail(body, ends))


def trim_tail(c: Column, markers: list[str]) -> Column:
    for m in markers:
        c = F.when(F.instr(c, m) > 1, F.substring(c, F.lit(1), F.instr(c, m) - 1)).otherwise(c)
    return c


def strip_preamble(c: Column | str, markers: list[str]) -> Column:
    """Text after the first blank line that follows the first marker found (in the order given); the whole text if nothing is left."""
    t = _text(c)
    out = t
    for m in reversed(markers):
        at = F.instr(F.lower(t), m)
        rest = F.substring(t, at, F.lit(1 << 30))
        gap = F.instr(rest, "\n\n")
        kept = F.when(gap > 0, strip(F.substring(rest, gap + 2, F.lit(1 << 30)))).otherwise("")
        out = F.when(at > 0, F.coalesce(F.nullif(kept, F.lit("")), t)).otherwise(out)
    return out
