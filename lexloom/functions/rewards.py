"""Row measures of a rewrite against its source, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import text as T


def _count_in(low: Column, phrases: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p)))


def format_score(rew: Column | str, src: Column | str) -> Column:
    """Format: 0 below five words, else 1 less what betrays commentary or a length far from the source's."""
    low = F.lower(T._text(rew))
    n, m = T.word_count(rew), T.word_count(src)
    hits = _count_in(low, C.META_PHRASES)
    r = F.lit(1.0) - F.when(_count_in(low, C.THINK_MARKERS) > 0, 0.5).otherwise(0.0)
    r = r - F.when(F.contains(F.substring(low, 1, 60), F.lit("rewrite the following")), 0.3).otherwise(0.0)
    r = r - F.least(F.lit(0.6), 0.3 * hits) - F.when(F.abs(n - m) > 0.9 * m, 0.3).otherwise(0.0)
    return F.when(n < 5, 0.0).otherwise(T.clamp(r))


def difficulty_score(ease: Column, lv: Column | str) -> Column:
    """1 at the level's reading ease, 0 from 20 points away; null for an unknown level."""
    target = T.level_target(lv)
    return F.when(target.isNotNull() & ease.isNotNull(), T.clamp(1 - F.abs(ease - target) / 20))


def present_terms(text: Column | str, terms: Column) -> Column:
    low = F.lower(T._text(text))
    return F.filter(terms, lambda t: F.contains(low, t))


def term_score(rew: Column | str, src: Column | str, terms: Column) -> Column:
    """Share of the source's terms that the rewrite keeps; 1 without terms."""
    there = present_terms(src, terms)
    low = F.lower(T._text(rew))
    return F.coalesce(F.try_divide(F.size(F.filter(there, lambda t: F.contains(low, t))), F.size(there).cast("double")), F.lit(1.0))


def with_copy_score(df: DataFrame, rew: str, src: str, name: str) -> DataFrame:
    """Adds the copy score: 1 up to an overlap of 0.4 of the source's word triples, 0 from 0.8; 0.5 for texts below eight words.

    Tokens and triples are columns of their own, so that each is computed once a row.
    """
    df = df.withColumns({"_r": T.lower_tokens(rew), "_s": T.lower_tokens(src)})
    df = df.withColumns({"_a": F.array_distinct(T.ngrams(F.col("_r"), 3)), "_b": F.array_distinct(T.ngrams(F.col("_s"), 3))})
    df = df.withColumn("_overlap", F.try_divide(F.size(F.array_intersect("_a", "_b")), F.size("_b").cast("double")))
    score = F.when((F.size("_r") < 8) | (F.size("_s") < 8), 0.5).otherwise(F.coalesce(T.clamp(1 - F.greatest(F.lit(0.0), (F.col("_overlap") - 0.4) / 0.4)), F.lit(1.0)))
    return df.withColumn(name, score).drop("_r", "_s", "_a", "_b", "_overlap")


def total_reward(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for k, w in C.WEIGHTS.items():
        out = out + w * parts[k]
    return out


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    f1 = F.try_divide(2 * both, F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))
    return F.coalesce(f1, F.lit(1.0))


def with_ngrams(df: DataFrame, *sides: str) -> DataFrame:
    """Adds the distinct n-grams 1..4 of the word arrays `sides` as columns of their own, so that each is computed once a row."""
    return df.withColumns({f"{x}{n}": F.array_distinct(T.ngrams(F.col(x), n)) for x in sides for n in range(1, 5)})


def simplification(out: str, ref: str, src: str) -> Column:
    """Mean over n = 1..4 of the F1 of n-grams added, kept and deleted (cased), from the columns of `with_ngrams`."""
    total = F.lit(0.0)
    for n in range(1, 5):
        o, r, s = (F.col(f"{x}{n}") for x in (out, ref, src))
        total = total + set_f1(F.array_except(o, s), F.array_except(r, s))
        total = total + set_f1(F.array_intersect(o, s), F.array_intersect(r, s))
        total = total + set_f1(F.array_except(s, o), F.array_except(s, r))
    return total / 12


def contradiction(nli: Column | str) -> Column:
    """Contradiction probability of a JSON list [entail, neutral, contra] or object; null without one."""
    c = F.col(nli) if isinstance(nli, str) else nli
    return F.coalesce(F.get_json_object(c, "$.contra"), F.get_json_object(c, "$[2]")).try_cast("double")


def nli_part(nli: Column | str, name: str) -> Column:
    c = F.col(nli) if isinstance(nli, str) else nli
    at = ("entail", "neutral", "contra").index(name)
    return F.coalesce(F.get_json_object(c, f"$.{name}"), F.get_json_object(c, f"$[{at}]")).try_cast("double")


def gate_notes(faith: Column, diff: Column, term: Column, fmt: Column, ease: Column, lv: Column | str, missing: Column) -> Column:
    """Notes of the quality gate joined by '; ' (empty: passed). Reading ease above the target is too easy."""
    n = C.GATE_NOTES
    direction = F.when(ease > T.level_target(lv), n["easy"]).otherwise(n["hard"])
    notes = F.array(
        F.when(faith < C.GATE["faith"], n["faith"]),
        F.when(diff < C.GATE["diff"], direction),
        F.when((term < C.GATE["term"]) & (F.size(missing) > 0), F.concat(F.lit(n["term"]), F.array_join(F.slice(missing, 1, 6), ", "))),
        F.when(fmt < C.GATE["fmt"], n["fmt"]),
    )
    return F.array_join(F.array_compact(notes), "; ")
