"""Segmentation and cleaning: folds over sentences, lines and blocks, all inside the optimiser's expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import text as T


def split_snippets(df: DataFrame, text: str, key: str, low: int = 150, high: int = 300, slack: int = 320) -> DataFrame:
    """(key, pos, snippet): passages of about `low` to `high` words packed from sentences.

    A text of at most `high` words is one passage, or none below `low`. Otherwise sentences (cut after . or ;)
    are gathered; a gathering of low..slack words is emitted; one that overshoots `slack` with two sentences
    or more emits its first `high` words and goes on with the last sentence, so passages may overlap. A rest of
    `low` words or more is emitted. Null and empty texts give none.
    """
    state = "struct<out:array<string>,cur:array<string>,w:int>"
    empty = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        n = F.size(T.words(s))
        cur = F.concat(a["cur"], F.array(s))
        w = a["w"] + n
        joined = F.array_join(cur, " ")
        over = (w > slack) & (F.size(cur) >= 2)
        cut = T.first_words(joined, high)
        cut_ok = F.size(T.words(cut)) > low
        make = lambda out, c, k: F.struct(out.alias("out"), c.alias("cur"), k.cast("int").alias("w"))
        return F.when((w >= low) & (w <= slack), make(F.concat(a["out"], F.array(joined)), empty, F.lit(0))).when(over, make(F.when(cut_ok, F.concat(a["out"], F.array(cut))).otherwise(a["out"]), F.array(s), n)).otherwise(make(a["out"], cur, w)).cast(state)

    def finish(a: Column) -> Column:
        return F.when(a["w"] >= low, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"])

    t = T._text(text)
    sents = F.filter(F.transform(F.split(t, r"(?<=[.;])" + T.WS), T.strip), lambda s: s != "")
    first = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0).alias("w")).cast(state)
    packed = F.aggregate(sents, first, step, finish)
    n = T.word_count(text)
    parts = F.when(n > high, packed).when(n >= low, F.array(T.strip(t))).otherwise(empty)
    return df.select(key, F.posexplode(parts).alias("pos", "snippet"))


def pack_passages(df: DataFrame, text: str, keys: list[str], low: int = 120, high: int = 450) -> DataFrame:
    """(keys, pos, passage): lines merged greedily into passages.

    A gathering of `low` words or more is emitted before a line that would take it over `high`; a rest of `low`
    words or more is emitted. Blank lines count nothing.
    """
    state = "struct<out:array<string>,cur:array<string>,w:int>"
    empty = F.array().cast("array<string>")

    def step(a: Column, line: Column) -> Column:
        n = F.size(T.words(line))
        flush = (a["w"] + n > high) & (a["w"] >= low)
        out = F.when(flush, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"])
        cur = F.when(flush, F.array(line)).otherwise(F.concat(a["cur"], F.array(line)))
        return F.struct(out.alias("out"), cur.alias("cur"), (F.when(flush, 0).otherwise(a["w"]) + n).cast("int").alias("w")).cast(state)

    lines = F.filter(F.transform(F.split(T._text(text), "\n"), lambda x: F.array_join(T.words(x), " ")), lambda x: x != "")
    first = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0).alias("w")).cast(state)
    parts = F.aggregate(lines, first, step, lambda a: F.when(a["w"] >= low, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"]))
    return df.select(*keys, F.posexplode(parts).alias("pos", "passage"))


def paragraphs(df: DataFrame, html: str, keys: list[str], least: int = 60) -> DataFrame:
    """(keys, pos, paragraph): texts of the <p> elements, or of the lines where there are none; short ones and head boilerplate dropped."""
    t = T._text(html)
    ps = F.regexp_extract_all(t, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    lines = F.split(F.regexp_replace(t, "<[^>]+>", " "), "\n")
    parts = F.transform(F.when(F.size(ps) > 0, ps).otherwise(lines), T.clean_text)
    return df.select(*keys, F.posexplode(F.filter(parts, lambda p: (F.length(p) >= least) & ~p.rlike(C.HEADER_PATTERN))).alias("pos", "paragraph"))


def clean_output(df: DataFrame, text: str, least: int = 8) -> DataFrame:
    """Adds `cleaned` and `removed`: the text without leading commentary.

    Blocks stand between blank lines. Until the first block that is kept, a label line is stripped (the block is
    dropped if fewer than `least` words remain), a block that opens with commentary is dropped, and after one so are
    short list items. All later blocks are kept and joined by spaces; below `least` words in all nothing is left.
    """
    lead = "(?i)(" + "|".join(C.LEAD_PHRASES) + ")"
    label = r"(?i)^\*{0,2}(?:" + "|".join(C.LABELS) + r")\s*[:.\-]?\s*\*{0,2}\s*$"
    state = "struct<kept:array<string>,started:boolean,preamble:boolean,removed:boolean>"

    def step(a: Column, block: Column) -> Column:
        lines = F.split(block, "\n")
        labelled = (F.size(lines) > 1) & T.strip(lines[0]).rlike(label)
        body = F.when(labelled, T.strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), " "))).otherwise(block)
        n = F.size(T.words(body))
        fragment = labelled & (n < least)
        meta = F.substring(body, 1, 150).rlike(lead)
        item = body.rlike(r"^(?:[-*•]|\d+[.)])") & (n < 30) & ~body.rlike(r"[.!?]\s+[A-Z]")
        drop = ~a["started"] & (fragment | meta | (a["preamble"] & item))
        keep = F.when(a["started"], block).otherwise(body)
        return F.struct(
            F.when(drop, a["kept"]).otherwise(F.concat(a["kept"], F.array(keep))).alias("kept"),
            (a["started"] | ~drop).alias("started"),
            (a["preamble"] | (~a["started"] & ~fragment & meta)).alias("preamble"),
            (a["removed"] | (~a["started"] & (labelled | drop))).alias("removed"),
        ).cast(state)

    blocks = F.filter(F.transform(F.split(T._text(text), r"\n\s*\n"), T.strip), lambda b: b != "")
    first = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("started"), F.lit(False).alias("preamble"), F.lit(False).alias("removed")).cast(state)
    df = df.withColumn("_fold", F.aggregate(blocks, first, step)).withColumn("_joined", F.array_join("_fold.kept", " "))
    short = T.word_count("_joined") < least
    return df.withColumns({"cleaned": F.when(short, "").otherwise(F.col("_joined")), "removed": F.col("_fold.removed") | (short & (F.size(blocks) > 0))}).drop("_fold", "_joined")


def parse_scores(df: DataFrame, raw: str, keys: tuple[str, ...]) -> DataFrame:
    """Adds one double column per key from a judge's reply.

    The first flat JSON object that has a number for every key counts; else the first number after each key word,
    if all keys have one; else null.
    """
    t = T._text(raw)
    objects = F.regexp_extract_all(t, F.lit(r"\{[^{}]*\}"), F.lit(0))
    full = F.filter(objects, lambda o: _all([F.get_json_object(o, f"$.{k}").try_cast("double").isNotNull() for k in keys]))
    df = df.withColumn("_o", F.try_element_at(full, F.lit(1)))
    found = {k: F.nullif(F.regexp_extract(t, rf"(?i){k}[\"']?[ \t\n\x0B\f\r]*[:：][ \t\n\x0B\f\r]*([0-9.]+)", 1), F.lit("")).try_cast("double") for k in keys}
    every = _all([c.isNotNull() for c in found.values()])
    return df.withColumns({k: F.when(F.col("_o").isNotNull(), F.get_json_object("_o", f"$.{k}").try_cast("double")).when(every, found[k]) for k in keys}).drop("_o")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def lexical_simplify(df: DataFrame, src: str, lv: str, terms: str, definitions: str) -> DataFrame:
    """Adds `simplified`: the rule baseline for a source at a level; null for an unknown level.

    Sentences become clauses at the breaks, tried in order on clauses that are too long (not for advanced);
    clauses are cut to the level's words, joined into sentences, legal phrases become plain ones, and for
    beginners the first mention of each term gets its definition. Each stage is a column of its own.
    """
    level = F.col(lv)
    most, group = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in C.LEVELS:
        most = F.when(level == k, C.CLAUSE_WORDS[k]).otherwise(most)
        group = F.when(level == k, C.CLAUSES_JOINED[k]).otherwise(group)
    df = df.withColumns({"_most": most, "_group": group, "_c": T.sentences(src)})
    longest = F.when(level == "advanced", 1 << 30).otherwise(F.col("_most"))
    df = df.withColumn("_split", longest)
    for b in C.CLAUSE_BREAKS:
        pattern = "(?i)\\Q" + b + "\\E"
        df = df.withColumn("_c", F.flatten(F.transform("_c", lambda c, p=pattern: F.when(F.size(T.words(c)) > F.col("_split"), F.split(c, p)).otherwise(F.array(c)))))
    df = df.withColumn("_c", F.transform("_c", lambda c: F.when(F.size(T.words(c)) > F.col("_most"), F.array_join(F.slice(T.words(c), 1, F.col("_most")), " ")).otherwise(c)))
    starts = F.when(F.size("_c") > 0, F.sequence(F.lit(1), F.size("_c"), F.col("_group"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_j", F.transform(starts, lambda i: T.strip(F.array_join(F.slice("_c", i, F.col("_group")), " "))))
    text = F.array_join(F.transform("_j", lambda s: F.when((s == "") | s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))), " ")
    for a, b in C.PLAIN_WORDS:
        text = F.regexp_replace(text, rf"(?i)\b{a}\b", b)
    df = df.withColumn("_text", text)

    def gloss(acc: Column, t: Column) -> Column:
        note = F.trim(F.coalesce(F.try_element_at(F.col(definitions), t), F.lit("")))
        at = F.regexp_instr(acc, F.concat(F.lit("(?i)(?<!\\w)\\Q"), t, F.lit("\\E(?!\\w)")))
        return F.when((note == "") | (at == 0), acc).otherwise(F.concat(F.substring(acc, F.lit(1), at - 1), t, F.lit(" ("), note, F.lit(")"), F.substring(acc, at + F.length(t), F.lit(1 << 30))))

    # each gloss goes in once, at the first whole-word mention; the terms are those present before any gloss
    df = df.withColumn("_there", F.filter(F.col(terms), lambda t: F.contains(F.lower("_text"), t)))
    out = T.strip(F.when(level == "beginner", F.aggregate("_there", F.col("_text"), gloss)).otherwise(F.col("_text")))
    return df.withColumn("simplified", F.when(F.col("_most").isNotNull(), out)).drop("_most", "_group", "_c", "_split", "_j", "_text", "_there")
