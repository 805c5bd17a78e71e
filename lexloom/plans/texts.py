"""Queries: text cleaning, segmentation, tokenisation and row measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import rewards as R
from lexloom.functions import text as T
from lexloom.operators import segment
from lexloom.plans import kit as K


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as web pages: title, navigation, script and footer around the text."""
    html = F.concat(F.lit("<html><head><title> "), F.coalesce("source", F.lit("")), F.lit(" </title><style>p {x:y}</style></head><body><nav>home | next</nav><script>var a=1;</script><article class=\"t\"><p>"), F.coalesce("text", F.lit("")), F.lit("</p></article><footer>end of page</footer></body></html>"))
    return _docs(spark, d).select("doc_id", html.alias("html"))


_PAGES = "pages as (select doc_id, '<html><head><title> ' || coalesce(source, '') || ' </title><style>p {x:y}</style></head><body><nav>home | next</nav><script>var a=1;</script><article class=\"t\"><p>' || coalesce(text, '') || '</p></article><footer>end of page</footer></body></html>' as html from documents)"
_CLEAN = lambda c: K.q_strip(f"regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{K.WS}', ' ', 'g')")


def readability_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Reading ease by language and asked level, with subtotals: the flagship query."""
    rows = _docs(spark, d).where("text is not null").select(F.lower(F.coalesce("lang", F.lit("?"))).alias("lang"), F.element_at(F.array(*[F.lit(x) for x in C.LEVELS]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("lv"), T.flesch("text").alias("fre"))
    near = F.avg((F.abs(F.col("fre") - T.level_target("lv")) <= 10).cast("double"))
    return rows.rollup("lang", "lv").agg(F.count("*").alias("n"), F.round(F.avg("fre"), 9).alias("fre_mean"), F.round(F.median("fre"), 9).alias("fre_median"), F.round(F.stddev_pop("fre"), 9).alias("fre_std"), F.round(near, 9).alias("in_band"))


_READABILITY = f"""
with r as (select lower(coalesce(lang, '?')) as lang, {K.q_list(list(C.LEVELS))}[(doc_id % 3) + 1] as lv, {K.q_flesch('text')} as fre from documents where text is not null)
select lang, lv, count(*) as n, round(avg(fre), 9) as fre_mean, round(median(fre), 9) as fre_median, round(stddev_pop(fre), 9) as fre_std, round(avg((abs(fre - {K.Q_TARGET}) <= 10)::int::double), 9) as in_band from r group by rollup (lang, lv)
"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", F.md5(T.clean_text("html").cast("binary")).alias("digest"), F.length(T.clean_text("html")).alias("n"))


def page_main_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", T.main_text("html").alias("body"))


def page_strip_chrome(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", T.text_without_chrome("html").alias("body"))


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", T.page_title("html", F.col("doc_id").cast("string")).alias("title"))


def body_window(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("top | next "), T.clean_text("text"), F.lit(" Notes on this page | next"))
    return _docs(spark, d).select("doc_id", T.body_window(text, "| next", ["Notes on", "court", "| next"]).alias("body"))


def _q_window(t: str, start: str, ends: list[str]) -> str:
    out = f"case when instr({t}, '{start}') > 0 then substr({t}, instr({t}, '{start}') + {len(start)}) else '' end"
    sql, prev = f"with w0 as (select doc_id, {out} as b from x)", "w0"
    for i, m in enumerate(ends, 1):
        sql += f", w{i} as (select doc_id, case when instr(b, '{m}') > 1 then substr(b, 1, instr(b, '{m}') - 1) else b end as b from {prev})"
        prev = f"w{i}"
    return sql + f" select doc_id, {K.q_strip('b')} as body from {prev}"


def first_n_words(spark: SparkSession, d: str) -> DataFrame:
    return K.snippets(spark, d).select("id", T.first_words("text", 120).alias("head"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return K.snippets(spark, d).select("id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(T.lower_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.word_count("text").alias("n_words"), T.sentence_count("text").alias("n_sentences"), F.size(T.tokens("text")).alias("n_tokens"), T.syllable_count(T.lower_tokens("text")).alias("n_syllables"))


def snippet_split(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 150 to 300 words packed from sentences."""
    return segment.split_snippets(_docs(spark, d), "text", "doc_id")


def passage_pack(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 120 to 450 words packed from the lines of the rewrites."""
    return segment.pack_passages(K.scored(spark, d, "rew"), "rew", ["tag", "id", "lv"])


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return segment.paragraphs(_pages(spark, d), "html", ["doc_id"])


def clean_output(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites without leading commentary, and whether anything was removed."""
    return segment.clean_output(K.scored(spark, d, "rew"), "rew").select("tag", "id", "lv", "cleaned", "removed")


def strip_preamble(spark: SparkSession, d: str) -> DataFrame:
    return K.scored(spark, d, "rew").select("tag", "id", "lv", T.strip_preamble("rew", ["drafting", "planning notes", "let me"]).alias("body"))


def _q_preamble(c: str, markers: list[str]) -> str:
    out = c
    for m in reversed(markers):
        rest = f"substr({c}, instr(lower({c}), '{m}'))"
        gap = f"instr({rest}, chr(10) || chr(10))"
        kept = f"case when {gap} > 0 then {K.q_strip(f'substr({rest}, {gap} + 2)')} else '' end"
        out = f"case when instr(lower({c}), '{m}') > 0 then coalesce(nullif({kept}, ''), {c}) else {out} end"
    return out


KEYS = ("difficulty", "faithfulness", "terminology", "fluency", "confidence")


def parse_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = K.table(spark, d, "judged").select("judge_id", "raw")
    return segment.parse_scores(rows, "raw", KEYS).select("judge_id", *KEYS)


def _q_parse() -> str:
    objects = "list_filter(regexp_extract_all(coalesce(raw, ''), '\\{[^{}]*\\}'), lambda o: case when json_valid(o) then " + " and ".join(f"try_cast(json_extract_string(o, '$.{k}') as double) is not null" for k in KEYS) + " else false end)"
    words = ", ".join(f"try_cast(nullif(regexp_extract(coalesce(raw, ''), '(?i){k}[\"'']?[ \\t\\n\\x0B\\f\\r]*[:：][ \\t\\n\\x0B\\f\\r]*([0-9.]+)', 1), '') as double) as w_{k}" for k in KEYS)
    every = " and ".join(f"w_{k} is not null" for k in KEYS)
    cols = ", ".join(f"case when o is not null then try_cast(json_extract_string(o, '$.{k}') as double) when {every} then w_{k} end as {k}" for k in KEYS)
    return f"with p as (select judge_id, {objects}[1] as o, {words} from judged) select judge_id, {cols} from p"


def lexical_simplify(spark: SparkSession, d: str) -> DataFrame:
    """Rule baseline: clauses cut at breaks, shortened, regrouped, plain words, glossed terms; per source and level."""
    src = K.scored(spark, d, "src").select("id", "src").distinct().where("src is not null")
    rows = K.with_terms(src.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in C.LEVELS], "lv string"))), spark, d)
    return segment.lexical_simplify(rows, "src", "lv", "terms", "definitions").select("id", "lv", "simplified")


def judge_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("Level: "), "lv", F.lit("\nSource:\n"), F.substring(F.coalesce("src", F.lit("")), 1, 3000), F.lit("\nRewrite:\n"), F.substring(F.coalesce("rew", F.lit("")), 1, 3000), F.lit("\nGive a JSON object with five scores."))
    return K.scored(spark, d, "src", "rew").select("tag", "id", "lv", p.alias("prompt"))


def flesch(spark: SparkSession, d: str) -> DataFrame:
    return K.scored(spark, d, "rew").select("tag", "id", "lv", F.round(T.flesch("rew"), 9).alias("fre"))


def rich_readability(spark: SparkSession, d: str) -> DataFrame:
    w = F.size(F.col("tok")).cast("double")
    rows = K.with_terms(K.scored(spark, d, "rew"), spark, d).select("tag", "id", "lv", T.tokens("rew").alias("tok"), T.lower_tokens("rew").alias("low"), T.sentence_count("rew").cast("double").alias("s"), F.size(R.present_terms("rew", F.col("terms"))).cast("double").alias("there"))
    hard = F.size(F.filter("low", lambda x: T.syllables(x) >= 3)).cast("double")
    rows = rows.withColumns({"w": w, "syl": T.syllable_count(F.col("low")).cast("double"), "hard": hard, "letters": F.aggregate("tok", F.lit(0), lambda a, x: a + F.length(x)).cast("double"), "kinds": F.size(F.array_distinct("low")).cast("double")})
    per = lambda c: F.coalesce(F.round(c, 9), F.lit(0.0))
    return rows.select(
        "tag", "id", "lv",
        per(0.39 * F.try_divide("w", "s") + 11.8 * F.try_divide("syl", "w") - 15.59).alias("grade"),
        per(0.4 * (F.try_divide("w", "s") + 100 * F.try_divide("hard", "w"))).alias("fog"),
        per(F.try_divide("letters", "w")).alias("word_length"), per(F.try_divide("kinds", "w")).alias("ttr"),
        per(F.when(F.col("w") > 0, F.try_divide("w", "s"))).alias("sentence_length"), per(F.try_divide("there", "w")).alias("term_density"),
    )


def _measures(spark: SparkSession, d: str) -> DataFrame:
    rows = K.with_terms(K.scored(spark, d, "src", "rew", "parts", "fre", "nli", "tot"), spark, d)
    rows = R.with_copy_score(rows.withColumn("ease", T.flesch("rew")), "rew", "src", "r_copy")
    return rows.withColumns({
        "r_fmt": R.format_score("rew", "src"), "r_diff": R.difficulty_score(F.col("ease"), "lv"),
        "r_term": R.term_score("rew", "src", F.col("terms")), "faith": R.nli_part("nli", "entail"),
    })


def _one(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _measures(spark, d).select("tag", "id", "lv", F.round(name, 9).alias(name))

    return query


def total_reward(spark: SparkSession, d: str) -> DataFrame:
    parts = {"fmt": F.col("r_fmt"), "diff": F.col("r_diff"), "term": F.col("r_term"), "copy": F.col("r_copy"), "faith": F.coalesce("faith", F.lit(0.0))}
    return _measures(spark, d).select("tag", "id", "lv", F.round(R.total_reward(parts), 9).alias("total"))


def gate_feedback(spark: SparkSession, d: str) -> DataFrame:
    rows = K.with_terms(K.scored(spark, d, "src", "rew", "parts", "fre"), spark, d)
    low = F.lower(T._text("rew"))
    missing = F.filter(R.present_terms("src", F.col("terms")), lambda t: ~F.contains(low, t))
    p = {k: F.coalesce(F.col(f"parts.{k}"), F.lit(0.0)) for k in C.PARTS}
    notes = R.gate_notes(p["faith"], p["diff"], p["term"], p["fmt"], F.coalesce("fre", F.lit(0.0)), "lv", missing)
    return rows.select("tag", "id", "lv", notes.alias("notes")).withColumn("passed", F.col("notes") == "")


def sari_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Simplification score of the rewrites of each system against those of the reference system."""
    from lexloom.plans.retrieve import _triples

    j = _triples(spark, d).select("tag", "id", "lv", T.words("rew").alias("o"), T.words("ref").alias("r"), T.words("src").alias("s"))
    return R.with_ngrams(j, "o", "r", "s").select("tag", "id", "lv", F.round(R.simplification("o", "r", "s"), 9).alias("sari"))


_TRIPLE = f"{K.Q_SCORED}, j as (select a.tag, a.id, a.lv, a.src, a.rew, b.rew as ref from s a join s b on a.id = b.id and a.lv = b.lv and a.tag <> '{C.REFERENCE}' and b.tag = '{C.REFERENCE}' where a.src is not null and a.rew is not null and b.rew is not null)"


def _q_sari() -> tuple[str, str]:
    """(n-grams g of word lists o, r and s of w; the score from them)."""
    cols, parts = [], []
    for n in range(1, 5):
        for x in "ors":
            cols.append(f"list_distinct({K.q_ngrams(x, n)}) as {x}{n}")
    for n in range(1, 5):
        o, r, s = f"o{n}", f"r{n}", f"s{n}"
        minus = lambda a, b: f"list_filter({a}, lambda g: not list_contains({b}, g))"
        parts += [K.q_set_f1(minus(o, s), minus(r, s)), K.q_set_f1(f"list_intersect({o}, {s})", f"list_intersect({r}, {s})"), K.q_set_f1(minus(s, o), minus(s, r))]
    return f"g as (select tag, id, lv, {', '.join(cols)} from w)", f"({' + '.join(parts)}) / 12"


_SARI_GRAMS, _SARI = _q_sari()
_S = f"with {K.Q_SCORED}"
_COPY = f"""with {K.Q_SCORED}, w as (select tag, id, lv, {K.q_lower_tokens('rew')} as r, {K.q_lower_tokens('src')} as s from s),
g as (select tag, id, lv, len(r) as nr, len(s) as ns, list_distinct({K.q_ngrams('r', 3)}) as a, list_distinct({K.q_ngrams('s', 3)}) as b from w)"""
_COPY_VALUE = f"case when nr < 8 or ns < 8 then 0.5::double else coalesce({K.q_clamp('1 - greatest(0::double, (len(list_intersect(a, b))::double / nullif(len(b), 0) - 0.4::double) / 0.4::double)')}, 1::double) end"
_FMT_VALUE = f"""case when len({K.q_words('rew')}) < 5 then 0::double else {K.q_clamp(f'''1::double
 - (case when list_bool_or(list_transform({K.q_list(C.THINK_MARKERS)}, lambda p: contains(lower(rew), p))) then 0.5::double else 0 end)
 - (case when contains(substr(lower(rew), 1, 60), 'rewrite the following') then 0.3::double else 0 end)
 - least(0.6::double, 0.3::double * len(list_filter({K.q_list(C.META_PHRASES)}, lambda p: contains(lower(rew), p))))
 - (case when abs(len({K.q_words('rew')}) - len({K.q_words('src')})) > 0.9::double * len({K.q_words('src')}) then 0.3::double else 0 end)''')} end"""
_DIFF_VALUE = f"case when {K.Q_TARGET} is not null then {K.q_clamp(f'1::double - abs({K.q_flesch(chr(114) + chr(101) + chr(119))} - {K.Q_TARGET}) / 20')} end"
_THERE = "list_filter(terms, lambda t: contains(lower(coalesce(src, '')), t))"
_TERM_VALUE = f"coalesce(len(list_filter({_THERE}, lambda t: contains(lower(coalesce(rew, '')), t)))::double / nullif(len({_THERE}), 0), 1::double)"
_NLI = lambda k, i: f"try_cast(case when json_valid(nli) then coalesce(json_extract_string(nli, '$.{k}'), json_extract_string(nli, '$[{i}]')) end as double)"

_MISSING = f"list_filter({_THERE}, lambda t: not contains(lower(coalesce(rew, '')), t))"
_NOTES = f"""array_to_string(list_filter([
 case when coalesce(parts.faith, 0) < 0.35 then {K.q_str(C.GATE_NOTES['faith'])} end,
 case when coalesce(parts.diff, 0) < 0.40 then (case when coalesce(fre, 0) > {K.Q_TARGET} then {K.q_str(C.GATE_NOTES['easy'])} else {K.q_str(C.GATE_NOTES['hard'])} end) end,
 case when coalesce(parts.term, 0) < 0.5 and len(missing) > 0 then {K.q_str(C.GATE_NOTES['term'])} || array_to_string(missing[1:6], ', ') end,
 case when coalesce(parts.fmt, 0) < 0.7 then {K.q_str(C.GATE_NOTES['fmt'])} end], lambda x: x is not null), '; ')"""

QUERIES = {
    "readability_rollup": readability_rollup, "clean_text": clean_text, "page_main_text": page_main_text, "page_strip_chrome": page_strip_chrome, "page_title": page_title, "body_window": body_window,
    "first_n_words": first_n_words, "sentence_split": sentence_split, "word_tokens": word_tokens, "text_counts": text_counts, "snippet_split": snippet_split, "passage_pack": passage_pack, "paragraphs": paragraphs,
    "clean_output": clean_output, "strip_preamble": strip_preamble, "parse_scores": parse_scores, "lexical_simplify": lexical_simplify, "judge_prompt": judge_prompt, "flesch": flesch, "rich_readability": rich_readability,
    "r_fmt": _one("r_fmt"), "r_diff": _one("r_diff"), "r_term": _one("r_term"), "r_copy": _one("r_copy"), "total_reward": total_reward, "gate_feedback": gate_feedback, "sari_sentence": sari_sentence,
}

SQL = {
    "readability_rollup": _READABILITY,
    "clean_text": f"with {_PAGES}, c as (select doc_id, {_CLEAN('html')} as t from pages) select doc_id, md5(t) as digest, length(t)::int as n from c",
    "page_main_text": f"with {_PAGES} select doc_id, {_CLEAN('''regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)''')} as body from pages",
    "page_strip_chrome": f"with {_PAGES} select doc_id, {_CLEAN('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<nav\\b.*?</nav>', ' ', 'g'), '(?is)<header\\b.*?</header>', ' ', 'g'), '(?is)<footer\\b.*?</footer>', ' ', 'g')''')} as body from pages",
    "page_title": f"with {_PAGES} select doc_id, coalesce(nullif({K.q_strip('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')}, ''), doc_id::varchar) as title from pages",
    "body_window": "with x as (select doc_id, 'top | next ' || " + _CLEAN("coalesce(text, '')") + " || ' Notes on this page | next' as t from documents), " + _q_window("t", "| next", ["Notes on", "court", "| next"]).removeprefix("with "),
    "first_n_words": f"with {K.Q_SNIPPETS} select id, array_to_string(({K.q_words('text')})[1:120], ' ') as head from sn",
    "sentence_split": f"with {K.Q_SNIPPETS}, x as (select id, {K.q_sentences('text')} as l from sn) select id, (unnest(range(len(l))))::int as pos, unnest(l) as sentence from x",
    "word_tokens": f"with x as (select unnest({K.q_lower_tokens('text')}) as token from documents) select token, count(*) as n from x group by token",
    "text_counts": f"select doc_id, len({K.q_words('text')})::int as n_words, {K.q_sentence_count('text')}::int as n_sentences, len({K.q_tokens('text')})::int as n_tokens, {K.q_syllable_count(K.q_lower_tokens('text'))}::int as n_syllables from documents",
    "strip_preamble": f"{_S}, x as (select tag, id, lv, coalesce(rew, '') as t from s) select tag, id, lv, {_q_preamble('t', ['drafting', 'planning notes', 'let me'])} as body from x",
    "parse_scores": _q_parse(),
    "judge_prompt": f"{_S} select tag, id, lv, 'Level: ' || lv || chr(10) || 'Source:' || chr(10) || substr(coalesce(src, ''), 1, 3000) || chr(10) || 'Rewrite:' || chr(10) || substr(coalesce(rew, ''), 1, 3000) || chr(10) || 'Give a JSON object with five scores.' as prompt from s",
    "flesch": f"{_S} select tag, id, lv, round({K.q_flesch('rew')}, 9) as fre from s",
    "rich_readability": f"""with {K.Q_SCORED}, {K.Q_TERMS}, b as (select tag, id, lv, {K.q_tokens('rew')} as tok, {K.q_lower_tokens('rew')} as low, {K.q_sentence_count('rew')}::double as n, len(list_filter(terms, lambda t: contains(lower(coalesce(rew, '')), t)))::double as there from s, ta),
m as (select *, nullif(len(tok), 0)::double as w, {K.q_syllable_count('low')} as syl, len(list_filter(low, lambda x: {K.q_syllables('x')} >= 3))::double as hard, coalesce(list_sum(list_transform(tok, lambda x: length(x))), 0)::double as letters, len(list_distinct(low))::double as kinds from b)
select tag, id, lv, coalesce(round(0.39::double * w / n + 11.8::double * syl / w - 15.59::double, 9), 0::double) as grade, coalesce(round(0.4::double * (w / n + 100 * hard / w), 9), 0::double) as fog, coalesce(round(letters / w, 9), 0::double) as word_length, coalesce(round(kinds / w, 9), 0::double) as ttr, coalesce(round(w / n, 9), 0::double) as sentence_length, coalesce(round(there / w, 9), 0::double) as term_density from m""",
    "r_fmt": f"{_S} select tag, id, lv, round({_FMT_VALUE}, 9) as r_fmt from s",
    "r_diff": f"{_S} select tag, id, lv, round({_DIFF_VALUE}, 9) as r_diff from s",
    "r_term": f"with {K.Q_SCORED}, {K.Q_TERMS} select tag, id, lv, round({_TERM_VALUE}, 9) as r_term from s, ta",
    "r_copy": f"{_COPY} select tag, id, lv, round({_COPY_VALUE}, 9) as r_copy from g",
    "total_reward": f"""{_COPY}, {K.Q_TERMS}, c as (select tag, id, lv, {_COPY_VALUE} as r_copy from g)
select s.tag, s.id, s.lv, round(0.15::double * {_FMT_VALUE} + 0.20::double * {_DIFF_VALUE.replace("case lv ", "case s.lv ")} + 0.15::double * {_TERM_VALUE} + 0.25::double * r_copy + 0.25::double * coalesce({_NLI('entail', 0)}, 0), 9) as total from s join c on s.tag = c.tag and s.id = c.id and s.lv = c.lv, ta""",
    "gate_feedback": f"with {K.Q_SCORED}, {K.Q_TERMS}, m as (select tag, id, lv, parts, fre, {_MISSING} as missing from s, ta), n as (select tag, id, lv, {_NOTES} as notes from m) select tag, id, lv, notes, notes = '' as passed from n",
    "sari_sentence": f"with {_TRIPLE}, w as (select tag, id, lv, {K.q_words('rew')} as o, {K.q_words('ref')} as r, {K.q_words('src')} as s from j), {_SARI_GRAMS} select tag, id, lv, round({_SARI}, 9) as sari from g",
}
