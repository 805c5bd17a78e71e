"""Queries: lexicon, graph and vector retrieval, sentence alignment and corpus overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import rewards as RW
from lexloom.functions import text as T
from lexloom.operators import retrieval as R
from lexloom.plans import kit as K
from lexloom.plans.texts import _SARI, _SARI_GRAMS, _TRIPLE


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return K.snippets(spark, d).select("id", "text").distinct()


_P = f"{K.Q_SNIPPETS}, p as (select distinct id, text from sn), {K.Q_TERMS}"
_E = f"{_P}, e as (select id, unnest(list_filter(terms, lambda t: contains(lower(coalesce(text, '')), t))) as term from p, ta)"


def terms_in_text(spark: SparkSession, d: str) -> DataFrame:
    return K.with_terms(_passages(spark, d), spark, d).select("id", F.array_join(RW.present_terms("text", F.col("terms")), "|").alias("present"))


def contains_term_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.edges(_passages(spark, d), "id", "text", K.terms(spark, d)).select("id", "term")


def related_edges(spark: SparkSession, d: str) -> DataFrame:
    """Opinions that hold one of the first twenty terms, each linked to the first two statutes."""
    p = _passages(spark, d).where("text is not null")
    first = K.terms(spark, d).orderBy("term").limit(20)
    a = R.edges(p.where(F.col("id").startswith("opin")), "id", "text", first).select(F.col("id").alias("a")).distinct()
    b = p.where(F.col("id").startswith("stat")).select(F.col("id").alias("b")).distinct().orderBy("b").limit(2)
    return a.crossJoin(F.broadcast(b))  # two rows


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of every vector whose id is divisible by 50."""
    e = K.table(spark, d, "embeddings")
    top = R.dense_topk(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 8)
    return top.select("q", F.col("key").alias("vec_id"), F.round("sim", 9).alias("sim"), "rank")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Graph scores of the knowledge base for the test passages whose id is divisible by 50."""
    kb = K.snippets(spark, d)
    number = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("int")
    docs = R.edges(kb.where("split <> 'test'").select("id", "text").distinct(), "id", "text", K.terms(spark, d))
    q = R.edges(kb.where("split = 'test'").where(number % 50 == 0).select("id", "text").distinct(), "id", "text", K.terms(spark, d))
    return R.graph_scores(q, docs, "id")


_G = f"""{_E}, q as (select distinct e.id as q, term from e join sn on sn.id = e.id where split = 'test' and try_cast(regexp_extract(e.id, '([0-9]+)$', 1) as int) % 50 = 0),
kd as (select distinct e.id, term from e join sn on sn.id = e.id where split <> 'test'), qn as (select q, count(*) as n from q group by 1),
g as (select q, id, 0.4::double * count(*) / greatest(1, any_value(n)) as graph from q join kd using (term) join qn using (q) where q <> id group by q, id)"""


def graph_score(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).select("q", "id", F.round("graph", 9).alias("graph"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of vector and label-graph scores: vectors that share a query's label stand for documents that share its terms."""
    e = K.table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0")
    dense = R.dense_topk(e, queries, "vec_id", "embedding", 8).select("q", F.col("key").alias("vec_id"), "sim")
    label = lambda x: x.select("vec_id", F.col("label").cast("string").alias("term"))
    graph = R.label_scores(label(queries), label(e), dense, "vec_id", 2)
    return R.fused(dense, graph, "vec_id", 2).select("q", "vec_id", F.round("score", 9).alias("score"), "rank")


_DENSE = "em as (select vec_id, embedding::double[] as v, label from embeddings where vec_id is not null and embedding is not null), dn as (select a.vec_id as q, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as sim from em a join em b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0), dk as (select *, row_number() over (partition by q order by sim desc, vec_id)::int as rank from dn qualify rank <= 8)"


def term_context(spark: SparkSession, d: str) -> DataFrame:
    rows = K.with_terms(_passages(spark, d), spark, d)
    return rows.select("id", R.term_context(RW.present_terms("text", F.col("terms")), F.col("definitions")).alias("context"))


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of each test query: its terms, then the two best passages of the graph search, clipped."""
    kb = K.snippets(spark, d)
    number = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("int")
    q = kb.where("split = 'test'").where(number % 50 == 0).groupBy("id").agg(F.min("text").alias("text"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("graph", 9)), "id")
    best = _graph(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 2")
    text = kb.groupBy("id").agg(F.min("text").alias("text"))
    lines = best.join(text, "id").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("l"))
    shown = F.array_join(F.transform("l", lambda x: F.concat(F.lit("> "), F.replace(F.substring(F.coalesce(x["text"], F.lit("")), 1, 280), F.lit("\n"), F.lit(" ")))), "\n\n")
    rows = K.with_terms(q, spark, d).join(lines, F.col("q") == F.col("id"), "left")
    terms = R.term_context(RW.present_terms("text", F.col("terms")), F.col("definitions"))
    head = F.when(terms != "", F.concat(F.lit("Terms:\n"), terms))
    tail = F.when(F.col("l").isNotNull(), F.concat(F.lit("Passages:\n\n"), shown))
    return rows.select("id", F.concat_ws("\n\n", head, tail).alias("context"))


_CONTEXT = "array_to_string(list_transform(list_filter(terms, lambda t: contains(lower(coalesce(text, '')), t))[1:6], lambda t: '- Term \"' || t || '\"' || case when coalesce(map_extract(defs, t)[1], '') <> '' then ': ' || map_extract(defs, t)[1] else '' end), chr(10))"
_DEFS = "td as (select map_from_entries(list((term, definition))) as defs from tm)"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Source and rewrite of each system, beside the rewrite of the reference system, by (tag, id, lv)."""
    s = K.scored(spark, d, "src", "rew").where("rew is not null")
    ref = s.where(F.col("tag") == C.REFERENCE).select("id", "lv", F.col("rew").alias("ref"))
    return s.where((F.col("tag") != C.REFERENCE) & F.col("src").isNotNull()).join(ref, ["id", "lv"])


_KEY = ["tag", "id", "lv"]


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """One row a sentence x (l, set) of each rewrite, at `pos` (null without sentences), beside the sentences s and r of source and
    reference and their word sets, which are computed once a rewrite."""
    t = _triples(spark, d).select(*_KEY, "src", "ref", T.sentences("rew").alias("l"), T.sentences("src").alias("s"), T.sentences("ref").alias("r"))
    t = t.select(*_KEY, "src", "ref", F.arrays_zip("l", R.token_sets(F.col("l")).alias("set")).alias("z"), "s", "r", R.token_sets(F.col("s")).alias("ss"), R.token_sets(F.col("r")).alias("rs"))
    return t.select("*", F.posexplode_outer("z").alias("pos", "x")).drop("z")


def sentence_align(spark: SparkSession, d: str) -> DataFrame:
    a = _sentences(spark, d).select(*_KEY, "pos", R.best_match(F.col("x.set"), F.col("ss")).alias("x")).where("pos is not null and x is not null")
    return a.select(*_KEY, "pos", "x.match", F.round("x.jaccard", 9).alias("jaccard"))


def sari_doc(spark: SparkSession, d: str) -> DataFrame:
    """Mean simplification score over the rewrite's sentences, each against its aligned sentences of source and reference (the whole where none aligns); 0 without sentences."""
    pick = lambda arr, sets, whole: F.coalesce(F.try_element_at(F.col(arr), R.best_match(F.col("x.set"), F.col(sets))["match"] + 1), F.col(whole))
    out = _sentences(spark, d).select(*_KEY, "pos", T.words("x.l").alias("o"), T.words(pick("r", "rs", "ref")).alias("r"), T.words(pick("s", "ss", "src")).alias("s"))
    out = RW.with_ngrams(out, "o", "r", "s")
    score = F.avg(F.when(F.col("pos").isNotNull(), RW.simplification("o", "r", "s")))
    return out.groupBy(*_KEY).agg(F.round(F.coalesce(score, F.lit(0.0)), 9).alias("sari"))


def sari_systems(spark: SparkSession, d: str) -> DataFrame:
    """Mean simplification score of each system and level over its sentences."""
    return sari_doc(spark, d).groupBy("tag", "lv").agg(F.count("*").alias("n"), F.round(F.avg("sari"), 9).alias("sari"))


def corpus_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each system's rewrites with the reference system's over the corpus: four precisions, brevity penalty, their product, and the smoothed value."""
    t = _triples(spark, d).select("tag", T.words("rew").alias("o"), T.words("ref").alias("r"))
    p = R.ngram_matches(t, "tag", "o", "r", 5)
    size = t.groupBy("tag").agg(F.sum(F.size("o")).alias("o"), F.sum(F.size("r")).alias("r"))
    at = lambda c: F.map_from_entries(F.collect_list(F.struct("n", c)))  # noqa: E731  five entries
    j = p.groupBy("tag").agg(at("matched").alias("m"), at("total").alias("t")).join(size, "tag").withColumns({"o": F.col("o").cast("double"), "r": F.col("r").cast("double")})
    prec = {n: F.try_divide(F.element_at("m", F.lit(n)).cast("double"), F.element_at("t", F.lit(n))) for n in range(1, 6)}
    bp = F.when(F.col("o") > F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide("r", "o")))
    logs = sum((F.log(prec[n]) for n in range(1, 5)), F.lit(0.0)) / 4
    # empty precisions are floored by halving, then each is averaged with its neighbours
    floored, empty = [], F.lit(0)
    for n in range(1, 6):
        empty = empty + F.when(F.element_at("m", F.lit(n)) == 0, 1).otherwise(0)
        floor = 5.0 / (F.pow(F.lit(2.0), empty) * F.greatest(F.element_at("t", F.lit(n)), F.lit(1))) / F.log(F.greatest(F.col("o"), F.lit(2.0)))
        floored.append(F.when(F.element_at("m", F.lit(n)) == 0, floor).otherwise(prec[n]))
    before, smooth = floored[0] + 1, []
    for i in range(4):
        before = (before + floored[i] + floored[i + 1]) / 3
        smooth.append(before)
    smoothed = bp * F.exp(sum((F.log(x) for x in smooth), F.lit(0.0)) / 4)
    return j.select("tag", *[F.round(prec[n], 9).alias(f"p{n}") for n in range(1, 5)], F.round(bp, 9).alias("brevity"), F.round(bp * F.exp(logs), 9).alias("bleu"), F.round(smoothed, 9).alias("smoothed"))


_ALIGN = f"{_TRIPLE}, sx as (select tag, id, lv, unnest(range(len(l)))::int as pos, unnest(l) as s from (select tag, id, lv, {K.q_sentences('rew')} as l from j))"
_ALIGNED = lambda name, col: f"""{name}0 as (select tag, id, lv, unnest(range(len(l)))::int as match, unnest(l) as t from (select tag, id, lv, {K.q_sentences(col)} as l from j)),
{name}1 as (select tag, id, lv, pos, match, t, list_distinct({K.q_lower_tokens('s')}) as a, list_distinct({K.q_lower_tokens('t')}) as b from sx join {name}0 using (tag, id, lv)),
{name}2 as (select *, coalesce(len(list_intersect(a, b))::double / nullif(len(list_distinct(list_concat(a, b))), 0), 0) as jaccard from {name}1),
{name} as (select tag, id, lv, pos, match, t, jaccard from (select *, row_number() over (partition by tag, id, lv, pos order by jaccard desc, match) as k from {name}2 where jaccard > 0) where k = 1)"""  # noqa: E731
_SARI_DOC = f"""{_ALIGN}, {_ALIGNED('al', 'src')}, {_ALIGNED('ar', 'ref')},
w as (select sx.tag, sx.id, sx.lv, {K.q_words('sx.s')} as o, {K.q_words('coalesce(ar.t, j.ref)')} as r, {K.q_words('coalesce(al.t, j.src)')} as s from sx join j using (tag, id, lv) left join al using (tag, id, lv, pos) left join ar using (tag, id, lv, pos)),
{_SARI_GRAMS}, sc as (select tag, id, lv, avg({_SARI}) as sari from g group by all), sd as (select j.tag, j.id, j.lv, round(coalesce(sari, 0), 9) as sari from j left join sc using (tag, id, lv))"""
_GRAMS = lambda side, name: "(" + " union all ".join(f"select tag, id, lv, {n} as n, g, count(*) as {name} from (select tag, id, lv, unnest({K.q_ngrams(side, n)}) as g from w) group by all" for n in range(1, 6)) + ")"

QUERIES = {f.__name__: f for f in (terms_in_text, contains_term_edges, related_edges, dense_topk, graph_score, hybrid_topk, term_context, rag_context, sentence_align, sari_doc, sari_systems, corpus_bleu)}

SQL = {
    "terms_in_text": f"with {_P} select id, array_to_string(list_filter(terms, lambda t: contains(lower(coalesce(text, '')), t)), '|') as present from p, ta",
    "contains_term_edges": f"with {_E} select id, term from e",
    "related_edges": f"with {_E}, ft as (select term from tm order by term limit 20), a as (select distinct e.id as a from e join ft using (term) where e.id like 'opin%'), b as (select distinct id as b from p where id like 'stat%' and text is not null order by b limit 2) select a, b from a, b",
    "dense_topk": f"with {_DENSE} select q, vec_id, round(sim, 9) as sim, rank from dk",
    "graph_score": f"with {_G} select q, id, round(graph, 9) as graph from g",
    "hybrid_topk": f"with {_DENSE}, gr as (select a.vec_id as q, b.vec_id, 0.4::double as graph from em a join em b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0), f as (select q, vec_id, 0.7::double * coalesce(sim, 0) + coalesce(graph, 0) as score from dk full join gr using (q, vec_id)), r as (select *, row_number() over (partition by q order by round(score, 9) desc, vec_id)::int as rank from f) select q, vec_id, round(score, 9) as score, rank from r where rank <= 2",
    "term_context": f"with {_P}, {_DEFS} select id, {_CONTEXT} as context from p, ta, td",
    "rag_context": f"""with {_G}, {_DEFS}, pt as (select id, min(text) as text from sn group by 1), gq as (select id, min(text) as text from sn where split = 'test' and try_cast(regexp_extract(id, '([0-9]+)$', 1) as int) % 50 = 0 group by 1),
b as (select q, id, row_number() over (partition by q order by round(graph, 9) desc, id) as k from g), l as (select b.q, string_agg('> ' || replace(substr(coalesce(pt.text, ''), 1, 280), chr(10), ' '), chr(10) || chr(10) order by k) as shown from b join pt using (id) where k <= 2 group by 1),
c as (select gq.id, shown, {_CONTEXT} as tc from gq left join l on l.q = gq.id, ta, td)
select id, concat_ws(chr(10) || chr(10), case when tc <> '' then 'Terms:' || chr(10) || tc end, case when shown is not null then 'Passages:' || chr(10) || chr(10) || shown end) as context from c""",
    "sentence_align": f"with {_ALIGN}, {_ALIGNED('al', 'src')} select tag, id, lv, pos, match, round(jaccard, 9) as jaccard from al",
    "sari_doc": f"with {_SARI_DOC} select * from sd",
    "sari_systems": f"with {_SARI_DOC} select tag, lv, count(*) as n, round(avg(sari), 9) as sari from sd group by all",
    "corpus_bleu": f"""with {_TRIPLE}, w as (select tag, id, lv, {K.q_words('rew')} as o, {K.q_words('ref')} as r from j), go as {_GRAMS('o', 'co')}, gr as {_GRAMS('r', 'cr')},
c as (select tag, n, sum(least(co, coalesce(cr, 0)))::double as m, sum(co)::double as t from go left join gr using (tag, id, lv, n, g) group by tag, n), z as (select tag, sum(len(o))::double as o, sum(len(r))::double as r from w group by tag),
e as (select c.*, o, r, m / t as p, sum((m = 0)::int) over (partition by tag order by n) as inc from c join z using (tag)),
f as (select *, case when m = 0 then 5.0::double / (pow(2, inc) * greatest(t, 1)) / ln(greatest(o, 2)) else p end as q from e),
v as (select tag, any_value(o) as o, any_value(r) as r, {', '.join(f'max(p) filter (n = {n}) as p{n}, max(q) filter (n = {n}) as q{n}' for n in range(1, 6))} from f group by tag),
y as (select *, case when o > r then 1::double else exp(1 - r / o) end as bp, (2 * q1 + 1 + q2) / 3 as s1 from v), y2 as (select *, (s1 + q2 + q3) / 3 as s2 from y), y3 as (select *, (s2 + q3 + q4) / 3 as s3 from y2), y4 as (select *, (s3 + q4 + q5) / 3 as s4 from y3)
select tag, round(p1, 9) as p1, round(p2, 9) as p2, round(p3, 9) as p3, round(p4, 9) as p4, round(bp, 9) as brevity, case when least(p1, p2, p3, p4) > 0 then round(bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 9) end as bleu,
round(bp * exp((ln(s1) + ln(s2) + ln(s3) + ln(s4)) / 4), 9) as smoothed from y4""",
}
