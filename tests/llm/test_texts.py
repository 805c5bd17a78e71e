"""Residue, broken pairs, reading levels and abuse on written cases, and on odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import reading, residue, responses, toxicity

RESIDUE = [
    "Please enable JavaScript to continue reading.", "404 Not Found\n\nThe page was not found on this server.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Dear {{ name }}, the rent is due.", "The ${party_name} must pay.",
    "[INSERT NAME] shall pay.", "Bitte aktivieren Sie JavaScript.", "Seite nicht gefunden", "请启用JavaScript", "blah blah blah blah blah", "The rule binds %(court)s at once.", "See <DATE OF NOTICE> below.", "word word word word word", '{"score": {score}}',
    "Internal Server Error. Please try again later.", "Erreur interne du serveur. Veuillez réessayer.", "The rent is due. Access denied. You do not have permission to view this page. It must be paid.", "Title: @@title@@",
]
SOUND = [
    "The server served the writ on time.", "Section 404 of the Act was not found to apply.", "The form is a template: the parties fill in line 5 by hand.", "It was an error of law [emphasis added].", 'The judge added "[t]he lease" and "[sic]".', "Access to the well was denied for 30 days.",
    "The developer had to enable a JavaScript page for the firm by day 7.", '{"difficulty": 3, "fluency": 4}', "The tenant [2019] must pay (see rule 3).", "", " ", None, "x < 5 and y > 3", "The session of the court has ended.", "A man, a plan, a canal.", "He had had had it.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert residue.findings(pa.array([text], pa.string()))


@pytest.mark.parametrize("text", SOUND)
def test_no_residue(text):
    assert not residue.findings(pa.array([text], pa.string()))


def test_residue_table(spark):
    df = spark.createDataFrame([(1, RESIDUE[0], "x", 1), (1, RESIDUE[0], "x", 1), (2, None, None, None), (3, "The rent is due. " * 20_000 + "{{ name }}", "", 0), (None, RESIDUE[1], "", 0)], "row_id long, rew string, text string, rec_id int")
    got = sorted((r.rec_id or -1, r.kind) for r in residue.residue(df, "row_id", "rew").collect())
    assert got == [(-1, "error"), (1, "script"), (1, "script"), (3, "placeholder")]
    assert residue.residue(df.limit(0), "row_id", "rew").count() == 0


def test_same_in_any_batch():
    texts = RESIDUE + SOUND
    whole = [(texts[r] or "") for r, _, _ in residue.findings(pa.array(texts, pa.string()))]
    assert whole == [(t or "") for t in texts if residue.findings(pa.array([t], pa.string()))]


PROSE = "The tenant of the house must pay the rent to the owner of the land before noon. The owner has a duty of care to the tenant and to the guests of the tenant. The court said that the lender lost the case in the spring of the year. "


def _pairs(n=120):
    rng = random.Random(1)
    nouns = "lease rent claim deed bond permit invoice policy report notice".split()
    src = [" ".join(f"The {rng.choice(nouns)} number {rng.randint(1, 999)} binds the {rng.choice(nouns)} of the {rng.choice(nouns)} under rule {rng.randint(1, 99)} of the act." for _ in range(6)) for _ in range(n)]
    rew = [" ".join(f"The owner of the {rng.choice(nouns)} must give the {rng.choice(nouns)} to the {rng.choice(nouns)} in {rng.randint(2, 30)} days." for _ in range(6)) for _ in range(n)]
    defect = [None] * n
    for i in range(n):
        if i % 8 == 0:
            rew[i], defect[i] = rng.choice(["", " ", "N/A", "null", "—", "​"]), "empty"
        elif i % 8 == 1:
            rew[i], defect[i] = "I'm sorry, but I cannot rewrite this passage. Please try another passage.", "refusal"
        elif i % 8 == 2:
            rew[i], defect[i] = src[i], "copy"
        elif i % 8 == 3:
            rew[i], defect[i] = "Der Mieter muss die Miete an den Vermieter zahlen, und das Gericht hat die Klage nicht angenommen. Das ist die Regel und sie gilt auch für den Käufer.", "language"
        elif i % 8 == 4:
            rew[i], defect[i] = "Here is how I would approach it. I need to keep the key terms. I should use shorter sentences. The reading ease should go up by 9 points.", "commentary"
        elif i % 8 == 5:
            rew[i], defect[i] = rew[i][: -rng.randint(18, 30)], "truncated"
        elif i % 8 == 6:
            rew[i] = rew[i].rstrip(".")  # a missing full stop alone is none
    return src, rew, defect


def test_broken_pairs(spark):
    src, rew, defect = _pairs()
    rows = [(i, s, r, d == "commentary" or None, "x") for i, (s, r, d) in enumerate(zip(src, rew, defect))] + [(900, None, PROSE, None, "x"), (901, "a b", None, None, "x"), (902, src[0], PROSE * 400, None, "x"), (903, None, None, None, "x")]
    df = spark.createDataFrame(rows, "row_id long, src string, rew string, hint boolean, defect string")
    model = responses.fit(df)
    got = {r.row_id: r.defect for r in responses.defects(df, model).collect()}
    right = [got.get(i) == d for i, d in enumerate(defect)]
    assert np.mean(right) > 0.95, [(i, got.get(i), d) for i, d in enumerate(defect) if got.get(i) != d]
    assert got[901] == got[903] == "empty" and 900 not in got and 902 not in got
    assert responses.defects(df.limit(0), model).count() == 0
    assert responses.defects(df, responses.fit(df.limit(0))).count() > 0


def test_repeated_pairs_count(spark):
    df = spark.createDataFrame([(5, "a", None, None), (5, "a", None, None)], "row_id long, src string, rew string, hint boolean")
    assert [r.defect for r in responses.defects(df, responses.fit(df)).collect()] == ["empty", "empty"]


def test_quoted_refusal_is_answer():
    t = responses.analyse(pa.array(["x"], pa.large_string()), pa.array(['"I\'m sorry, but I can\'t pay," the tenant wrote in letter 5.'], pa.large_string()), (np.zeros(0, np.uint64), np.zeros(0)), (np.zeros(0, np.uint64), np.zeros(0)))
    assert t.x[:, responses._COL["refusal"]].sum() == 0


EASY = "The man took the cat. The dog ran to the man. He had a red hat. She put the hat on the bed. "
HARD = "Notwithstanding the aforementioned considerations of transnational proportionality the adjudicating committee of the intervening association may determine the supplementary consequences of derivative reciprocal recognition whenever the licensing directorate acquiesces in the conduct of the respondent undertaking. "


def _levels(spark):
    mid = "The tenant argued that the lender had no right to change the contract, but the court found the evidence about the payment weak. "
    docs = spark.createDataFrame([(i, EASY * 3) for i in range(40)] + [(100 + i, mid * 2) for i in range(20)] + [(200 + i, HARD) for i in range(3)] + [(300, None), (301, "")], "doc_id long, text string")
    rows = [(i, lv, t * 3, "s") for lv, t in (("beginner", EASY), ("Intermediate ", mid), ("advanced", HARD)) for i in range(20)]
    rows = [(n, lv, t + f"Rule {n} is law.", s) for n, (_, lv, t, s) in enumerate(rows)]
    rows += [(900, " BEGINNER", HARD * 3, "s"), (901, "advanced", EASY * 4, None), (902, "beginner", "Short text.", "s"), (903, None, HARD * 3, "s"), (904, "beginner", None, "s"), (905, "beginner", "I'm sorry, but I cannot rewrite this passage because the guidelines do not allow it, and I am unable to process the constitutional proportionality considerations of it in any way at all.", "s"), (906, "beginner", HARD * 3 + "{{ name }}", "s")]
    scored = spark.createDataFrame([(*r, 1.0, None) for r in rows], "row_id long, lv string, rew string, src string, level double, pure_commentary boolean")
    return docs, scored


def test_off_level(spark):
    docs, scored = _levels(spark)
    words = reading._word_list(docs)
    f = reading.fit(scored, words)
    got = {r.row_id: (r.lv, r.reads) for r in reading.off_level(scored, f).collect()}
    assert got == {900: ("beginner", "advanced"), 901: ("advanced", "beginner")}


def test_familiar_words_brute_force(spark):
    docs, _ = _levels(spark)
    import re

    texts = [set(re.findall("[a-z0-9]+", r.text.lower())) for r in docs.where("text is not null and text <> ''").collect()]
    want = {w for t in texts for w in t if sum(w in x for x in texts) >= 0.1 * len(texts) and w.isalpha()}
    h = reading._texts(pa.array([" ".join(sorted(want))]))[3]
    assert sorted(h.tolist()) == reading._word_list(docs).tolist()


def test_lists_by_language(spark):
    """A word is familiar where its own language knows it, however few documents that language has."""
    texts = ["the lease of the house is with the owner"] * 40 + ["le bail de la maison est avec le notaire déjà"] * 2 + ["договор не подписан в срок"] * 2 + ["契约已签"] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = reading._word_list(docs)
    _, share, _, _ = reading.measures(pa.array(["le notaire est déjà avec la maison", "договор подписан", "契约", "déjà the house of the owner is with", "zut the lease"]), words)
    assert share.tolist()[:3] == [0, 0, 0] and 0 < share[3] < 0.3 and share[4] > 0.3


def test_levels_of_all_texts(spark):
    """Short texts have a level, texts without words and tables without levels have none."""
    docs, scored = _levels(spark)
    f = reading.fit(scored, reading._word_list(docs))
    few = spark.createDataFrame([(1, "The cat sat."), (2, ""), (3, None), (4, "...")], "row_id long, rew string")
    got = {r.row_id: r.reads for r in reading._levels(few, "row_id", "rew", f).collect()}
    assert got[1] in reading.LEVELS and got[2] is got[3] is got[4] is None
    one = reading.fit(scored.where("lv = 'beginner'"), f.words)
    assert {r.reads for r in reading._levels(few, "row_id", "rew", one).collect()} == {"beginner", None}
    none = reading.fit(scored.limit(0), f.words)
    assert {r.reads for r in reading._levels(few, "row_id", "rew", none).collect()} == {None}


def test_measures_by_hand():
    n, share, length, syll = reading.measures(pa.array(["One two. Three four five!", "", "no stop at all", "A.\n\nB c"]), np.zeros(0, np.uint64))
    assert n.tolist() == [5, 0, 4, 3] and length.tolist() == [2.5, 0.0, 4.0, 1.5] and share.tolist() == [1, 0, 1, 1] and syll[1] == 0


def test_reading_of_small_tables(spark):
    docs, scored = _levels(spark)
    f = reading.fit(scored.limit(0), reading._word_list(docs.limit(0)))
    assert reading.off_level(scored.limit(0), f).count() == 0


def test_spelling_folds():
    base = toxicity.words(pa.array(["you scumbag and naked moron"]))[0].tolist()
    for t in ("y0u $cumb4g and nak3d m0ron", "yoou scumbag and nakedd moroon", "you s.c.u.m.b.a.g and naked m-o-r-o-n", "you s c u m b a g and naked moron", "yоu scumbаg and nаked mоron", "you scum​bag and nákéd moron", "You SCUMBAG, and naked: moron!", "𝐲𝐨𝐮 𝐬𝐜𝐮𝐦𝐛𝐚𝐠 and naked moron"):
        assert toxicity.words(pa.array([t]))[0].tolist() == base, t
    keys = toxicity.words(pa.array(["naked sex an"]), masked=True)[3]
    h = toxicity.words(pa.array(["n***d s_x **bold** snake_case 123 n###d a"]))[0]
    assert h[0] == h[-2] == keys[0] and h[1] == keys[1] and keys[2] == 0 and h[-3] == toxicity.NUMBER


def test_positive_unlabelled_learning(spark):
    rng = random.Random(3)
    nouns = "lease rent claim deed bond permit invoice policy report notice".split()
    clean = lambda: " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was signed on day {rng.randint(1, 99)}." for _ in range(8))
    bad = ["You are a worthless zorbag and everyone hates you", "All gribbles are vermin and must be driven out", "Crawl back under your rock, you filthy zorbag"]
    rows, truth = [], {}
    for i in range(700):
        t = clean()
        if i % 10 == 0:
            s = t.split(". ")
            s.insert(rng.randint(0, len(s) - 1), rng.choice(bad))
            t, truth[i] = ". ".join(s), True
        rows.append((i, t, "A" if i % 2 else "b "))
    rows += [(800, None, None), (801, "", "a"), (802, "The word zorbag is discussed in report 5 of the claim.", "a"), (803, clean() * 300, "a")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i in truth)) for i in range(0, 700, 4)] + [(None, 1), (3, None)], "doc_id long, abusive int")
    out = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    got = {i for i, r in out.items() if r.abusive}
    held = {i for i in truth if i % 4}
    assert len(got & set(truth)) >= 0.95 * len(truth) and len(got - set(truth)) <= 3 and len(held & got) >= 0.95 * len(held)
    assert len(out) == len(rows) and out[800].score == out[801].score == 0
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert toxicity.scored(docs, labels.limit(0)).where("not abusive").count() == len(rows)
    # the share of abusive windows is estimated, and each unlabelled window counts
    told = toxicity.fit(docs, labels)
    windows = toxicity.distinct_windows(toxicity.places(docs, told))
    total = windows.where("grams is null").first().n
    assert total == sum(len(toxicity.words(pa.array([r[1]]))[0]) for r in rows if r[1])
    places = toxicity.places(docs, told).toPandas()
    assert windows.where("grams is not null").agg({"n": "sum"}).first()[0] == sum(len(set(w)) for w in places.word)
    true = sum(1 for w in places[places.doc_id.isin(list(truth))].word for _ in set(w)) / total
    assert 0.3 * true < toxicity.class_prior(told, windows.where("grams is not null"), total) < 1.5 * true


def test_confirmed_windows():
    """A marked text that no other marked text bears out confirms nothing; repeated texts count once."""
    clean = [f"the lease of day {i} was signed by the tenant and the owner" for i in range(40)]
    bad = ["you worthless zorbag nobody wants you here", "get out you worthless zorbag nobody likes you"]
    told = toxicity.learn([bad[0] + " today", bad[1], "the lease of the boat was fully sold"], clean)
    assert told.windows and len(told.features) == len(told.odds) and (told.odds > toxicity.TELLING).all()
    h = toxicity.words(pa.array(["zorbag boat"]))[0]
    one = toxicity.K.mix(h * np.uint64(3))
    assert toxicity._in(one, told.features).tolist() == [False, False] or not toxicity._in(one, told.features)[1]
    assert not toxicity.learn([bad[0]] * 5, clean).windows and not toxicity.learn([], []).windows


def test_refusal_in_other_words(spark):
    """A refusal that holds none of the listed phrases is found by its words, and no sound row with it."""
    src, rew, defect = _pairs(160)
    for i in range(7, 160, 8):
        rew[i] = f"Unfortunately, this request on Tarn{i} is outside what I can do." + (" My apologies, please try another passage." if i % 32 != 7 else "")
        defect[i] = "refusal"
    df = spark.createDataFrame([(i, s, r, d == "commentary" or None) for i, (s, r, d) in enumerate(zip(src, rew, defect))], "row_id long, src string, rew string, hint boolean")
    got = {r.row_id: r.defect for r in responses.defects(df, responses.fit(df)).collect()}
    bare = [i for i in range(160) if rew[i].endswith("outside what I can do.")]
    assert len(bare) == 5 and all(got.get(i) == "refusal" for i in bare), [(i, got.get(i)) for i in bare]
    assert not [i for i in range(160) if defect[i] is None and got.get(i) == "refusal"]


def test_word_tables_count_all_rows(spark):
    """The statistics of words cover rows that are not in the sample; the sample only says which words have a weight."""
    rows = [(i, f"The lease ends on day {i}. The owner pays.", "I should keep the lease. The owner pays" if i % 2 else "The owner pays. The lease ends.", bool(i % 2)) for i in range(60)] + [(99, None, "", None), (98, "x", None, None)]
    df = spark.createDataFrame(rows, "row_id long, src string, rew string, hint boolean")
    few = pa.array(["The owner pays. I should keep it"], pa.large_string())
    talk, ends, declines = responses.word_tables(df, few, few)
    odds = dict(zip(talk[0].tolist(), talk[1].tolist()))
    h = lambda w: int(responses._hash_words([w])[0])
    assert odds[h("should")] > 2 and odds[h("owner")] < 0.5 and h("ends") not in odds and h("it") not in odds
    _, _, keys, _ = responses._sentence_ends(few)
    end = dict(zip(ends[0].tolist(), ends[1].tolist()))
    assert end[int(keys[2, 0])] > 1 and end[int(keys[1, 0])] < -2 and not len(declines[0])
    assert all(not len(x[0]) for x in responses.word_tables(df.limit(0), few, few)) and not len(responses.fit(df.limit(0)).talk[0])


def test_long_rows_are_trained_on(spark):
    """Rows of any number of clauses enter the fit."""
    text = " ".join(f"The owner of house {i} pays the rent." for i in range(120))
    df = spark.createDataFrame([(i, text, text if i % 2 else f"I am sorry, but I cannot rewrite passage {i}.", None) for i in range(20)], "row_id long, src string, rew string, hint boolean")
    got = {r.row_id: r.defect for r in responses.defects(df, responses.fit(df)).collect()}
    assert got == {i: "copy" if i % 2 else "refusal" for i in range(20)}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("HTTP 500 - model worker unavailable", "error"), ("The tenant paid.\nError 404: no such file\nThe rent is due.", "error"), ("It looks like an ad blocker stopped scripts that Tarn needs (7047).", "script"), ("Introductory paragraph 12, final wording to follow.", "filler"),
        ("HTTP 404 is a status code that the expert explained to the court in file 12.", None), ("The error 404 units of account were found in the ledger of the owner.", None), ("The text to follow the notice was agreed by the parties in March of that year.", None),
    ],
)
def test_residue_rules(text, kind):
    """A document, or a sentence or line in it, whose covered share is high; a status line; no mere mention."""
    got = residue.findings(pa.array([text]))
    assert [k for _, k, _ in got] == ([kind] if kind else [])
