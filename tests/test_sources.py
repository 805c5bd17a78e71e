"""Readers, writers, scorers and streams on small files."""

import json

import pytest

from lexloom import schemas as S
from lexloom.operators import scorers
from lexloom.sources import readers, writers
from lexloom.streaming import live


def test_json_lines_and_variants(spark, tmp_path):
    (tmp_path / "A.jsonl").write_text('{"id": "1", "lv": "beginner", "tot": 0.5, "nli": [0.1, 0.2, 0.7]}\n\n')
    (tmp_path / "A_honest.jsonl").write_text('{"id": "1", "lv": "beginner", "tot": 0.0, "nli": {"contra": 0.7}}\n')
    (tmp_path / "B.jsonl").write_text('{"id": "2", "lv": "advanced", "tot": 0.9, "src": "s"}\n')
    (tmp_path / "B_pilot.jsonl").write_text('{"id": "9"}\n')
    df = readers.tagged(spark, str(tmp_path / "*.jsonl"), S.SCORED, r"^(.*)\.jsonl$")
    got = sorted((r.tag, r.id, r.tot) for r in readers.preferred_variant(df).collect())
    assert got == [("A", "1", 0.0), ("B", "2", 0.9)]
    filled = readers.backfilled(df.where("tag = 'A_honest'"), df.where("tag = 'A'").withColumn("src", df.id), ["id", "lv"], ["src", "sec"])
    assert [(r.src, r.sec) for r in filled.collect()] == [("1", None)]


def test_corpus_terms_split_key(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"source": "x", "n_snippets": 1, "n_terms": 1, "snippets": [{"id": "a", "text": "t"}], "terms": [{"term": "lien", "definition": "d"}]}, indent=1))
    s, t = readers.corpus(spark, str(tmp_path / "c.json"))
    assert s.first().id == "a" and t.first().definition == "d"
    df = spark.createDataFrame([('[{"term": "a", "definition": "x"}]',), ('["b"]',), ('{"c": "z"}',), (None,)], "j string")
    assert sorted(tuple(r) for r in readers.terms(df, "j").collect()) == [("a", "x"), ("b", ""), ("c", "z")]
    (tmp_path / "s.json").write_text(json.dumps({"train": [{"id": "1"}], "val": [], "test": [{"id": "2"}]}))
    assert sorted((r.id, r.split) for r in readers.split_document(spark, str(tmp_path / "s.json")).collect()) == [("1", "train"), ("2", "test")]
    key = {r: {f"i{i}": {x: f"s{x}" for x in "ABCDEF"} for i in range(40)} for r in ("R1", "R2", "R3")}
    (tmp_path / "k.json").write_text(json.dumps(key))
    k = readers.blinding_key(spark, str(tmp_path / "k.json"))
    assert k.count() == 720 and k.where("label = 'C'").select("system").distinct().collect()[0][0] == "sC"


def test_sheets(spark, tmp_path):
    d = tmp_path / "rated_R2.csv"
    d.write_text('﻿' + "item_id,level,source_text,label,rewrite,difficulty_1_5,meaning_1_5,terminology_1_5,fluency_1_5,overall_1_5,valid_rewrite,comment\n" + 'x_1,beginner,"two\nlines",A,"say ""hi""",3,,bad,4.0,5,Y,\n', encoding="utf-8")
    r = readers.rater_sheets(spark, str(d)).first()
    assert (r.item_id, r.source_text, r.rewrite, r.difficulty_1_5, r.meaning_1_5, r.terminology_1_5, r.fluency_1_5, r.rater) == ("x_1", "two\nlines", 'say "hi"', 3, None, None, 4, "R2")
    writers.sheet(spark.createDataFrame([("a", 1)], "item_id string, n int"), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿item_id")


def test_first_of_name(spark):
    df = spark.createDataFrame([("/b/x.json", 1), ("/a/x.json", 2), ("/b/y.json", 3)], "path string, v int")
    assert sorted(r.v for r in readers.first_of_name(df, ["/a", "/b"]).collect()) == [2, 3]


def test_idempotent_append(spark, tmp_path):
    df = spark.createDataFrame([("t", 1), ("t", None)], "tag string, id int")
    for _ in range(2):
        writers.append_missing(df, str(tmp_path / "sink"), ["tag", "id"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2
    writers.json_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    writers.json_document(df, str(tmp_path / "doc"))
    assert len(json.loads(next((tmp_path / "doc").glob("part-*")).read_text())["rows"]) == 2
    assert writers.markdown(df.where("id = 1")).splitlines()[-1] == "| t | 1 |"


def test_scorer(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string")
    got = scorers.score(df, lambda: lambda b: pd.DataFrame({"n": b["t"].fillna("").str.len().astype(float)}), ["t"], "n double", ["k"])
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 2.0), (2, 0.0)]


def test_stream_refresh(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"tag": "A", "id": "1", "lv": "beginner", "tot": 0.5, "received_at": "2025-01-01T00:00:00"}
    (src / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row))
    report = lambda df: df.groupBy("tag").count()
    for n in (1, 2):
        q = live.refresh(live.scored_stream(spark, str(src)), str(tmp_path / "table"), str(tmp_path / "ckpt"), report, str(tmp_path / "sink"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "sink")).first()["count"] == n
        (src / "2.json").write_text(json.dumps(row | {"id": "2"}) + "\n" + json.dumps(row))


def test_windows_batch_equals_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = live.tumbling(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("win")) == key(live.tumbling(events))


def test_reports_raise(spark, tmp_path):
    """A report that is too large is an error, not cut."""
    df = spark.range(5)
    with pytest.raises(ValueError):
        writers.markdown(df, most=4)
    assert len(writers.markdown(df, most=5).splitlines()) == 7
