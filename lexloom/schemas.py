"""Explicit schemas of the record files; none is inferred."""

from __future__ import annotations

SNIPPET = "id string, source string, title string, text string"
TERM = "term string, definition string"
CORPUS = "source string, n_snippets long, n_terms long, snippets array<struct<id:string,source:string,title:string,text:string>>, terms array<struct<term:string,definition:string>>"
PARTS = "struct<fmt:double,diff:double,term:double,copy:double,faith:double>"
SCORED = f"id string, lv string, src string, rew string, rew_raw string, rew_clean string, tot double, parts {PARTS}, fre double, attempts int, nli string, stripped boolean, pure_commentary boolean, sec double"
JUDGE = "struct<difficulty:int,faithfulness:int,terminology:int,fluency:int,confidence:double>"
JUDGED = f"id string, lv string, system string, src string, rew string, tot double, parts {PARTS}, fre double, judge {JUDGE}, raw string"
DECODED = f"model string, mode string, swap boolean, id string, lv string, system string, src string, rew string, results array<struct<rep:int,judge:{JUDGE},raw:string,attempt:int>>"
SHEET = "item_id string, level string, source_text string, label string, rewrite string, difficulty_1_5 string, meaning_1_5 string, terminology_1_5 string, fluency_1_5 string, overall_1_5 string, valid_rewrite string, comment string"
KEY = "map<string,map<string,map<string,string>>>"
EMBEDDING = "id string, vector array<float>"
EDGE = "a string, b string, type string"
PAIR = "source_id string, difficulty string, source_text string, target_text string, title string"
