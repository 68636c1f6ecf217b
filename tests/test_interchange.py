"""Files of interchange by hand: what is wrong in forms, envelopes with digests, reports, layout; languages of packets."""

import hashlib
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quireframe.operators import interchange as I
from quireframe.operators import rules as R

BOX = [0, 0, 5, 5]


def field(id="a", name="n", type="text", page=1, rectangle=BOX, **more):
    return {"id": id, "name": name, "type": type, "page": page, "rectangle": rectangle, **more}


@pytest.mark.parametrize(
    ("bad", "code"),
    [
        (field(), None),
        (field(type="Text"), "bad-type"),
        (field(type=None), "bad-type"),
        (field(type="radio"), "bad-options"),
        (field(type="radio", options=["x", "x"]), "bad-options"),
        (field(type="radio", options="x"), "bad-options"),
        (field(type="radio", options=["x", " "]), "bad-options"),
        (field(type="radio", options=["x", "y"]), None),
        (field(options=None), None),
        (field(validation={"pattern": "(a+)+"}), "unsafe-pattern"),
        (field(validation={"pattern": 5}), "unsafe-pattern"),
        (field(validation={"pattern": "^A\\d.$"}), None),
        (field(validation={"min": 3, "max": 2}), "bad-range"),
        (field(validation={"min": 1.5}), "bad-range"),
        (field(validation={"min": -3, "max": 2}), None),
        (field(id="_a"), "bad-id"),
        (field(id=None), None),
        (field(name=" "), "bad-name"),
        (field(name="a\tb"), "bad-name"),
        (field(page=0), "bad-page"),
        (field(rectangle=[0, 0, 5]), "bad-box"),
        (field(rectangle=[6, 0, 5, 5]), "bad-box"),
        (field(rectangle=None), "bad-box"),
        (field(calculation="sum(a,b)"), None),
        (field(calculation="sum()"), "bad-calculation"),
    ],
)
def test_field_faults(spark, bad, code):
    docs = spark.createDataFrame([(1, json.dumps({"format": "f", "fields": [bad], "values": []}))], "doc_id int, json string")
    (row,) = I.imported_forms(docs, "f").collect()
    assert (row["code"], row["accepted"]) == (code, code is None)


def test_forms_as_a_whole(spark):
    fields = [field("a", "x"), field("a", "y"), field("b", "x"), field("c", "c", "checkbox"), field("d", "d", "number"), field("e", "e", "select", options=["p", "q"])]
    values = [("a", "text"), ("a", None), ("a", 5), ("c", True), ("c", "true"), ("d", 2.5), ("d", "2"), ("e", "q"), ("e", "r"), ("e", None), ("z", "x"), (None, "x")]
    good = {"format": "f", "fields": fields, "values": [{"id": i, "value": v} for i, v in values]}
    other = [None, "", "{", "[]", "5", json.dumps(good | {"format": "g"}), json.dumps(good | {"fields": {}}), json.dumps(good | {"values": None}), json.dumps(good | {"fields": fields * 3})]
    docs = [(0, json.dumps(good)), *enumerate(other, 1), (99, json.dumps({"format": "f", "fields": [], "values": []}))]
    rows = I.imported_forms(spark.createDataFrame(docs, "doc_id int, json string").withColumn("FIELDS", F.lit(1)), "f", most=12).collect()
    assert [r["code"] for r in sorted((r for r in rows if r["kind"] == "field"), key=lambda r: r["at"])] == [None, "duplicate-id", "duplicate-name", None, None, None]
    got = [r["code"] for r in sorted((r for r in rows if r["kind"] == "value"), key=lambda r: r["at"])]
    assert got == [None, None, "bad-value", None, "bad-value", None, "bad-value", None, "bad-value", "bad-value", "unknown-field", "unknown-field"]
    assert sorted((r["doc_id"], r["code"]) for r in rows if r["kind"] == "file") == [(i, "bad-format") for i in range(1, 10)]
    assert not any(r["accepted"] for r in rows)
    assert I.imported_forms(spark.createDataFrame([], "doc_id int, json string"), "f").count() == 0


def test_envelopes(spark):
    reply = "array<struct<id:string,author:string,text:string>>"
    notes = [(1, 1, "a", 1, None, "é \"x\"", [("b", "r", None)]), (1, 2, "c", 3, "me", None, []), (2, 1, "a", 1, "me", "t", [("a", "r", "again")]), (3, 1, "a", 1, "me", "t", [])]
    made = spark.createDataFrame(notes, f"doc_id int, at int, id string, page int, author string, text string, replies {reply}")
    sources = spark.createDataFrame([(1, "s1", 7), (2, "s2", 8), (4, "s4", 9)], "doc_id int, sha256 string, revision int")
    got = {r["doc_id"]: r for r in I.comment_envelopes(made, sources).collect()}
    assert sorted(got) == [1, 2] and (got[2]["code"], got[2]["envelope"]) == ("forged-id", None)
    e = json.loads(got[1]["envelope"])
    assert [(c["id"], c["order"], c["author"], c["text"]) for c in e["comments"]] == [("a", 1, "", 'é "x"'), ("b", 2, "r", ""), ("c", 3, "me", "")]
    listed = json.dumps(e["comments"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert e["commentSha256"] == got[1]["digest"] == hashlib.sha256(listed.encode()).hexdigest()
    assert (e["revision"], e["sourceSha256"], e["commentCount"]) == (7, "s1", 3)
    chosen = spark.createDataFrame([(1, "c")], "doc_id int, id string")
    (one,) = I.comment_envelopes(made, sources, chosen).collect()
    assert [c["order"] for c in json.loads(one["envelope"])["comments"]] == [3]


def test_reports(spark):
    checks = [(1, 1, "b.x", "pass", "a <b>", '{"b": 1.0, "a": "&"}'), (1, 0, "a", "not-checked", "s", "null"), (2, 0, "a", "fail", "s", "5"), (3, 0, "a", "fail", "s", "{"), (4, 0, "a", "odd", "s", "5"), (5, 0, "a", "pass", "\x07", "5"), (6, 0, None, None, None, None)]
    c = spark.createDataFrame(checks, "doc_id int, at int, check string, status string, summary string, evidence string")
    d = spark.createDataFrame([(i, f"sha{i}", i) for i in range(1, 8)], "doc_id int, sha256 string, pages int")
    got = {r["doc_id"]: r for r in I.check_reports(c, d, "p&q", ["one", "<two>"]).collect()}
    assert {i: (r["status"], r["code"]) for i, r in got.items() if i not in (3, 4, 5, 6)} == {1: ("review-required", None), 2: ("fail", None), 7: ("pass", None)}
    assert all(got[i]["code"] == "bad-check" and got[i]["xml"] is None and got[i]["digest"] is None for i in (3, 4, 5, 6))
    x = ET.fromstring(got[1]["xml"])
    assert [(k.get("id"), k.find("summary").text, k.find("evidence").text) for k in x.find("checks")] == [("a", "s", "null"), ("b.x", "a <b>", '{"a":"&","b":1}')]
    counts = {"pass": 1, "warning": 0, "fail": 0, "not-checked": 1}
    payload = {"kind": "preflight-review", "schemaVersion": 1, "localOnly": True, "authoritative": False, "profile": {"id": "p&q", "fixed": True}, "document": {"sha256": "sha1", "pageCount": 1}, "status": "review-required", "counts": counts, "checks": [{"id": "a", "status": "not-checked", "summary": "s", "evidence": None}, {"id": "b.x", "status": "pass", "summary": "a <b>", "evidence": {"a": "&", "b": 1}}], "limitations": ["one", "<two>"]}
    assert x.get("report-sha256") == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert len(ET.fromstring(got[7]["xml"]).find("checks")) == 0


def test_layout(spark):
    words = [(1, 1, "b", "<x>", 90.5, 0.5, 0.25, 0.5, 0.5), (1, 1, "a", None, None, 0.0, 0.25, 0.5, 0.5), (2, 1, "a", "t", 1.0, 0.75, 0.0, 0.5, 0.5), (3, 1, "a", "t", 1.0, None, 0.0, 0.5, 0.5), (9, 1, "a", "t", 1.0, 0.0, 0.0, 0.5, 0.5)]
    w = spark.createDataFrame(words, "doc_id int, page int, id string, text string, confidence double, x double, y double, width double, height double")
    sizes = spark.createDataFrame([(1, 1, 612.0, 792.0), (1, 2, 10.0, 20.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0), (4, 1, 0.0, 1.0)], "doc_id int, page int, points_wide double, points_high double")
    got = {r["doc_id"]: r for r in I.layout_documents(w, sizes, "a<b").collect()}
    assert {i: r["code"] for i, r in got.items()} == {1: None, 2: "bad-word", 3: "bad-word", 4: "bad-size"}
    j = json.loads(got[1]["json"])
    assert [[x["id"] for x in p["words"]] for p in j["pages"]] == [["a", "b"], []] and (got[1]["n_pages"], got[1]["n_words"]) == (2, 2)
    assert '<span data-confidence="90.5" style="left:50.0000%;top:25.0000%;width:50.0000%;height:50.0000%">&lt;x&gt;</span>' in got[1]["html"] and "<title>a&lt;b</title>" in got[1]["html"]
    assert got[2]["json"] is None and got[2]["html"] is None


def test_table_csv(spark):
    words = [(1, 1, 1, 1, line, i, t, x, float(line), 0.05, 0.01) for line, row in enumerate([[("=a", 0.1), ('q"', 0.5), ("r", 0.9)], [("b", 0.1), ("c", 0.11), ("d", 0.9)]]) for i, (t, x) in enumerate(row)]
    words += [(2, 1, 1, 1, 0, 0, "alone", 0.1, 0.0, 0.05, 0.01)]
    w = spark.createDataFrame(words, "doc_id int, page int, block int, paragraph int, line int, id int, text string, x double, y double, width double, height double")
    got = I.table_csv(w).collect()
    assert [(r["doc_id"], r["rows"], r["columns"], r["csv"]) for r in got] == [(1, 2, 3, '"\'=a","q""","r"\r\n"b c","","d"\r\n')]


@pytest.mark.parametrize(
    ("xml", "language"),
    [
        (None, None),
        ("", None),
        ("no tags", None),
        ("<dc:language><rdf:Bag>\n<rdf:li x='1'> fr </rdf:li></rdf:Bag></dc:language>", "fr"),
        ("<DC:Language ><rdf:Bag><RDF:li>longer text</RDF:li><rdf:li>de-AT</rdf:LI></rdf:Bag>", "de-AT"),
        ("<dc:language>" + " " * 4096 + "<rdf:li>it</rdf:li>", "it"),
        ("<dc:language>" + " " * 4097 + "<rdf:li>it</rdf:li>", None),
        ("<rdf:li>it</rdf:li><dc:language>", None),
        ("<dc:language>" + " " * 4097 + "<dc:language><rdf:li>it</rdf:li>", "it"),
        ("<dc:language> <rdf:li>it</rdf:x></rdf:li>", None),
        ("<a xml:lang='it'/><pdf:Lang>es</pdf:Lang>", "es"),
        ("<pdf:Lang>es</xmp:Language>", "es"),
        ("<pdf:Lang>es</p>", None),
        ("<a language=\"en-GB\">", "en-GB"),
        ("<a language=\"english\">", None),
    ],
)
def test_declared_language(spark, xml, language):
    docs = spark.createDataFrame([(xml,)], "xml string")
    none = F.array().cast("array<struct<name:string,value:string>>")
    assert docs.select(R.declared_language(none, F.col("xml")).alias("l")).head()["l"] == language
