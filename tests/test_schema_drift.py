"""Problem 7 on small feeds whose changes are known."""

import json
import random

from loomline.operators import schema_drift as S


def _doc(k):
    return {"title": f"Guide number {k} about letters", "url": f"https://a.example/page/{k}", "lang": "uk" if k % 2 else "en", "n": k, "official": k % 3 == 0, "tags": ["a", str(k)]}


def _file(feed, stamp, shape, ids, broken=0):
    rows = []
    for place, k in enumerate(ids):
        rows.append((feed, f"{feed}/documents_{stamp}.json", place, json.dumps(shape(_doc(k)))))
    rows += [(feed, f"{feed}/documents_{stamp}.json", 90 + b, '{"title": "cut o') for b in range(broken)]
    return rows


def _first(d):
    return {"metadata": {"title": d["title"], "lang": d["lang"], "url": d["url"]}, "n": d["n"], "official": d["official"]}


def _second(d):  # url renamed and moved, official gone, tags come, n a string
    return {"metadata": {"title": d["title"], "lang": d["lang"]}, "link": d["url"], "n": str(d["n"]), "tags": d["tags"]}


def _third(d):  # lang renamed, tags JSON text, a field that few records hold
    return {"metadata": {"title": d["title"], "language": d["lang"], **({"rare": 1} if d["n"] % 5 == 0 else {})}, "link": d["url"], "n": str(d["n"]), "tags": json.dumps(d["tags"])}


WANT = {
    ("f/documents_20240102_000000.json", "renamed", "link", "metadata.url"),
    ("f/documents_20240102_000000.json", "removed", "official", ""),
    ("f/documents_20240102_000000.json", "added", "tags", ""),
    ("f/documents_20240102_000000.json", "type_changed", "n", ""),
    ("f/documents_20240103_000000.json", "renamed", "metadata.language", "metadata.lang"),
    ("f/documents_20240103_000000.json", "type_changed", "tags", ""),
}


def _records(spark):
    rng = random.Random(4)
    sets = [rng.sample(range(30), 24) for _ in range(3)]
    rows = _file("f", "20240101_000000", _first, sets[0], 2) + _file("f", "20240102_000000", _second, sets[1], 1) + _file("f", "20240103_000000", _third, sets[2])
    rows += [rows[3], ("f", "f/documents_20240103_000000.json", 70, "[1, 2]"), ("f", "f/documents_20240103_000000.json", 71, None), ("g", "g/documents_20240101_000000.json", 0, '{"a": null}')]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "record_id bigint, feed string, file_name string, position int, payload string").selectExpr("*", "'x' AS path", "1 AS value")


def test_changes(spark):
    got = {(r.file_name, r.change, r.field, r.old_field) for r in S.changes(_records(spark)).collect()}
    assert got == WANT
    assert S.changes(_records(spark).limit(0)).count() == 0


def test_table(spark):
    records = _records(spark)
    table = S.consistent_table(records)
    rows = {r.record_id: r for r in table.collect()}
    assert len(rows) == 24 * 3 + 2  # the readable ones, with the repeated record and the one of nulls
    links = next(c for c in table.columns if c in ("link", "metadata_url"))
    assert all(r[links].startswith("https://") for r in rows.values() if r.feed == "f")
    assert dict(table.dtypes)["n"] == "string" and "metadata_rare" in table.columns
    assert S.consistent_table(records.limit(0)).count() == 0


def test_flooding_prefers_agreeing_values():
    old = {"metadata.url": "string", "metadata.title": "string", "kept": "number"}
    new = {"metadata.link": "string", "heading": "string", "kept": "number"}
    counts = {("metadata.url", "metadata.link"): (10, 9), ("metadata.url", "heading"): (10, 0), ("metadata.title", "metadata.link"): (10, 0), ("metadata.title", "heading"): (10, 8)}
    assert set(S.correspondences(old, new, counts)) == {("metadata.url", "metadata.link"), ("metadata.title", "heading")}
    scores = S.flood(old, new, {})
    assert max(scores, key=scores.get) == ("kept", "kept")


def test_similar_names_alone_are_no_rename():
    assert S.correspondences({"url": "string"}, {"urls": "string"}, {("url", "urls"): (10, 1)}) == []
    assert S.correspondences({"url": "string"}, {"urls": "string"}, {}) == []


def test_the_flooded_scores_select():
    """Two partners agree for each field: names and nesting decide, by the scores alone."""
    old = {"metadata.lang": "string", "metadata.label": "string", "kept": "number"}
    new = {"metadata.language": "string", "metadata.labels": "string", "kept": "number"}
    counts = {(a, b): (10, 9) for a in ("metadata.lang", "metadata.label") for b in ("metadata.language", "metadata.labels")}
    assert set(S.correspondences(old, new, counts)) == {("metadata.lang", "metadata.language"), ("metadata.label", "metadata.labels")}
    flood = S.flood
    try:
        S.flood = lambda old, new, agreement: {(a, b): 0.0 for a in old for b in new}
        assert S.matching({"b": "string", "a": "string"}, {"x": "string", "y": "string"}, {("a", "y"): 1.0, ("b", "x"): 1.0}) == [("a", "x"), ("b", "y")]
    finally:
        S.flood = flood
    assert set(S.matching({"b": "string", "a": "string"}, {"x": "string", "y": "string"}, {("a", "y"): 1.0, ("b", "x"): 1.0})) == {("a", "y"), ("b", "x")}


def _rows(spark, files):
    rows = [(feed, f"{feed}/documents_{stamp}.json", k, json.dumps(d)) for feed, stamp, docs in files for k, d in enumerate(docs)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "record_id bigint, feed string, file_name string, position int, payload string")


def test_table_keeps_both_fields_of_a_record(spark):
    """One feed renames category to topic, another holds both; a record of an older schema stands among the new."""
    a1 = [{"id": f"document {k}", "category": f"c{k}"} for k in range(6)]
    a2 = [{"id": f"document {k}", "topic": f"c{k}"} for k in range(6)] + [{"id": "document 7", "category": "c7"}, {"id": "document 8", "category": "own", "topic": "other"}]
    b = [{"id": f"paper {k}", "category": f"d{k}", "topic": f"t{k}"} for k in range(5)] + [{"id": "paper 9", "topic": "t9"}]
    records = _rows(spark, [("a", "20240101_000000", a1), ("a", "20240102_000000", a2), ("b", "20240101_000000", b)])
    assert {(r.change, r.field, r.old_field) for r in S.changes(records).collect()} == {("renamed", "topic", "category")}
    rows = {r.id: r for r in S.consistent_table(records).where("feed = 'b' or file_name like '%02_000000.json'").collect()}
    assert set(S.consistent_table(records).columns) == {"record_id", "feed", "file_name", "position", "id", "category", "topic"}
    own = "category"  # held by as many records as topic, and first by name
    assert rows["document 3"][own] == "c3" and rows["document 7"][own] == "c7"
    assert (rows["document 8"].category, rows["document 8"].topic) == ("own", "other")
    assert all((rows[f"paper {k}"].category, rows[f"paper {k}"].topic) == (f"d{k}", f"t{k}") for k in range(5))
    assert (rows["paper 9"].category, rows["paper 9"].topic) == (None, "t9")


def test_documents_without_rare_values_are_linked(spark):
    """No value is rare or long, and every record stands three times; combinations of fields link the documents."""
    docs = [{"a": k % 4, "b": k // 4 % 4, "c": k // 16, "d": 1, "e": "x", "f": "y", "mark": "p" if k % 3 else "q"} for k in range(48)]
    new = [{"sign" if n == "mark" else n: v for n, v in d.items()} for d in docs]
    records = _rows(spark, [("a", "20240101_000000", docs * 3), ("a", "20240102_000000", new * 3)])
    assert [(r.change, r.field, r.old_field) for r in S.changes(records).collect()] == [("renamed", "sign", "mark")]


def test_a_path_that_is_value_and_object(spark):
    records = _rows(spark, [("a", "20240101_000000", [{"x": "v"}, {"x": {"y": 1}}, {"x": 3}]), (None, "20240101_000000", [{"x": None}])])
    rows = sorted((r.position, r.x, r.x_y) for r in S.consistent_table(records).where("feed = 'a'").collect())
    assert rows == [(0, "v", None), (1, None, 1.0), (2, "3", None)]
