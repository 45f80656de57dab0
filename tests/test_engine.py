"""Vectors, retrieval, ingest, limits and pipelines; and every query with SQL against DuckDB on the smallest data."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomline.functions import dates
from loomline.operators import ingest, retrieval, vector
from loomline.plans import pipelines
from loomline.streaming import limits

DATA = os.environ.get("LOOMLINE_TEST_DATA", "/root/testdata/sf0.001")


def test_dates(spark):
    values = {
        "2024-01-05": "2024-01-05 00:00:00", "2024-01-05T03:04:05": "2024-01-05 03:04:05", "2024-01-05T03:04:05.123456": "2024-01-05 03:04:05.123456", "2024-01-05T03:04:05Z": "2024-01-05 03:04:05",
        "2024-01-05T03:04:05+01:00": "2024-01-05 03:04:05", "05/01/2024": "2024-01-05 00:00:00", "5-1-2024": "2024-01-05 00:00:00", "2024-01-05T03:04:05-05:00": None, "31/02/2024": None, "junk": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in values], "v string")
    as_of = F.lit("2024-01-06 02:00:00").cast("timestamp_ntz")
    got = {r.v: r for r in df.select("v", dates.document_date(F.col("v")).cast("string").alias("d"), dates.elapsed_days(dates.document_date(F.col("v")), as_of).alias("n"), dates.display_date(F.col("v")).alias("s")).collect()}
    assert {k: r.d for k, r in got.items()} == values
    assert got["2024-01-05T03:04:05"].n == 0 and got["05/01/2024"].n == 1 and got["junk"].s == "junk" and got["05/01/2024"].s == "05 January 2024"


def test_top_k_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist(), int(k % 3)) for k in range(200)] + [(500, None, 0), (501, [], 0), (502, [0.0] * 8, 0), (503, [1.0] * 4, 0), (504, [1.0] * 8, 1), (505, [2.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = df.where("vec_id % 50 = 0 or vec_id > 500").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    good = {k: (np.array(v, np.float32).astype(float), lab) for k, v, lab in rows if v and np.linalg.norm(v)}

    def plain(equal, threshold):
        out = []
        for q, (v, lab) in good.items():
            if q % 50 and q <= 500:
                continue
            s = sorted(((round(float(w @ v / np.linalg.norm(w) / np.linalg.norm(v)), 12), -k) for k, (w, b) in good.items() if len(w) == len(v) and (not equal or b == lab)), reverse=True)
            out += [(q, -k, n + 1) for n, (x, k) in enumerate(s[:3]) if threshold is None or x >= threshold]
        return sorted(out)

    for equal, threshold in ((None, None), ("label", None), (None, 0.3)):
        got = vector.top_k(df, queries, 3, threshold, equal=equal).collect()
        assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == plain(equal, threshold)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many batches a task, many blocks of queries
    monkeypatch.setattr(vector, "BLOCK", 3)
    for equal, threshold in ((None, None), ("label", None), (None, 0.3)):
        got = vector.top_k(df, queries, 3, threshold, equal=equal).collect()
        assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == plain(equal, threshold)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert math.isclose(spark.range(1).select(vector.cosine(a, b)).first()[0], 0.5**0.5)
    assert vector.top_k(df.limit(0), queries).count() == 0 and vector.top_k(df, queries.limit(0)).count() == 0


def test_retrieval(spark):
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (2, 3, 0.5)], "query_id int, doc_id int, score double")
    docs = spark.createDataFrame([(1, "t1", "s", "T", "u", "2020-01-01"), (2, "t2", None, None, None, None), (3, "t3", "s", "", "", "2024-01-01")], "doc_id int, text string, source string, title string, url string, document_date string")
    as_of = F.lit("2024-06-01").cast("timestamp_ntz")
    got = {r.query_id: r for r in retrieval.retrieve(hits, docs, as_of, 365).collect()}
    assert got[1].context == "[Документ 1]\nДжерело: s\nДата документа: 01 January 2024\nt3\n\n[Документ 2]\nДжерело: Unknown\nt2\n"
    assert got[1].found_documents == 2 and math.isclose(got[1].confidence, 0.75) and got[1].sources[0].text == "t3..."
    assert [s.text for s in retrieval.retrieve(hits.where("query_id = 1"), docs, by_date=False).first().sources] == ["t1...", "t2...", "t3..."]
    queries = spark.createDataFrame([(1,), (9,)], "query_id int")
    empty = retrieval.with_empty(queries, retrieval.retrieve(hits, docs)).where("query_id = 9").first()
    assert (empty.context, empty.found_documents, empty.confidence) == ("", 0, 0.0)


def test_ingest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), (None, 1, "z"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(map(str, ingest.latest(df, ["k"], ["n"]).select("v").collect())) == sorted(map(str, df.where("k is null or v = 'y' or k = 'b'").select("v").collect()))
    new = spark.createDataFrame([("a", 3, "new"), ("a", 2, "old"), ("c", 1, "c")], "k string, n int, v string")
    assert {(r.k, r.v) for r in ingest.upsert(df.where("k is not null and n = 1"), new, ["k"], ["n"]).collect()} == {("a", "new"), ("b", None), ("c", "c")}
    raw = spark.createDataFrame([(" t ", None), ("", "c"), (None, " "), (None, None)], "text string, content string")
    assert [r.text for r in ingest.normalise_documents(raw).collect()] == ["t", "c"]
    stats = ingest.ingest_statistics(spark.createDataFrame([], "source string, document_type string"), spark.createDataFrame([], "text string, stored boolean"), "a", "b").first()
    assert stats.documents_loaded == 0 and not stats.success


TRACE = [0, 1, 2, 3, 4, 5, 59, 60, 61, 62]


def test_rate_limit(spark):
    events = spark.createDataFrame([(k, 7, float(t)) for k, t in enumerate(TRACE)] + [(100, None, 0.0)], "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.admitted for r in limits.rate_limit(events).collect()}
    assert [got[k] for k in range(10)] == [True] * 5 + [False] * 2 + [True] * 3 and 100 not in got
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 3), float(rng.randint(0, 400))) for k in range(400)]
    want, logs = {}, {}
    for k, u, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = [x for x in logs.get(u, []) if t - x < 60]
        want[k] = len(log) < 5
        logs[u] = log + [t] * want[k]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.event_id: r.admitted for r in limits.rate_limit(df).collect()} == want
    assert limits.rate_limit(df.limit(0)).count() == 0


def test_stream_rate_limit(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(k, 7, float(t)) for k, t in enumerate(TRACE)], "event_id long, user_id long, s double")
    for part in (F.col("s") < 5, F.col("s") >= 5):
        rows.where(part).select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = limits.stream_rate_limit(stream, window=60.0).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.event_id: r.admitted for r in spark.table("admitted").collect()}
    assert len(got) == 10 and sum(got.values()) == 8


def test_transitions(spark):
    rows = [(1, 1, "left"), (1, 2, "member"), (1, 3, "member"), (1, 4, "left"), (2, 1, "administrator")]
    got = [(r.u, r.t, r.change) for r in limits.transitions(spark.createDataFrame(rows, "u int, t int, s string"), ["u"], "s", "t").orderBy("u", "t").collect()]
    assert got == [(1, 1, "other"), (1, 2, "joined"), (1, 4, "left"), (2, 1, "joined")]


def test_pipeline(spark):
    docs = spark.createDataFrame([("Visas are extended at the city office. Bring a passport.", "u1", "s", "Visa"), ("Schools enrol children in autumn. Ask the school.", "u2", "s", "School")], "text string, url string, source string, title string")
    points = pipelines.index_documents(docs, 64)
    questions = spark.createDataFrame([(1, "Where are visas extended at the office?"), (2, "zzz"), (3, "Як отримати NI number?")], "query_id int, question string")
    marked = pipelines.answer(questions, points, 64, k=1, threshold=0.3, fallback=lambda q: F.lit("general"))
    got = {r.query_id: r for r in marked.collect()}
    assert got[1].reply.startswith("Visas are extended") and got[2].reply == "" and got[2].confidence == 0 and got[3].intent == "work" and got[2].intent == "general"
    messages = spark.createDataFrame([(1, "@b hi there", "group", False, False, False), (2, "hi", "group", False, False, False), (3, "/x", "private", True, False, False), (4, " ", "private", False, False, False)], "user_id int, text string, chat_type string, is_command boolean, is_edited boolean, is_reply boolean")
    assert {(r.user_id, r.question, r.rejected) for r in pipelines.gate_messages(messages, "b").collect()} == {(1, "hi there", ""), (4, "", "empty_message")}


def _same(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_same, v)) + "]"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    want = sorted("|".join(_same(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted("|".join(_same(r[c]) for c in sorted(columns)) for r in df.collect()) == want
