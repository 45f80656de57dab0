"""The queries of the llm operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import boilerplate, budget, language, leakage, packing, repeats, residue, splitting
from loomline.session import table


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("run_words").alias("longest_run"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.detect(table(spark, sf_dir, "documents")).select("doc_id")


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.detect(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_occurrences(table(spark, sf_dir, "documents"))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_keys(table(spark, sf_dir, "documents"))
    return found.groupBy(F.col("__source").alias("source")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("n_docs").cast("long").alias("n_docs"),
        F.sum("n_clusters").cast("long").alias("n_clusters"),
        F.sum("n_dates").cast("long").alias("n_dates"),
        F.count_if((F.col("n_clusters") >= repeats.MIN_CLUSTERS) & (F.col("n_dates") >= repeats.MIN_DATES)).alias("n_removed"),
        F.max("source_docs").alias("source_docs"),
    )


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "source", "text", "n_removed")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.wrong_labels_and_foreign_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))
    return found.select("doc_id", "line_no", "lang")


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"), skip_residue=False)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents"), table(spark, sf_dir, "page_cache")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)
    return boilerplate.pages_of(docs, "documents", "doc_id", "text", F.coalesce("source", host)).unionByName(
        boilerplate.pages_of(cache, "page_cache", "page_id", "content", F.coalesce("metadata.source", host))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.page_furniture(_pages(spark, sf_dir))


def p2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boilerplate.infer_wrappers(boilerplate.streams(_pages(spark, sf_dir)))
    return found.select("host", "pages", F.size("places").alias("n_places"), F.size(F.array_distinct("places")).alias("n_template_lines"))


def p2_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_content(_pages(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.oversized_pieces(table(spark, sf_dir, "chunks"))
    return cut.where("piece = 1").select("chunk_id")  # an oversized item has a second piece, exactly once


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.rechunk(table(spark, sf_dir, "chunks"))


def p4_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their new positions as columns."""
    m = F.col("metadata")
    return splitting.rechunk(table(spark, sf_dir, "chunks")).select("chunk_id", "piece", "text", m["chunk_index"].alias("chunk_index"), m["total_chunks"].alias("total_chunks"), m["start_char"].alias("start_char"), m["end_char"].alias("end_char"))


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.token_budget(table(spark, sf_dir, "documents"))


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.document_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_wrappers, p2_main, p3_found, p3_lines, p3_clean, p4_found, p4_pieces, p4_positions, p6_budget, p6_tokens, p8_packed, p8_fill, p9_found, p9_report, p10_found, p10_report)
}

_P3_LINES = r"""
l AS (
  SELECT d.doc_id, d.source, d.text, u.i - 1 AS line_no, u.line,
         lower(regexp_replace(u.line, '[^\p{L}]+', '', 'g')) AS letters
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents WHERE source IS NOT NULL) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS i) u
),
n AS (SELECT source, count(*) AS source_docs FROM documents WHERE source IS NOT NULL GROUP BY source),
d AS (SELECT doc_id, string_agg(letters, chr(10) ORDER BY line_no) AS lines FROM l WHERE length(letters) >= 3 GROUP BY doc_id),
f AS (SELECT l.source, d.lines, min(CAST(timezone('UTC', x.scraped_at) AS DATE)) AS day FROM d JOIN (SELECT DISTINCT doc_id, source FROM l) l USING (doc_id) JOIN documents x USING (doc_id) GROUP BY l.source, d.lines),
k AS (
  SELECT l.source, l.letters, count(DISTINCT l.doc_id) AS n_docs, count(DISTINCT d.lines) AS n_clusters, count(DISTINCT f.day) AS n_dates, any_value(n.source_docs) AS source_docs
  FROM l JOIN n USING (source) JOIN d USING (doc_id) JOIN f ON f.source = l.source AND f.lines = d.lines WHERE length(l.letters) >= 3
  GROUP BY l.source, l.letters
  HAVING count(DISTINCT l.doc_id) >= 5 AND count(DISTINCT l.doc_id) >= 0.06 * any_value(n.source_docs)
)
"""

#: Spaces as the tokens of problem 4 see them.
_SPACE = r"[\s\x0b\x0c\x1c-\x1f\x{85}\p{Z}]"
_LEVEL = "list_last([x FOR x IN {0} IF x <= s + 500])"
_FITS = "CASE WHEN {0} >= s + 250 AND {0} > reached THEN {0} END"
_P4 = rf"""
WITH RECURSIVE o AS (SELECT chunk_id, text FROM chunks WHERE length(text) > 500 AND length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) > 500),
c AS (SELECT chunk_id, unnest(generate_series(1, length(text))) AS i, unnest(string_split(text, '')) AS ch FROM o),
w AS (SELECT chunk_id, i, regexp_full_match(ch, '{_SPACE}') AS sp FROM c),
e AS (SELECT *, coalesce(lag(sp) OVER g, true) AS before, coalesce(lead(sp) OVER g, true) AS after FROM w WINDOW g AS (PARTITION BY chunk_id ORDER BY i)),
a AS (SELECT chunk_id, i - 1 AS a, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS k FROM e WHERE NOT sp AND before),
b AS (SELECT chunk_id, i AS b, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS k FROM e WHERE NOT sp AND after),
t AS (SELECT a.chunk_id, a.k, a.a, b.b, substring(o.text, b.b + 1, coalesce(lead(a.a) OVER (PARTITION BY a.chunk_id ORDER BY a.k) - b.b, 0)) AS gap, substring(o.text, greatest(a.a, b.b - 6) + 1, b.b - greatest(a.a, b.b - 6)) AS tail
  FROM a JOIN b ON a.chunk_id = b.chunk_id AND a.k = b.k JOIN o ON o.chunk_id = a.chunk_id),
v AS (SELECT *, CASE WHEN length(gap) - length(replace(gap, chr(10), '')) > 1 THEN 0 WHEN contains(gap, chr(10)) THEN 1 END AS line,
  CASE WHEN regexp_matches(tail, '[.!?…]["''»”’)\]]*$') THEN 2 WHEN regexp_matches(tail, '[;:,—–)]["''»”’)\]]*$|^[—–-]$') THEN 3 END AS mark FROM t),
l AS (SELECT chunk_id, list(a ORDER BY k) AS starts, list(b ORDER BY k) AS ends, coalesce(list(b ORDER BY k) FILTER (line = 0), []) AS l0, coalesce(list(b ORDER BY k) FILTER (line = 1), []) AS l1,
  coalesce(list(b ORDER BY k) FILTER (mark = 2), []) AS l2, coalesce(list(b ORDER BY k) FILTER (mark = 3), []) AS l3, max(b) AS most FROM v GROUP BY chunk_id),
r AS (
  SELECT l.*, 0 AS n, starts[1] AS s, 0::BIGINT AS reached, NULL::BIGINT AS out_s, NULL::BIGINT AS out_e, false AS done FROM l
  UNION ALL
  SELECT chunk_id, starts, ends, l0, l1, l2, l3, most, n + 1,
    CASE WHEN most <= s + 500 THEN s WHEN e IS NOT NULL THEN [x FOR x IN starts IF x >= greatest(e - 50, s + 1)][1] WHEN s < fresh AND fresh >= reached THEN fresh ELSE s + 450 END,
    CASE WHEN most <= s + 500 THEN reached WHEN e IS NOT NULL THEN e WHEN s < fresh AND fresh >= reached THEN reached ELSE s + 500 END,
    CASE WHEN most > s + 500 AND e IS NULL AND s < fresh AND fresh >= reached THEN NULL ELSE s END,
    CASE WHEN most <= s + 500 THEN most WHEN e IS NOT NULL THEN e WHEN s < fresh AND fresh >= reached THEN NULL ELSE s + 500 END, most <= s + 500
  FROM (SELECT *, coalesce({", ".join(_FITS.format(_LEVEL.format(f"l{k}")) for k in range(4))}, CASE WHEN {_LEVEL.format("ends")} > greatest(s, reached) THEN {_LEVEL.format("ends")} END) AS e,
      starts[len([x FOR x IN ends IF x <= reached]) + 1] AS fresh FROM r WHERE NOT done)
),
p AS (SELECT chunk_id, out_s, out_e, row_number() OVER (PARTITION BY chunk_id ORDER BY n) - 1 AS k FROM r WHERE out_s IS NOT NULL),
q AS (SELECT x.chunk_id, x.doc_id, x.run_id, x.text, x.metadata, coalesce(max(p.k) + 1, 1) AS n FROM chunks x LEFT JOIN p USING (chunk_id) GROUP BY ALL),
z AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, run_id ORDER BY metadata.chunk_index NULLS FIRST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(n) OVER (PARTITION BY doc_id, run_id) AS total FROM q)
SELECT z.chunk_id, coalesce(p.k, 0)::INTEGER AS piece, CASE WHEN p.k IS NULL THEN z.text ELSE substring(z.text, p.out_s + 1, p.out_e - p.out_s) END AS text, (first + coalesce(p.k, 0))::INTEGER AS chunk_index, total::INTEGER AS total_chunks,
  (CASE WHEN p.k IS NULL THEN metadata.start_char ELSE coalesce(metadata.start_char, 0) + p.out_s END)::INTEGER AS start_char, (CASE WHEN p.k IS NULL THEN metadata.end_char ELSE coalesce(metadata.start_char, 0) + p.out_e END)::INTEGER AS end_char
FROM z LEFT JOIN p USING (chunk_id)"""

ORACLE: dict[str, str] = {
    "p4_positions": _P4,
    "p4_found": "SELECT chunk_id FROM chunks WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 500",
    "p3_found": f"WITH {_P3_LINES} SELECT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no FROM l JOIN k ON l.source = k.source AND l.letters = k.letters",
    "p3_lines": f"""WITH {_P3_LINES}
SELECT source, count(*) AS n_lines, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n_clusters) AS BIGINT) AS n_clusters,
       CAST(sum(n_dates) AS BIGINT) AS n_dates, count(*) FILTER (n_clusters >= 5 AND n_dates >= 2) AS n_removed, max(source_docs) AS source_docs FROM k GROUP BY source""",
    "p3_clean": f"""WITH {_P3_LINES},
r AS (SELECT l.doc_id, l.line_no FROM l JOIN k ON l.source = k.source AND l.letters = k.letters WHERE k.n_clusters >= 5 AND k.n_dates >= 2),
a AS (
  SELECT d.doc_id, u.i - 1 AS line_no, u.line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS i) u
),
kept AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.line_no) AS text FROM a ANTI JOIN r ON a.doc_id = r.doc_id AND a.line_no = r.line_no GROUP BY a.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(c.n, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
