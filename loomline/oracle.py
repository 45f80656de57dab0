"""DuckDB text of the core queries, written apart from the Spark plans they check."""

from __future__ import annotations

from loomline.functions import html as H
from loomline.functions import text as T
from loomline.operators.timestamps import MONTHS
from loomline.sources.tools import COMMUNITY_HEALTH, EXCLUDED, OFFICIAL_HOUSING, Topics

_AS_OF = "TIMESTAMP '2025-06-01 00:00:00'"
_WS = r"[\s\x0b\x0c\x1c-\x1f\x{85}\p{Z}]"
_CLEAN = rf"trim(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), ' ')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _score(column: str, words: list[str]) -> str:
    return "coalesce(" + " + ".join(f"contains(lower({column}), {_quoted(w)})::INT" for w in words) + ", 0)"


_SCORES = {name: _score("title", words) for name, words in T.INTENTS.items()}
_BEST = "greatest(" + ", ".join(_SCORES.values()) + ")"


def _topic(rules: list[tuple[str, list[str]]]) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower(url), {_quoted(p)})" for p in parts) + f" THEN '{topic}'" for topic, parts in rules)
    return f"CASE WHEN url IS NULL THEN NULL {cases} ELSE 'general' END"


def _any(words: list[str]) -> str:
    return ", ".join(_quoted(w) for w in words)


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
_PAIRS = """
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, {extra} list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {where}
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s {having})
"""
_HITS = "SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= {k}"
_DATE = "coalesce(" + ", ".join(
    f"try_strptime(split_part(split_part(metadata.document_date, '+', 1), 'Z', 1), '{f}')"
    for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y")
) + ")"
_AGE = f"CAST(floor((epoch({_AS_OF}) - epoch({_DATE})) / 86400) AS INTEGER)"
_FRESH = f"date_diff('second', try_cast(scraped_at AS TIMESTAMP), {_AS_OF})"
_LINES = "string_split(text, chr(10))"
_URL_TRIM = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
_TRUNCATED = """
CASE WHEN length(text) <= 3800 THEN text ELSE
  substring(text, 1, CASE WHEN b > 3040 THEN b + 1 ELSE 3800 END) || chr(10) || chr(10) || '...(повідомлення скорочено через обмеження довжини)' END
"""



def _packed(name: str, parts: str, gap: int, glue: str, back: str, room: str, lost: str) -> str:
    """CTEs {name}(unit, seg, c, first_k, text, s, e): the parts of each unit (unit, k, t) packed by recursion; parts over 500 are left to others."""
    return f"""
{name}_g AS (SELECT *, length(t) AS n, count(*) FILTER (length(t) > 500) OVER (PARTITION BY unit ORDER BY k) AS seg FROM {parts}),
{name}_b AS (SELECT unit, seg, k FROM {name}_g WHERE n > 500),
{name}_p AS (SELECT unit, seg, k, t, n, sum(n + {gap}) OVER (PARTITION BY unit, seg ORDER BY k) AS p FROM {name}_g WHERE n <= 500),
{name}_l AS (SELECT unit, seg, min(k) AS first_k, list(t ORDER BY k) AS ts, list(n ORDER BY k) AS ns, list_prepend(0::HUGEINT, list(p ORDER BY k)) AS ps FROM {name}_p GROUP BY unit, seg),
{name}_r AS (
  SELECT unit, seg, first_k, ts, ns, ps, 0 AS c, 0::BIGINT AS a, 0::BIGINT AS f, greatest(len([x FOR x IN ps IF x <= 500]) - 1, 1)::BIGINT AS e, 0::HUGEINT AS pos FROM {name}_l
  UNION ALL
  SELECT unit, seg, first_k, ts, ns, ps, c + 1, b, e, greatest(len([x FOR x IN ps IF x <= ps[b + 1] + 500 + {room}]) - 1, e + 1)::BIGINT, pos + ps[b + 1] - ps[a + 1] - {lost}
  FROM (SELECT *, {back} AS b FROM {name}_r WHERE e < len(ts))
),
{name} AS (SELECT unit, seg, c, first_k, array_to_string(ts[a + 1:e], {glue}) AS text, pos FROM {name}_r)"""


def _windows(name: str, units: str) -> str:
    """CTE {name}(unit, k, s, e, text): windows of 500 every 450 over the oversized parts (unit, k, t)."""
    return f"""
{name}_s AS (SELECT unit, k, t, unnest(generate_series(0, length(t) - 1, 450)) AS s FROM {units} WHERE length(t) > 500),
{name} AS (SELECT unit, k, s, least(s + 500, length(t)) AS e, trim(substring(t, (s + 1)::BIGINT, 500), ' ' || chr(10)) AS text FROM {name}_s)"""


#: The overlap of sentences: back to the first whose prefix sum is within it; of paragraphs: the last one, if it fits.
_BACK_SENTENCE = "greatest(a, least(e, len([x FOR x IN ps IF x < ps[e + 1] - 51])))"
_SENTENCES = _packed("q", "u", 1, "' '", _BACK_SENTENCE, "0", "1")
_PARTS = r"[trim(x, ' ' || chr(10)) FOR x IN string_split(regexp_replace({t}, '([.!?…])\s+([А-ЯІЇЄҐA-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) IF trim(x, ' ' || chr(10)) <> '']"


def _unnested(units: str, parts: str) -> str:
    return f"SELECT unit, unnest(generate_series(1, len(ps))) AS k, unnest(ps) AS t FROM (SELECT unit, {parts} AS ps FROM {units})"


_SENTENCE_CHUNKS = f"""
u AS ({_unnested("d", _PARTS.format(t="t"))}),{_SENTENCES},{_windows("w", "u")},
sentence_chunks AS (
  SELECT q.unit, q.text, q.pos + coalesce(length(b.t), 0) AS s, q.first_k AS k, q.c FROM q LEFT JOIN (SELECT g.unit, g.seg, g.t FROM q_g g WHERE n > 500) b ON b.unit = q.unit AND b.seg = q.seg
  UNION ALL SELECT unit, text, s, k, s FROM w WHERE text <> '')"""
_CHUNK_ROWS = """
SELECT unit AS doc_id, text, (row_number() OVER (PARTITION BY unit ORDER BY {order}) - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY unit))::INTEGER AS total_chunks,
  s::INTEGER AS start_char, {end}::INTEGER AS end_char FROM {rows}"""


#: Problem 5: the families of formats, with groups in the order year|month|day|hour|minute|second|half of the day|zone.
_TIME_ZONE = r"((?:UTC|GMT|utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|\[?[A-Za-z]+/[A-Za-z_]+\]?|[A-Z]{1,5}|z)?"
_TIME_CLOCK = r"(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,]\d+)?)? ?([AaPp]\.?[Mm]\.?)? ?"
_TIME_FORMS = (
    (rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt ] ?{_TIME_CLOCK}{_TIME_ZONE})?", r"\1|\2|\3|\4|\5|\6|\7|\8"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:[.,]\d+)? ?{_TIME_ZONE}", r"\1|\2|\3|\4|\5|\6||\7"),
    (rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?: ?[рг]\.)?(?:,? ?(?:[Tt]|о|at|в)? ?{_TIME_CLOCK}{_TIME_ZONE})?", r"\3|\2|\1|\4|\5|\6|\7|\8"),
    (rf"(?:\p{{L}}+\.?,? )?(\d{{1,2}})(?:st|nd|rd|th)?\.?[ -](?:of )?(\p{{L}}+)\.?,?[ -](\d{{4}})(?: ?(?:року|года|р|г|r)\.?)?(?:,? ?(?:о|об|в|at|godz\.|ora)? ?{_TIME_CLOCK}{_TIME_ZONE})?",
     r"\3|\2|\1|\4|\5|\6|\7|\8"),
    (rf"(?:\p{{L}}+\.?,? )?(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? ?(?:at)? ?{_TIME_CLOCK}{_TIME_ZONE})?", r"\3|\1|\2|\4|\5|\6|\7|\8"),
)
_TIME_MONTH = ", ".join(f"list_position([{_any(names.split())}], lower(f[2]))" for names in MONTHS.values())
_TIMES = rf"""
WITH v AS (
  SELECT 'ingested_docs' AS rec_table, record_id AS rec_id, 'last_updated' AS field, metadata.last_updated AS value FROM ingested_docs
  UNION ALL SELECT 'ingested_docs', record_id, 'scraped_at', metadata.scraped_at FROM ingested_docs
  UNION ALL SELECT 'page_cache', page_id, 'publication_date', metadata.publication_date FROM page_cache),
t AS (SELECT * EXCLUDE value, trim(regexp_replace(value, '[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{feff}}]+', ' ', 'g')) AS s FROM v WHERE value IS NOT NULL),
p AS (SELECT *, string_split(CASE {" ".join(f"WHEN regexp_full_match(s, {_quoted(x)}) THEN regexp_replace(s, {_quoted("^" + x + "$")}, {_quoted(order)})" for x, order in _TIME_FORMS)} END, '|') AS f,
  try_cast(regexp_extract(s, '^(-?\d{{1,17}})(?:\.\d*)?$', 1) AS BIGINT) AS digits FROM t),
m AS (SELECT *, coalesce(try_cast(f[2] AS INTEGER), {_TIME_MONTH}) AS month, try_cast(f[4] AS INTEGER) AS h, try_cast(f[5] AS INTEGER) AS mi, coalesce(try_cast(f[6] AS INTEGER), 0) AS se,
  upper(substring(f[7], 1, 1)) AS half, upper(trim(f[8], '[]')) AS zone FROM p),
d AS (SELECT *, try_cast(f[1] || '-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(f[3], 2, '0') AS DATE) AS day,
  CASE WHEN half = '' THEN h WHEN NOT h BETWEEN 1 AND 12 THEN NULL WHEN half = 'A' THEN h % 12 ELSE h % 12 + 12 END AS hour, regexp_replace(zone, '^(UTC|GMT)([+-])', '\2') AS signed FROM m),
w AS (SELECT *, CASE WHEN hour <= 23 AND mi <= 59 AND se <= 59 THEN epoch(day)::BIGINT + hour * 3600 + mi * 60 + se END AS wall,
  CASE WHEN regexp_full_match(signed, '[+-]\d{{1,2}}(:?\d{{2}})?') THEN (CASE WHEN signed[1] = '-' THEN -1 ELSE 1 END) *
      (CASE WHEN length(regexp_replace(signed, '\D', '', 'g')) > 2 THEN regexp_extract(signed, '(\d{{1,2}}?):?(\d{{2}})$', 1)::INTEGER * 3600 + regexp_extract(signed, '(\d{{2}})$', 1)::INTEGER * 60
       ELSE regexp_extract(signed, '\d+')::INTEGER * 3600 END) END AS stated,
  CASE zone WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'WET' THEN 0 WHEN 'BST' THEN 3600 WHEN 'WEST' THEN 3600 WHEN 'CET' THEN 3600 WHEN 'CEST' THEN 7200
    WHEN 'EET' THEN 7200 WHEN 'EEST' THEN 10800 WHEN 'MSK' THEN 10800 END AS short,
  CASE WHEN zone IN ('', 'EUROPE/LONDON') THEN 0 WHEN zone IN ('EUROPE/KYIV', 'EUROPE/KIEV') THEN 7200 END AS std,
  epoch(make_date(year(day), 3, 31) - dayofweek(make_date(year(day), 3, 31))::INTEGER)::BIGINT + 3600 AS spring, epoch(make_date(year(day), 10, 31) - dayofweek(make_date(year(day), 10, 31))::INTEGER)::BIGINT + 3600 AS autumn FROM d),
u AS (SELECT *, CASE WHEN day IS NOT NULL AND f[4] = '' THEN 'date' WHEN digits IS NOT NULL THEN 'epoch' WHEN wall IS NULL THEN NULL WHEN coalesce(stated, short) IS NOT NULL THEN 'fixed'
    WHEN std IS NULL THEN NULL WHEN wall - std - spring BETWEEN 0 AND 3599 THEN 'nonexistent' WHEN wall - std - autumn BETWEEN 0 AND 3599 THEN 'ambiguous' ELSE 'direct' END AS status,
  CASE WHEN wall - std - 3600 >= spring AND wall - std - 3600 < autumn THEN std + 3600 ELSE std END AS ruled FROM w),
x AS (SELECT rec_table, rec_id, field, status, CASE WHEN status = 'date' THEN day::VARCHAR
    ELSE strftime(make_timestamp(1000000 * CASE WHEN status = 'epoch' THEN CASE WHEN abs(digits) >= 100000000000 THEN floor(digits / 1000)::BIGINT ELSE digits END ELSE wall - coalesce(stated, short, ruled) END), '%Y-%m-%dT%H:%M:%SZ') END AS utc
  FROM u WHERE status IS NOT NULL)
"""


_SPLIT_LINES = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"


def _topic_path(topic: str, topics: Topics) -> str:
    before, after = topics.pattern.split("{}")
    known = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in topics.known.items())
    other = f"{_quoted(before)} || {topic} || {_quoted(after)}"
    return f"CASE WHEN coalesce({topic}, '') = '' THEN {_quoted(topics.default)} WHEN starts_with({topic}, '/') THEN {topic} ELSE " + (f"CASE lower({topic}) {known} ELSE {other} END" if known else other) + " END"


def _mentions(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_quoted(w)})" for w in words) + ")"


_LINK = "'- [' || x.\"text\" || '](' || x.href || ')'"
_TOOL_PAGE = f"""'# ' || coalesce(title, 'Untitled') || chr(10) || chr(10) || '**Source:** ' || url || chr(10) || chr(10) || '## Content' || chr(10) || coalesce(content, '') ||
  CASE WHEN coalesce(len(links), 0) > 0 THEN chr(10) || chr(10) || '## Links' || chr(10) || array_to_string([{_LINK} FOR x IN links[1:10]], chr(10)) ELSE '' END"""
_ONE_COPY = "SELECT * FROM page_cache QUALIFY row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, page_id DESC) = 1"
#: The link to the next page: the first that says so, or has another address with "page" in it.
_NEXT = f"""[x.href FOR x IN links IF (contains(lower(x.href), 'page') AND x.href <> url) OR {_mentions('x."text"', T.NEXT_PAGE)}][1]"""
_CHAIN = f"""
WITH RECURSIVE o AS ({_ONE_COPY}), n AS (SELECT url, {_NEXT} AS next_url FROM o WHERE url IS NOT NULL),
c AS (
  SELECT url AS start_url, url, [url] AS seen, 1 AS page_no FROM n
  UNION ALL SELECT c.start_url, n.next_url, list_append(c.seen, n.next_url), c.page_no + 1 FROM c JOIN n ON n.url = c.url
  WHERE c.page_no < 5 AND n.next_url IS NOT NULL AND NOT list_contains(c.seen, n.next_url) AND n.next_url IN (SELECT url FROM n))
"""
_FRESH_COPY = f"SELECT * FROM page_cache WHERE {_FRESH} <= 31536000 QUALIFY row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, page_id DESC) = 1"
_READ = f"""
WITH u AS (SELECT DISTINCT metadata.url AS url FROM ingested_docs WHERE metadata.url IS NOT NULL), h AS ({_FRESH_COPY}),
f AS (SELECT u.url, CASE WHEN h.url IS NOT NULL THEN h.title WHEN length(u.url) % 2 = 1 THEN 'Page' END AS title, h.url IS NOT NULL AS cached, coalesce(h.scraped_at, '2025-06-01T00:00:00') AS scraped_at,
    CASE WHEN h.url IS NOT NULL THEN len(h.links) WHEN length(u.url) % 2 = 1 THEN 1 END::INTEGER AS n_links, CASE WHEN h.url IS NULL AND length(u.url) % 2 = 0 THEN 'no content' END AS error
  FROM u LEFT JOIN h ON h.url = u.url)
"""


def _gate(text: str) -> str:
    """Why a message is not let through."""
    return f"""CASE WHEN {" OR ".join(f"regexp_matches(lower({text}), {_quoted(p)})" for p in T.SPAM)} THEN 'spam_detected' WHEN length({text}) > 4096 THEN 'message_too_long'
      WHEN {text} IS NULL OR {_strip(text)} = '' THEN 'empty_message' ELSE '' END"""


def _language(text: str) -> str:
    words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
    uk, ru = f"regexp_matches(lower({text}), '[{T.UKRAINIAN_LETTERS}]')", f"regexp_matches(lower({text}), '[{T.RUSSIAN_LETTERS}]')"
    n_uk, n_ru = (f"len([x FOR x IN {words} IF x IN ({_any(w)})])" for w in (T.UKRAINIAN_WORDS, T.RUSSIAN_WORDS))
    letters, cyrillic = rf"length(regexp_replace({text}, '[^\p{{L}}]+', '', 'g'))", rf"length(regexp_replace({text}, '[^\x{{0400}}-\x{{04FF}}]+', '', 'g'))"
    return f"""CASE WHEN {text} IS NULL OR {_strip(text)} = '' THEN 'unknown' WHEN {uk} AND NOT {ru} THEN 'uk' WHEN {ru} AND NOT {uk} THEN 'ru' WHEN {n_uk} > {n_ru} THEN 'uk'
      WHEN {n_ru} > {n_uk} THEN 'ru' WHEN {letters} > 0 AND {cyrillic} > 0.5 * {letters} THEN 'uk' ELSE 'unknown' END"""


def _intent(column: str) -> str:
    scores = {name: _score(column, words) for name, words in T.INTENTS.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    return f"CASE WHEN {best} < 1 THEN 'uncertain' " + " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in scores.items()) + " END"


#: Single marks to be escaped, by signs that stand in no text; each is done twice, as neighbouring ones share a sign.
_ONCE = rf"regexp_replace({{x}}, '(^|[^{_WORD}])_([^{_WORD}]|$)', '\1' || chr(4) || '\2', 'g')"
_STAR = r"regexp_replace({x}, '(^|[^*])\*([^*]|$)', '\1' || chr(3) || '\2', 'g')"
#: Brackets in front of no address, by signs that stand in no text.
_BRACKET = r"regexp_replace({x}, '\[([^\]\x01\x02]*)\]([^(]|$)', chr(1) || '\1' || chr(2) || '\2', 'g')"


def _twice(pattern: str, x: str) -> str:
    return pattern.replace("{x}", pattern.replace("{x}", x))

ORACLE: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_CLEAN} AS text FROM documents",
    "clean_lines": rf"""
WITH l AS (SELECT doc_id, [{_strip("x")} FOR x IN regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')] AS parts FROM documents)
SELECT doc_id, array_to_string([x FOR x IN parts IF x <> ''], chr(10)) AS text FROM l""",
    "sentences": rf"""
WITH c AS (SELECT doc_id, regexp_replace({_CLEAN}, '([.!?…])\s+([А-ЯІЇЄҐA-Z])', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
s AS (SELECT doc_id, [trim(x, ' ') FOR x IN string_split(t, chr(1)) IF trim(x, ' ') <> ''] AS parts FROM c)
SELECT doc_id, (unnest(generate_series(1, len(parts))) - 1)::INTEGER AS n, unnest(parts) AS sentence FROM s""",
    "chunk_fixed": f"""
WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents),
w AS (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 450)) AS s FROM c WHERE length(t) > 0),
k AS (SELECT doc_id, trim(substring(t, (s + 1)::BIGINT, 500), ' ') AS text, s::INTEGER AS start_char, least(s + 500, length(t))::INTEGER AS end_char FROM w)
SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1)::INTEGER AS chunk_index,
       (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, start_char, end_char FROM k WHERE text <> ''""",
    "chunk_stats": f"""
WITH c AS (SELECT lang, {_CLEAN} AS t FROM documents),
w AS (SELECT lang, t, unnest(generate_series(0, length(t) - 1, 450)) AS s FROM c WHERE length(t) > 0),
k AS (SELECT lang, trim(substring(t, (s + 1)::BIGINT, 500), ' ') AS text FROM w)
SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, min(length(text))::INTEGER AS least, max(length(text))::INTEGER AS most FROM k WHERE text <> '' GROUP BY lang""",
    "chunk_sentence": f"""
WITH RECURSIVE d AS (SELECT doc_id AS unit, {_CLEAN} AS t FROM documents),{_SENTENCE_CHUNKS},
ends AS (SELECT c.unit, c.text, c.s, c.k, c.c, coalesce(w.e, c.s + length(c.text)) AS e FROM sentence_chunks c LEFT JOIN w ON w.unit = c.unit AND w.k = c.k AND w.s = c.c AND w.s = c.s)
{_CHUNK_ROWS.format(order="k, c", end="e", rows="ends")}""",
    "chunk_paragraph": f"""
WITH RECURSIVE o AS (SELECT doc_id AS unit, trim(text, ' ') AS t FROM documents),
v AS (SELECT unit, unnest(generate_series(1, len(ps))) AS k, unnest(ps) AS t FROM (
  SELECT unit, [{_strip("x")} FOR x IN regexp_split_to_array(t, chr(10) || '{_WS}*' || chr(10)) IF {_strip("x")} <> ''] AS ps FROM o)),
{_packed("m", "v", 2, "chr(10) || chr(10)", "CASE WHEN ns[e] <= 50 THEN e - 1 ELSE e END", "2 * (e - b)", "2 * (1 - (e - b))").lstrip()},
d AS (SELECT unit * 1000000 + k AS unit, t FROM v WHERE length(t) > 500),{_SENTENCE_CHUNKS},
ends AS (SELECT c.unit, c.text, c.s, c.k, c.c, coalesce(w.e, c.s + length(c.text)) AS e FROM sentence_chunks c LEFT JOIN w ON w.unit = c.unit AND w.k = c.k AND w.s = c.c AND w.s = c.s),
last_end AS (SELECT unit, max_by(e, (k, c)) AS e FROM ends GROUP BY unit),
every AS (
  SELECT m.unit, m.text, m.pos + coalesce(z.e, 0) AS s, m.pos + coalesce(z.e, 0) + length(m.text) AS e, m.first_k AS k, 0 AS j, m.c FROM m
  LEFT JOIN m_b ON m_b.unit = m.unit AND m_b.seg = m.seg LEFT JOIN last_end z ON z.unit = m_b.unit * 1000000 + m_b.k
  UNION ALL SELECT unit // 1000000, text, s, e, unit % 1000000, k, c FROM ends)
{_CHUNK_ROWS.format(order="k, j, c", end="e", rows="every")}""",
    "p5_found": _TIMES + "SELECT rec_table, rec_id, field, utc FROM x",
    "p5_report": _TIMES + "SELECT rec_table, field, status, count(*) AS n, min(utc) AS first, max(utc) AS last FROM x GROUP BY rec_table, field, status",
    "p7_found": r"""
WITH r AS (SELECT record_id, feed, file_name, try_cast(payload AS JSON) AS p FROM raw_records WHERE json_type(try_cast(payload AS JSON)) = 'OBJECT'),
f AS (SELECT r.record_id, r.feed, r.file_name, substring(j.fullkey, 3) AS path,
    CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type, CASE j.type WHEN 'VARCHAR' THEN j.atom->>'$' ELSE j.value::VARCHAR END AS value
  FROM r, json_tree(r.p) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[')),
n AS (SELECT feed, file_name, count(*) AS n_records, lag(file_name) OVER (PARTITION BY feed ORDER BY file_name) AS before FROM r GROUP BY feed, file_name),
k AS (SELECT feed, file_name, path, type, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT k.feed, k.file_name, k.path, arg_max(k.type, (k.n, -list_position(['string', 'number', 'boolean', 'array'], k.type))) AS type
  FROM k JOIN n USING (feed, file_name) GROUP BY k.feed, k.file_name, k.path HAVING sum(k.n) >= 0.5 * any_value(n.n_records)),
c AS (SELECT n.feed, n.file_name, n.before, h.path, h.type FROM n JOIN h USING (feed, file_name) WHERE before IS NOT NULL),
o AS (SELECT n.feed, n.file_name, n.before, h.path, h.type FROM n JOIN h ON h.feed = n.feed AND h.file_name = n.before),
came AS (SELECT * FROM c ANTI JOIN o USING (feed, file_name, path)),
gone AS (SELECT * FROM o ANTI JOIN c USING (feed, file_name, path)),
pairs AS (SELECT DISTINCT came.feed, came.file_name, came.before FROM came JOIN gone USING (feed, file_name)),
votes AS (SELECT p.file_name, a.record_id AS old_id, b.record_id AS new_id, count(DISTINCT a.value) AS votes
  FROM pairs p JOIN f a ON a.feed = p.feed AND a.file_name = p.before JOIN f b ON b.feed = p.feed AND b.file_name = p.file_name AND b.value = a.value GROUP BY ALL),
links AS (SELECT file_name, old_id, arg_max(new_id, (votes, -new_id)) AS new_id FROM votes GROUP BY file_name, old_id HAVING max(votes) >= 4),
met AS (SELECT l.file_name, g.path AS old_field, m.path AS field, count(*) AS n, count(*) FILTER (a.value = b.value) AS same
  FROM links l JOIN gone g ON g.file_name = l.file_name JOIN came m ON m.file_name = l.file_name
  JOIN f a ON a.record_id = l.old_id AND a.path = g.path JOIN f b ON b.record_id = l.new_id AND b.path = m.path GROUP BY ALL),
renamed AS (SELECT * FROM met WHERE same > 0.5 * n AND same >= least(2, n))
SELECT file_name, 'renamed' AS change, field, old_field FROM renamed
UNION ALL SELECT file_name, 'added', path, '' FROM came ANTI JOIN renamed ON renamed.file_name = came.file_name AND renamed.field = came.path
UNION ALL SELECT file_name, 'removed', path, '' FROM gone ANTI JOIN renamed ON renamed.file_name = gone.file_name AND renamed.old_field = gone.path
UNION ALL SELECT file_name, 'type_changed', path, '' FROM c JOIN o USING (feed, file_name, path) WHERE c.type <> o.type""",
    "scan_json": f"""
SELECT {_strip("text")} AS text, metadata.source AS source, metadata.title AS title, metadata.url AS url, metadata.category AS category, metadata.language AS language,
  metadata.last_updated AS last_updated, metadata.scraped_at AS scraped_at, 'manual' AS document_type FROM ingested_docs WHERE {_strip("text")} <> ''""",
    "scan_text": f"""
SELECT {_strip("t")} AS text, 'manual' AS source, 'text' AS type, '2025-06-01 00:00:00' AS scraped_at FROM (SELECT max(coalesce(text, '')) AS t FROM ingested_docs GROUP BY run_id) WHERE {_strip("t")} <> ''""",
    "scan_markdown": f"""
SELECT 'Run ' || r AS title, {_strip("'first line' || chr(10) || '# Run ' || r || ' ' || chr(10) || t")} AS text, 'markdown' AS type
FROM (SELECT min(record_id) AS r, max(coalesce(text, '')) AS t FROM ingested_docs GROUP BY run_id)""",
    "migrated_documents": r"""
SELECT record_id, text, coalesce(metadata.document_date, CASE WHEN metadata.last_updated IS NULL THEN '2024-06-01'
    WHEN regexp_full_match(metadata.last_updated, '\d{4}-\d{1,2}-\d{1,2}') AND try_cast(metadata.last_updated AS DATE) IS NOT NULL THEN metadata.last_updated ELSE '2023-01-01' END) AS document_date
FROM ingested_docs WHERE text IS NOT NULL""",
    "official_pages": f"""
WITH p AS (SELECT page_id, title, [{_strip("x")} FOR x IN string_split(content, chr(10)) IF {_strip("x")} <> ''] AS parts FROM page_cache WHERE content IS NOT NULL)
SELECT page_id, CASE WHEN {_strip("coalesce(title, '')")} = '' THEN 'Untitled' ELSE {_strip("title")} END AS title,
  array_to_string(list_append([x FOR x IN parts IF length(x) >= 20 AND NOT {_mentions("x", list(H.OFFICIAL.phrases))}], '• an item of the list'), chr(10) || chr(10)) AS content, len(parts)::INTEGER AS num_paragraphs FROM p""",
    "community_pages": f"""
WITH p AS (SELECT page_id, [{_strip("x")} FOR x IN regexp_split_to_array(content, {_SPLIT_LINES}) IF {_strip("x")} <> ''] AS parts FROM page_cache WHERE content IS NOT NULL)
SELECT page_id, array_to_string(parts, chr(10)) AS content, length(array_to_string(parts, chr(10)))::INTEGER AS content_length FROM p WHERE length(array_to_string(parts, chr(10))) >= 100""",
    "robots_allowed": r"""
WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$', 1) AS path FROM page_cache WHERE url IS NOT NULL)
SELECT url FROM u WHERE length(host) % 2 = 1 OR NOT (starts_with(path, '/housing') OR starts_with(path, '/visas'))""",
    "fetched_pages": _READ + "SELECT * FROM f",
    "cache_merged": _READ + f"""
SELECT md5(url) AS cache_key, url, scraped_at, title FROM f WHERE NOT cached AND error IS NULL
UNION ALL SELECT md5(url), url, scraped_at, title FROM ({_ONE_COPY}) WHERE {_FRESH} <= 31536000 AND url NOT IN (SELECT url FROM f WHERE NOT cached AND error IS NULL)""",
    "topic_paths": f"""
SELECT doc_id, {_topic_path("category", OFFICIAL_HOUSING)} AS official_housing, '/register-with-a-gp' AS official_health, {_topic_path("category", COMMUNITY_HEALTH)} AS community_health FROM documents""",
    "scraped_documents": f"""
SELECT DISTINCT url, 'Page' AS title, length(url) || ' letters' AS text, {_topic(T.TOPICS_COMMUNITY)} AS topic FROM page_cache WHERE length(url) % 2 = 1""",
    "prompts": """
WITH d AS (SELECT doc_id, coalesce(title, '') AS q, CASE WHEN doc_id % 3 <> 0 THEN substring(text, 1, 80) END AS base, CASE WHEN doc_id % 2 = 0 THEN url END AS u FROM documents),
c AS (SELECT doc_id, q, CASE WHEN u IS NULL THEN base ELSE CASE WHEN coalesce(base, '') <> '' THEN 'BASE' || chr(10) || base || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN u <> '' THEN 'WEB' || chr(10) || 'Джерело: ' || u || chr(10) || 'Заголовок: ' || q || chr(10) || chr(10) || u || chr(10) ELSE '' END END AS context FROM d)
SELECT doc_id, context, CASE WHEN coalesce(context, '') <> '' THEN replace(replace('Q {query} C {context}', '{context}', context), '{query}', q) ELSE 'only ' || q END AS prompt FROM c""",
    "next_runs": """
WITH r AS (SELECT run_id, try_cast(run_timestamp AS TIMESTAMP) AS m FROM ingest_stats)
SELECT run_id, strftime(CAST(m AS DATE) + CASE WHEN dayofweek(m) = 0 AND hour(m) < 2 THEN 0 ELSE 7 - dayofweek(m) END::INTEGER + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS due FROM r WHERE m IS NOT NULL""",
    "tool_calls": f"""
SELECT {_TOOL_PAGE} AS page, NULL::VARCHAR AS error FROM page_cache WHERE url = (SELECT min(url) FROM page_cache)
UNION ALL SELECT NULL, 'Missing parameter: path' UNION ALL SELECT NULL, 'Unknown tool: none'""",
    "scraped_pages": f"""
SELECT page_id, array_to_string([x FOR x IN ['# ' || coalesce(title, 'Untitled'), '**Source:** ' || url, '**Scraped:** ' || strftime(try_cast(scraped_at AS TIMESTAMP), '%Y-%m-%d %H:%M') || ' UTC',
  CASE WHEN cached THEN '**Status:** Cached content' END, '**Published:** ' || nullif(metadata.publication_date, ''), '', '## Content' || chr(10) || coalesce(content, '') || chr(10),
  CASE WHEN len(links) > 0 THEN '## Relevant Links' || chr(10) || array_to_string([{_LINK} FOR x IN links[1:10]], chr(10)) || chr(10) END, '## Metadata',
  '- Content length: ' || coalesce(metadata.content_length, 0) || ' characters', '- Number of links: ' || coalesce(metadata.num_links, 0),
  CASE WHEN coalesce(contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), 'info'), false) THEN '- **Official UK Government Source**' END] IF x IS NOT NULL], chr(10)) AS page
FROM page_cache WHERE url IS NOT NULL""",
    "linked_pages": f"""
WITH l AS (SELECT {_strip('x."text"')} AS text, CASE WHEN starts_with(x.href, '//') THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || x.href WHEN starts_with(x.href, '/') THEN {_URL_TRIM} || x.href ELSE x.href END AS href
  FROM (SELECT url, unnest(links) AS x FROM page_cache))
SELECT DISTINCT href AS url FROM l WHERE coalesce(text, '') <> '' AND coalesce(href, '') <> '' AND NOT {_mentions("href", T.SKIP_LINKS)} AND NOT {_mentions("href", EXCLUDED)}""",
    "search_triggers": f"""
WITH q AS (SELECT doc_id, coalesce(title, '') AS q, doc_id % 4 AS found FROM documents)
SELECT doc_id, found < 2 OR {_mentions("q", [*T.FRESH_WORDS, *T.SCHEME_WORDS])} AS needed, CASE WHEN {_mentions("q", T.HEALTH_WORDS)} THEN 'health' ELSE 'housing' END AS subject FROM q""",
    "chunk_ordinals": f"""
WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS document_index, {_CLEAN} AS t FROM documents),
w AS (SELECT doc_id, document_index, t, unnest(generate_series(0, length(t) - 1, 450)) AS s FROM c WHERE length(t) > 0)
SELECT doc_id, document_index, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks
FROM w WHERE trim(substring(t, (s + 1)::BIGINT, 500), ' ') <> ''""",
    "collection_search": "WITH " + _PAIRS.format(extra="v.label,", where="", having="") + "SELECT query_id, vec_id AS point_id, round(score, 6) AS score, rank::INTEGER AS rank, label FROM r WHERE rank <= 5",
    "index_chunks": f"""
WITH RECURSIVE d AS (SELECT doc_id AS unit, {_CLEAN} AS t FROM documents),{_SENTENCE_CHUNKS},
i AS (SELECT unit, text, row_number() OVER (PARTITION BY unit ORDER BY k, c) - 1 AS chunk_index FROM sentence_chunks)
SELECT i.unit AS doc_id, i.chunk_index::INTEGER AS chunk_index, md5(coalesce(d.url, '') || chr(31) || i.chunk_index) AS point_id, 64 AS dimensions
FROM i JOIN documents d ON d.doc_id = i.unit WHERE regexp_matches(i.text, '[\\p{{L}}\\p{{N}}_]')""",
    "gated_messages": f"""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '@helper ' ELSE '' END || title AS text FROM documents WHERE title IS NOT NULL)
SELECT doc_id AS user_id, {_strip("replace(text, '@helper', '')")} AS question, {_gate("text")} AS rejected, {_language("text")} AS language FROM m WHERE contains(text, '@helper') OR doc_id % 5 = 0""",
    "format_message": f"""
WITH a AS (SELECT doc_id, title, source, url, {_twice(_STAR, _twice(_ONCE, "text"))} AS t FROM documents),
b AS (SELECT * EXCLUDE t, replace(replace(replace(replace({_twice(_BRACKET, "t")}, chr(1), '\\['), chr(2), '\\]'), chr(3), '\\*'), chr(4), '\\_') AS t FROM a),
c AS (SELECT * EXCLUDE t, regexp_replace(t, '([\U0001f600-\U0001f64f\U0001f480-\U0001f6d4])([А-Яа-яA-Za-z])', '\\1 \\2', 'g') AS t FROM b),
d AS (SELECT * EXCLUDE t, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '([^\\n])([{T.SECTION_SIGNS}])', '\\1' || chr(10) || chr(10) || '\\2', 'g') AS t FROM c),
e AS (SELECT doc_id, CASE WHEN regexp_matches(lower(t), '🔗[^\\n]*(джерел|посилан)') OR coalesce(url, '') = '' THEN t ELSE t || chr(10) || chr(10) || '🔗 Джерела:' || chr(10) ||
    '• ' || CASE WHEN coalesce(title, '') <> '' THEN title || ': ' WHEN coalesce(source, '') <> '' THEN source || ': ' ELSE '' END || url || chr(10) END AS text FROM d),
f AS (SELECT doc_id, text, greatest(length(h) - length(regexp_extract(h, '[^.]*$')), length(h) - length(regexp_extract(h, '[^\\n]*$'))) - 1 AS b FROM (SELECT doc_id, text, substring(text, 1, 3800) AS h FROM e))
SELECT doc_id, {_TRUNCATED} AS message FROM f""",
    "message_replies": f"""
WITH RECURSIVE m AS (SELECT doc_id, doc_id % 100 AS user_id, scraped_at, coalesce(title, ' ') AS text FROM documents WHERE doc_id % 7 <> 0),
e AS (SELECT *, epoch(scraped_at) AS t, row_number() OVER (PARTITION BY user_id ORDER BY scraped_at, doc_id) AS k FROM m WHERE scraped_at IS NOT NULL),
s AS (
  SELECT doc_id, user_id, k, [t] AS log, true AS admitted FROM e WHERE k = 1
  UNION ALL
  SELECT e.doc_id, e.user_id, e.k, CASE WHEN len([x FOR x IN s.log IF e.t - x < 2592000]) < 2 THEN list_append([x FOR x IN s.log IF e.t - x < 2592000], e.t) ELSE [x FOR x IN s.log IF e.t - x < 2592000] END,
    len([x FOR x IN s.log IF e.t - x < 2592000]) < 2 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1),
g AS (SELECT m.doc_id, m.user_id, CASE WHEN NOT coalesce(s.admitted, false) THEN 'rate_limited' WHEN {_gate("m.text")} <> '' THEN {_gate("m.text")} ELSE 'answered' END AS status, {_strip("m.text")} AS q
  FROM m LEFT JOIN s USING (doc_id))
SELECT doc_id AS message_id, user_id, status, {_language("q")} AS language, q AS question, CASE WHEN status = 'answered' THEN {_intent("q")} END AS intent FROM g""",
    "pages_followed": _CHAIN + "SELECT start_url, page_no::INTEGER AS page_no, url FROM c",
    "pages_aggregated": _CHAIN + """,
p AS (SELECT c.start_url, c.page_no, o.* FROM c JOIN o ON o.url = c.url),
g AS (
  SELECT start_url, count(*)::INTEGER AS num_pages, max(title) FILTER (page_no = 1) AS title,
    string_agg(CASE WHEN page_no = 1 THEN coalesce(content, '') ELSE chr(10) || chr(10) || '--- Page ' || page_no || ' ---' || chr(10) || chr(10) || coalesce(content, '') END, chr(10) ORDER BY page_no) AS content,
    sum(coalesce(metadata.num_paragraphs, 0))::INTEGER AS total_paragraphs, len(list_distinct([x.href FOR x IN flatten(list(coalesce(links, []) ORDER BY page_no)) IF x.href IS NOT NULL]))::INTEGER AS total_links,
    first(metadata.publication_date ORDER BY page_no) FILTER (coalesce(metadata.publication_date, '') <> '') AS first_publication_date,
    last(metadata.publication_date ORDER BY page_no) FILTER (coalesce(metadata.publication_date, '') <> '') AS latest_publication_date
  FROM p GROUP BY start_url)
SELECT start_url AS url, CASE WHEN num_pages = 1 THEN title ELSE title || ' (Pages 1-' || num_pages || ')' END AS title, content, num_pages, total_paragraphs, total_links,
  length(content)::INTEGER AS content_length, first_publication_date, latest_publication_date, 'cache' AS source FROM g""",
    "document_ordinal": "SELECT source, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS document_index FROM documents",
    "first_heading": f"SELECT doc_id, {_strip("coalesce(title, '?')")} AS heading FROM documents",
    "route_intent": "SELECT doc_id, "
    + ", ".join(f"({s})::INTEGER AS score_{n}" for n, s in _SCORES.items())
    + f", CASE WHEN {_BEST} < 1 THEN 'uncertain' "
    + " ".join(f"WHEN {s} = {_BEST} THEN '{n}'" for n, s in _SCORES.items())
    + " END AS intent FROM documents",
    "message_language": rf"""
WITH w AS (
  SELECT doc_id, text, regexp_matches(lower(text), '[{T.UKRAINIAN_LETTERS}]') AS uk, regexp_matches(lower(text), '[{T.RUSSIAN_LETTERS}]') AS ru,
         len([x FOR x IN {_WORDS} IF x IN ({_any(T.UKRAINIAN_WORDS)})]) AS n_uk, len([x FOR x IN {_WORDS} IF x IN ({_any(T.RUSSIAN_WORDS)})]) AS n_ru,
         length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\x{{0400}}-\x{{04FF}}]+', '', 'g')) AS cyrillic
  FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR {_strip("text")} = '' THEN 'unknown' WHEN uk AND NOT ru THEN 'uk' WHEN ru AND NOT uk THEN 'ru' WHEN n_uk > n_ru THEN 'uk'
  WHEN n_ru > n_uk THEN 'ru' WHEN letters > 0 AND cyrillic > 0.5 * letters THEN 'uk' ELSE 'unknown' END AS language FROM w""",
    "message_gate": f"""
SELECT doc_id, CASE WHEN {" OR ".join(f"regexp_matches(lower(text), {_quoted(p)})" for p in T.SPAM)} THEN 'spam_detected' WHEN length(text) > 4096 THEN 'message_too_long'
  WHEN text IS NULL OR {_strip("text")} = '' THEN 'empty_message' ELSE '' END AS rejected, length(text) > 500 AS long FROM documents""",
    "compose_text": f"""
WITH d AS (
  SELECT doc_id, text, greatest(length(h) - length(regexp_extract(h, '[^.]*$')), length(h) - length(regexp_extract(h, '[^\\n]*$'))) - 1 AS b
  FROM (SELECT doc_id, text, substring(text, 1, 3800) AS h FROM documents))
SELECT doc_id, substring(text, 1, 200) || '...' AS snippet, {_TRUNCATED} AS cut FROM d""",
    "source_section": """
SELECT doc_id, CASE WHEN coalesce(url, '') = '' THEN '' ELSE
  '• ' || CASE WHEN coalesce(title, '') <> '' THEN title || ': ' WHEN coalesce(source, '') <> '' THEN source || ': ' ELSE '' END || url || chr(10) END AS section FROM documents""",
    "guarded_text": """
SELECT doc_id, CASE WHEN contains(lower(text), '404') THEN '-' WHEN contains(lower(text), 'gov') OR contains(lower(text), 'рада') OR contains(lower(text), 'council') THEN text
  ELSE text || chr(10) || '--' END AS text FROM documents""",
    "url_parts": f"""
SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host, md5(url) AS key, md5(url) = cache_key AS key_fits,
  {_topic(T.TOPICS_OFFICIAL)} AS official_topic, {_topic(T.TOPICS_COMMUNITY)} AS topic,
  coalesce(contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), 'info'), false) AS in_domain FROM page_cache""",
    "page_links": f"""
WITH l AS (
  SELECT page_id, i, {_strip('x."text"')} AS text, CASE WHEN starts_with(x.href, '//') THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || x.href WHEN starts_with(x.href, '/') THEN {_URL_TRIM} || x.href ELSE x.href END AS href
  FROM (SELECT page_id, url, unnest(links) AS x, generate_subscripts(links, 1) AS i FROM page_cache)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS again FROM l
  WHERE coalesce(text, '') <> '' AND coalesce(href, '') <> '' AND {" AND ".join(f"NOT contains(lower(href), {_quoted(p)})" for p in T.SKIP_LINKS_OFFICIAL)})
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY NOT contains(lower(href), 'visa'), text, href) - 1)::INTEGER AS n, text, href, contains(lower(href), 'visa') AS is_official
FROM k WHERE again = 1""",
    "page_counts": "SELECT page_id, coalesce(len(links), 0)::INTEGER AS n_links, length(content)::INTEGER AS n_chars, len(string_split(content, chr(10)))::INTEGER AS n_lines FROM page_cache",
    "cache_fresh": f"SELECT page_id, {_FRESH} AS age FROM page_cache WHERE {_FRESH} <= 31536000",
    "cache_expired": f"SELECT page_id FROM page_cache WHERE NOT coalesce({_FRESH} <= 31536000, false)",
    "cache_misses": f"""
SELECT DISTINCT metadata.url AS url FROM ingested_docs WHERE metadata.url IS NOT NULL
  AND metadata.url NOT IN (SELECT url FROM page_cache WHERE url IS NOT NULL AND {_FRESH} <= 31536000)""",
    "cache_newest": """
SELECT key, n_copies, page_id, scraped_at, title FROM (
  SELECT md5(url) AS key, count(*) OVER (PARTITION BY url) AS n_copies, page_id, scraped_at, title, row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, page_id DESC) AS r FROM page_cache)
WHERE r = 1""",
    "html_pages": f"""
WITH p AS (SELECT page_id, title, [{_strip("x")} FOR x IN string_split(content, chr(10)) IF {_strip("x")} <> ''] AS parts FROM page_cache WHERE content IS NOT NULL)
SELECT page_id, CASE WHEN {_strip("coalesce(title, '')")} = '' THEN 'Untitled' ELSE {_strip("title")} END AS title, array_to_string(parts, chr(10) || chr(10)) AS content, len(parts)::INTEGER AS num_paragraphs FROM p""",
    "tool_pages": f"""
SELECT page_id, {_strip("coalesce(title, 'Untitled')")} AS title, {_strip("url")} AS url, array_to_string([x FOR x IN string_split(content, chr(10)) IF {_strip("x")} <> ''], chr(10)) AS content
FROM page_cache WHERE content IS NOT NULL AND url IS NOT NULL""",
    "document_dates": f"""
SELECT record_id, CASE WHEN {_DATE} IS NULL THEN NULL ELSE strftime({_DATE}, '%Y-%m-%d %H:%M:%S') END AS moment, coalesce(strftime({_DATE}, '%d %B %Y'), metadata.document_date) AS shown,
  {_AGE} AS days, coalesce({_AGE} <= 365, true) AS recent, coalesce({_AGE} > 365, false) AS outdated FROM ingested_docs""",
    "date_order": f"""
SELECT run_id, record_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce({_DATE}, TIMESTAMP '1970-01-01') DESC, record_id)::INTEGER AS place FROM ingested_docs""",
    "migrated_dates": r"""
SELECT record_id, coalesce(metadata.document_date, CASE WHEN metadata.last_updated IS NULL THEN '2024-06-01'
    WHEN regexp_full_match(metadata.last_updated, '\d{4}-\d{1,2}-\d{1,2}') AND try_cast(metadata.last_updated AS DATE) IS NOT NULL THEN metadata.last_updated ELSE '2023-01-01' END) AS checked,
  coalesce(metadata.last_updated, '2023-01-01') AS unchecked, coalesce(metadata.document_date, strftime(DATE '2025-06-01' - 730, '%Y-%m-%d')) AS by_age FROM ingested_docs""",
    "migration_counts": "SELECT count(*) AS total, count(*) FILTER (metadata.document_date IS NULL) AS converted FROM ingested_docs",
    "normalised_records": f"""
WITH r AS (SELECT record_id, try_cast(payload AS JSON) AS p FROM raw_records),
t AS (SELECT record_id, coalesce(nullif(p->>'$.text', ''), p->>'$.content') AS text, coalesce(nullif(p->>'$.metadata.title', ''), nullif(p->>'$.title', ''), '?') AS title FROM r WHERE p IS NOT NULL)
SELECT record_id, {_strip("text")} AS text, title FROM t WHERE {_strip("text")} <> ''""",
    "union_sources": """
SELECT 0 AS source_ordinal, source, count(*) AS n, count(category) AS n_category, CAST(0 AS BIGINT) AS n_updated FROM documents GROUP BY source
UNION ALL SELECT 1, metadata.source, count(*), CAST(0 AS BIGINT), count(metadata.last_updated) FROM ingested_docs GROUP BY metadata.source""",
    "ingest_statistics": """
SELECT count(*) AS documents_loaded, count(*) FILTER (source = 'manual') AS manual_documents, count(*) FILTER (source = 'startland.example') AS official_documents,
  count(*) FILTER (source = 'mistok.example') AS community_documents, (SELECT count(*) FROM chunks) AS chunks_created, (SELECT count(*) FROM chunks WHERE length(text) > 0) AS chunks_stored,
  0 AS errors, true AS success FROM documents""",
    "run_statistics": """
SELECT success, count(*) AS runs, sum(coalesce(documents_loaded, documents_scraped))::BIGINT AS documents, sum(chunks_created)::BIGINT AS created,
  sum(CASE WHEN success THEN chunks_stored ELSE 0 END)::BIGINT AS stored, round(avg(duration_seconds), 6) AS seconds FROM ingest_stats GROUP BY success""",
    "upsert_latest": """
SELECT record_id, run_id, metadata.url AS url FROM ingested_docs WHERE metadata.url IS NULL
UNION ALL SELECT record_id, run_id, url FROM (
  SELECT record_id, run_id, metadata.url AS url, row_number() OVER (PARTITION BY metadata.url ORDER BY run_id DESC, record_id DESC) AS r FROM ingested_docs WHERE metadata.url IS NOT NULL) WHERE r = 1""",
    "upsert_runs": """
SELECT record_id, run_id, url FROM (
  SELECT record_id, run_id, metadata.url AS url, row_number() OVER (PARTITION BY metadata.url ORDER BY run_id % 2 DESC, run_id DESC, record_id DESC) AS r FROM ingested_docs WHERE metadata.url IS NOT NULL)
WHERE r = 1""",
    "vector_topk": "WITH " + _PAIRS.format(extra="", where="", having="") + _HITS.format(k=5),
    "vector_topk_filtered": "WITH " + _PAIRS.format(extra="", where="AND q.label = v.label", having="") + _HITS.format(k=5),
    "vector_threshold": "WITH " + _PAIRS.format(extra="", where="", having="WHERE score >= 0.25") + _HITS.format(k=10),
    "vector_health": "SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'collection_not_found' END AS status, count(*) AS n_points, max(len(embedding))::INTEGER AS dimensions FROM embeddings",
    "retrieve_context": "WITH "
    + _PAIRS.format(extra="", where="", having="")
    + """, h AS (
  SELECT r.query_id, round(r.score, 6) AS score, d.doc_id, d.text, d.source, d.title, d.url, CAST(timezone('UTC', d.scraped_at) AS DATE) AS day
  FROM r JOIN documents d ON d.doc_id = r.vec_id + 1000 WHERE r.rank <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day DESC, score DESC, doc_id) AS i FROM h WHERE date_diff('day', day, DATE '2025-06-01') <= 900)
SELECT query_id, string_agg('[Документ ' || i || ']' || CASE WHEN coalesce(title, '') <> '' THEN ' - ' || title ELSE '' END || chr(10) || 'Джерело: ' || coalesce(source, 'Unknown')
    || CASE WHEN coalesce(url, '') <> '' THEN chr(10) || 'Посилання: ' || url ELSE '' END || chr(10) || 'Дата документа: ' || strftime(day, '%d %B %Y') || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY i) AS context,
  count(*)::INTEGER AS found_documents, round(least(avg(score), 1.0), 6) AS confidence FROM k GROUP BY query_id""",
    "rate_limit": """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (
  SELECT event_id, user_id, k, [t] AS log, true AS admitted FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.k, CASE WHEN len([x FOR x IN s.log IF e.t - x < 86400]) < 5 THEN list_append([x FOR x IN s.log IF e.t - x < 86400], e.t) ELSE [x FOR x IN s.log IF e.t - x < 86400] END,
    len([x FOR x IN s.log IF e.t - x < 86400]) < 5 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, user_id, admitted FROM s""",
    "throttle": """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (
  SELECT event_id, user_id, k, [t] AS log, t AS scheduled FROM e WHERE k = 1
  UNION ALL
  SELECT event_id, user_id, k, list_append(list_slice(log, -9, -1), go), go FROM (
    SELECT e.event_id, e.user_id, e.k, s.log, greatest(e.t, s.log[-1] + 2.0, CASE WHEN len(s.log) = 10 THEN s.log[1] + 60.0 ELSE 0 END) AS go FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT event_id, user_id, round(scheduled, 6) AS scheduled FROM s""",
    "status_changes": """
WITH e AS (SELECT user_id, event_id, CASE WHEN value > 50 THEN 'member' ELSE 'left' END AS after FROM events),
c AS (SELECT *, lag(after) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, event_id, before, after, CASE WHEN coalesce(before, '') <> 'member' AND after = 'member' THEN 'joined' WHEN before = 'member' AND after <> 'member' THEN 'left' ELSE 'other' END AS change
FROM c WHERE after IS DISTINCT FROM before""",
}
