"""Text functions on known strings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T


def _values(spark, fn, values, schema="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {schema}")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v"))).collect()]


def test_cleaning(spark):
    assert _values(spark, T.clean_text, ["Multiple    spaces   and\n\n\n\nnewlines ", "a\u00a0 \u2003b\x1cc\x00d", "", None]) == ["Multiple spaces and newlines", "a b cd", "", None]
    assert _values(spark, T.clean_lines, [" a \n\n  b\r\n\x85c ", None]) == ["a\nb\nc", None]
    assert _values(spark, T.first_heading, ["x\n  # My title \n# Other", "## no", "#no", None]) == ["My title", None, None, None]
    assert _values(spark, T.title_from_name, ["my_first-file.txt", "dir/read me.md"]) == ["My First File", "Read Me"]
    assert _values(spark, T.sentences, ["Раз. Два! Three? four. Є… Ні. 5 ok", None]) == [["Раз.", "Два!", "Three? four.", "Є…", "Ні. 5 ok"], None]


INTENTS = {
    "visa": ["Як продовжити УПЕ візу?", "Чи можу я подорожувати з BRP?", "Де отримати дозвіл на проживання?"],
    "housing": ["Де зареєструватися у NHS?", "Як знайти GP у моєму районі?", "Питання про житло та оренду", "Як записати дитину до школи?"],
    "work": ["Як отримати NI number?", "Де подати на Universal Credit?", "Питання про роботу та зарплату"],
    # the last two are what the rules give, whatever one might wish
    "uncertain": ["Привіт!", "Як справи?", "Що нового?", "Питання про імміграцію", "Які у мене права як працівника?"],
}
LANGUAGES = {
    "uk": ["Як продовжити візу?", "Де знайти лікаря?", "Я хочу отримати допомогу", "Дякую за допомогу", "Чи можу я подорожувати?", "їжа", "євро", "Київ", "Україна", "ґанок", "Як справи?", "еда"],
    "ru": ["Как продлить визу?", "Где найти врача?", "Я хочу получить помощь", "Спасибо за помощь", "Могу ли я путешествовать?", "это", "объект", "ёлка", "вы можете", "Как дела?"],
    "unknown": ["", "   ", None, "hello"],
}


@pytest.mark.parametrize("want", list(INTENTS))
def test_routes(spark, want):
    assert set(_values(spark, lambda c: T.route(c, T.INTENTS), INTENTS[want])) == {want}


@pytest.mark.parametrize("want", list(LANGUAGES))
def test_languages(spark, want):
    got = _values(spark, T.message_language, LANGUAGES[want])
    assert got == [want] * len(got), list(zip(LANGUAGES[want], got))


def test_gates(spark):
    assert _values(spark, T.rejection, ["Click here now http://x", "x" * 4097, " ", None, "ok", "BUY cheap for $5"]) == ["spam_detected", "message_too_long", "empty_message", "empty_message", "", "spam_detected"]
    assert _values(spark, lambda c: T.addressed(c, "bot", F.lit(False)), ["@bot hi", "hi", None]) == [True, False, False]
    assert _values(spark, lambda c: T.without_mention(c, "bot"), ["@bot  hi @bot"]) == ["hi"]
    guard = lambda c: T.guarded(c, ["info"], " [i]", ["surely"], "no")
    assert _values(spark, guard, ["some Info", "text", "Surely info"]) == ["some Info", "text [i]", "no"]


def test_urls(spark):
    urls = ["https://www.gov.uk/visa-fees", "https://x/family-scheme", "https://x/sponsor", "https://x/support", "https://x/work", "https://x/", None]
    assert _values(spark, lambda c: T.url_topic(c, T.TOPICS_OFFICIAL), urls) == ["visa", "visa", "housing", "benefits", "work", "general", None]
    assert _values(spark, T.url_host, ["https://u@A.example:80/x", "nothing", None]) == ["a.example", None, None]
    assert _values(spark, T.cache_key, ["https://a.example/x", None]) == [hashlib.md5(b"https://a.example/x").hexdigest(), None]


def test_links(spark):
    links = [[("A", "/a"), ("B", "https://o.example/b"), ("again", "/a"), ("", "/c"), ("m", "mailto:x"), ("далі →", "/p2"), ("V", "//v.example/1")], None, []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(links)], "k int, links array<struct<text:string,href:string>>").orderBy("k")
    base = F.lit("https://h.example/dir/x")
    got = [r[0] for r in df.select(T.wanted_links(F.col("links"), base)).collect()]
    assert [(x.text, x.href) for x in got[0]] == [("A", "https://h.example/a"), ("B", "https://o.example/b"), ("далі →", "https://h.example/p2"), ("V", "https://v.example/1")]
    assert got[1:] == [None, []]
    ranked = df.select(T.official_first(T.wanted_links(F.col("links"), base, official="o.example"))).first()[0]
    assert [x.text for x in ranked] == ["B", "A", "V", "далі →"]
    assert [r[0] for r in df.select(T.next_page(F.col("links"), base)).collect()] == ["/p2", None, None]


def test_composing(spark):
    assert _values(spark, T.escape_marks, ["a _ b *c* [x] [y](z) snake_case **bold**"]) == [r"a \_ b \*c\* \[x\] [y](z) snake_case **bold**"]
    assert _values(spark, T.space_emoji, ["😀Привіт 😀 ok"]) == ["😀 Привіт 😀 ok"]
    assert _values(spark, T.space_sections, ["a\n\n\n\nb", "text🏠 home"]) == ["a\n\nb", "text\n\n🏠 home"]
    long = ("Sentence number one. " * 300)[:5000]
    cut = _values(spark, T.truncate, ["short", long, "x" * 4000])
    assert cut[0] == "short" and cut[1].startswith(long[: long.rfind(".", 0, 3800) + 1] + "\n\n...") and cut[2].startswith("x" * 3800 + "\n\n...")
    sources = [[("T", "s", "u1"), ("T2", "s", "u1"), (None, "s", "u2"), (None, None, "u3"), ("no", "url", None)], [("T", "s", "")], []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sources)], "k int, s array<struct<title:string,source:string,url:string>>").orderBy("k")
    assert [r[0] for r in df.select(T.source_section(F.col("s"), "S:\n")).collect()] == ["S:\n• T: u1\n• s: u2\n• u3\n", "", ""]
    assert _values(spark, T.has_source_section, ["🔗 Джерела: x", "🔗 none", None]) == [True, False, False]
    assert _values(spark, lambda c: T.prompt(F.lit("q"), c, "{context}|{query}", "only {query}"), ["ctx", "", None]) == ["ctx|q", "only q", "only q"]
