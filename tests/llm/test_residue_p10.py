"""Problem 10: grammars, notices, and the texts that only talk about them."""

import pytest

from loomline.llm import residue as R

CASES = [
    "Dear {{ user.first_name }}, your claim", "{% if a %}x{% endif %}", "pay ${amount} now", "call #{office}", "see %%page_title%% here", "at @@office_name@@ today",
    "the __amount__ due", "go to [[council]] now", "visit &lt;address&gt; now", "<%= contact_phone %>", "<?php echo $x; ?>", "write to [INSERT address]", "[year here] report",
    "на [вставити: адреса] вулиці", ":page_title: of the day", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "undefined undefined undefined", "[object Object]",
    "NaN / NaN / null", "Warning: Undefined variable $page in /srv/app/view.php on line 12", "TODO: add text", "xxxx xxxx xxxx", "Good text here.\nAccess Denied", "404 Not Found",
    "Please enable JavaScript to view this page.", "Увімкніть JavaScript, щоб переглянути цей вміст.", "Сервис временно недоступен. Повторите через 5 минут.", "Помилка сервера 500",
    "Strona chwilowo niedostępna", "Activați JavaScript pentru a vedea această pagină.", "YOUR SESSION HAS EXPIRED. SIGN IN AGAIN.", "*  Доступ  заборонено  ", "Checking your browser before accessing the site...",
    "Just another site built with a starter theme", "Just another blogging site",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit",
    "undefined " * 60 + "undefined", "Traceback (most recent call last): " + "File a.py line 3 in main " * 12,
    "Warning: Undefined array key in /srv/" + "app/" * 60 + "view.php on line 12", "java.lang.IllegalStateException: " + "cannot open the store for reading " * 8,
]
OTHERS = [
    None, "", "   ", "A normal guide about housing.", "If the portal shows a 404 error, wait 30 minutes and open the section again.",
    "For the form to work, enable JavaScript in the browser and then call the housing team.", "The [optional] box may be left empty and a letter sent later [12].",
    "Поле [за бажанням] у заяві можна пропустити.", "An employer must explain why the site sets cookies before you upload a copy.", "Write `{{name}}` where the name should stand.",
    "A placeholder such as {{name}} is replaced when the letter is sent, as the template syntax says.", "The fee is 500 pounds.", "If the portal shows an error, write down its number, " + "go to the library and ask the desk there for help with the form, " * 5 + "and wait.", "Enrolment: {see below}; 50% off", "a_b_c and x__y",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert R.is_residue(text)
    assert R.is_residue("A guide.\n" * 50 + text + "\nMore of it.")


@pytest.mark.parametrize("text", OTHERS)
def test_others(text):
    assert not R.is_residue(text)


def test_found(spark):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(100 + k, t) for k, t in enumerate(OTHERS)] + [(0, CASES[0]), (999, "A word. " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS kind", "1 AS i", "2 AS t")
    got = sorted(r.doc_id for r in R.detect(docs).collect())
    assert got == sorted([*range(len(CASES)), 0])
    kept = {r.doc_id for r in R.without_residue(docs).collect()}
    assert kept == {100 + k for k in range(len(OTHERS))} | {999}
    assert R.detect(docs.limit(0)).count() == 0
