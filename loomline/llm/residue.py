"""Problem 10: template residue, filler and failed-page text.

Two detectors look at a text, both on whole texts:

* placeholders: one grammar for each delimiter style (``{{x}}``, ``${x}``, ``[INSERT x]``,
  ...), a tag that names a field where a value should stand. Placeholders inside code spans
  or in sentences that explain template syntax are discounted, unless the text is dense
  with them (then it is an unfilled template, whatever it says about itself).
* notices and filler: a *sentence* that as a whole is an error, waiting, access or script
  notice, dummy text or leaked program output. A sentence that merely mentions one ("if the
  portal shows a 404 error, wait ...") does not match, as patterns cover whole sentences.
  Notices are short by their patterns; filler and program output may have any length.

Defined results: a null or empty text has no finding; repeated rows give repeated results;
every other column is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import spread

_NAME = r"[^\W\d][\w\-]*(?:\.\w+)*"
_SPACED = r"[^\W\d][\w\-.]*(?: [\w\-.]+){0,3}"
#: One grammar for each delimiter style.
PLACEHOLDER_GRAMMARS = {
    "mustache": r"\{\{[{#/^>&]?\s*" + _NAME + r"(?:\s*\|[^{}\n]{0,60})?\s*\}?\}\}",
    "tag": r"\{%-?\s*[^\W\d]\w*[^{}\n]{0,120}?-?%\}",
    "dollar": r"\$\{\s*" + _NAME + r"\s*\}",
    "hash": r"#\{\s*" + _NAME + r"\s*\}",
    "percent": r"%%\s?" + _NAME + r"\s?%%|%\{" + _NAME + r"\}|%\(" + _NAME + r"\)s\b",
    "at": r"@@\s?" + _NAME + r"\s?@@",
    "underscore": r"(?<![\w.])__" + r"[^\W\d_][^\W_]*(?:[_.][^\W_]+)*" + r"__(?!\w)",
    "colon": r"(?<!\S):(?=\w*[^\W\d])[^\W\d]\w*(?:\.\w+)*:(?![^\s.,;)])",
    "wiki": r"\[\[\s*" + _NAME + r"\s*\]\]",
    "escaped": r"&lt;\s?" + _NAME + r"\s?&gt;",
    "angle": r"<<\s?" + _NAME + r"\s?>>|<[^\W\d]\w*[_.]\w+>",
    "server": r"<%[=\-#@]?[^%\n]{0,120}%>|<\?(?:php|=)[^\n]{0,160}?\?>",
    "insert": r"\[(?:insert|enter|add|your|вставити|вставте|вставить|вставьте|впишіть|введіть|введите|"
    r"wstaw|wpisz|uzupełnij|inserați|introduceți|completați)\b\s*:?\s*" + _SPACED + r"\]|"
    r"\[" + _SPACED + r" (?:here|тут|здесь|tutaj|aici)\]|"
    r"<(?:insert|вставити|вставить|wstaw|inserați)\b[^<>\n]{1,40}>",
}
PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PLACEHOLDER_GRAMMARS.items()), re.IGNORECASE)
#: The openings of the grammars; a text without them is not searched.
_OPENINGS = ("{{", "{%", "${", "#{", "%%", "%{", "%(", "@@", "__", "[", "&lt;", "<", " :", "\n:")
#: Words of texts that explain placeholders to the reader.
_TUTORIAL = re.compile(
    r"\b(?:placeholders?|template (?:syntax|engine|language)|variable names?|mail ?merge|markup|snippet|"
    r"шаблонізатор\w*|заповнювач\w*|синтаксис\w*|змінн\w+ шаблону|шаблонизатор\w*|заполнител\w*|"
    r"symbol\w* zastępcz\w*|składni\w*|substituent\w*|sintax\w*)\b",
    re.IGNORECASE,
)
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]{1,200}`|<code>.*?</code>|<pre>.*?</pre>", re.DOTALL)
#: From so many placeholders a hundred words a text counts as a template even if it seems a tutorial.
DENSE = 6.0

#: Latin dummy text is made of these words.
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore
    magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
    duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat
    cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum quisque vitae ligula pulvinar nec
    dictum at tempus arcu curabitur vestibulum pellentesque mauris vivamus morbi aenean donec praesent nullam integer
    phasellus suspendisse fusce cras maecenas sollicitudin tincidunt ultricies faucibus""".split()
)
_DUMMY = r"(?:x{3,}|asdf|qwerty|qwe|zxcv|йцукен|фыва|фіва|blah|bla|foo|bar|baz|test|тест|lorem|ipsum|" \
    r"рибний|рибн\w+|текст|рыба|dummy|text|filler|undefined|null|nan|none)"
#: Whole sentences or lines, lower case, white space collapsed.
_WHOLE = [
    # filler
    rf"{_DUMMY}(?:[\s/,|\-]+{_DUMMY})+",
    r"(?:this is )?(?:a |some |your )?(?:sample|placeholder|dummy|filler|example) (?:heading|text|paragraph|content|title|sentence|description)\b.{0,20}",
    r"(?:це|тут|это|здесь)?\s?(?:приклад|зразок|пример|образец) тексту?а?.{0,50}",
    r"(?:тут|здесь) (?:має|повинен|повинна|буде|должен|должно|должна|будет)\s?(?:бути|быть)? .{0,50}",
    r"(?:текст|опис|вміст|контент|описание|содержание|розділ|раздел) (?:буде|будет|скоро буде) (?:додано|добавлен\w*|заповнено|доступн\w*).{0,20}",
    r"(?:przykładow[yae]|tymczasow[yae]) (?:tekst|treść|nagłówek|akapit).{0,50}|(?:tekst|treść) (?:zostanie|będzie) (?:dodan[ya]|uzupełnion[ya]).{0,30}|tu (?:powinien|będzie) .{0,30}(?:tekst|opis).{0,30}",
    r"(?:text|conținut|paragraf|titlu) (?:de exemplu|de umplutură|provizoriu|exemplu).{0,50}|(?:textul|conținutul) va fi (?:adăugat|completat).{0,30}|aici (?:trebuie|va) .{0,40}",
    r"(?:todo|fixme|tbc|tbd|to do)\b\s?(?:[:—–\-].{2,100}|\.?)",
    r"(?:content|text|description|section|copy) (?:to be|will be|is being) (?:supplied|added|provided|confirmed|written).{0,50}",
    r"(?:just|yet) another (?:.{2,20} )?site\b.{0,40}",
    r"(?:рибний текст|текст[- ]рыба|текст[- ]риба|рыбный текст)(?: .{0,60})?|coming soon|незабаром",
    # leaked program output
    r"\[?object object\]?(?:[\s,]+\[?object object\]?)*",
    r"(?:warning|notice|fatal error|parse error|deprecated|uncaught \w*error|php \w+): .{3,120}\bline \d+.{0,20}",
    r"traceback \(most recent call last\):?.{0,200}|(?:\w+\.)*\w+(?:error|exception): .{2,160}|at [\w.$<>]+\([\w.]+:\d+\)|file \"[^\"]+\", line \d+.{0,60}",
    r"sqlstate\[?.{2,100}|segmentation fault.{0,30}|stack trace:?.{0,100}|(?:nan|null|undefined|none)(?:[\s/,|]+(?:nan|null|undefined|none))*",
    # errors
    r"(?:http |error |помилка |ошибка |błąd |eroare |eroarea )?[45]\d\d\b[\s:.—–\-]*(?:error )?(?:not found|bad gateway|bad request|forbidden|unauthori[sz]ed|internal server error|service unavailable|gateway time-?out|too many requests|request time-?out|gone|не знайдено|не найдено|не найдена|nie znaleziono|negăsit\w*|access denied)?(?: [—–\-|].{0,30})?",
    r"(?:(?:internal |внутрішня |внутренняя |wewnętrzny )?(?:server |http )?error|(?:внутрішня )?помилка(?: сервера)?|(?:внутренняя )?ошибка(?: сервера)?|błąd(?: serwera)?|eroare(?: de server| server| internă)?)\s?[:#№—–\-]?\s?[45]\d\d\.?",
    r"(?:internal server error|bad gateway|not found|forbidden|service unavailable|too many requests|gateway time-?out|server error|application error)\.?",
    r"error establishing (?:a )?(?:database )?connection.{0,30}|(?:database|connection) (?:error|refused|timed out).{0,40}",
    r"(?:sorry,? |we'?re sorry,? |oops[!,.]? )?(?:that|this|the) (?:page|resource|file|link)(?: (?:that )?you (?:requested|were looking for|are looking for))? (?:is gone|has moved|could not be (?:located|found)|cannot be found|can'?t be found|was not found|does ?n[o']t exist|is (?:not available|unavailable|missing)|no longer exists).{0,60}",
    r"(?:page|file) not found.{0,30}|(?:на жаль, |к сожалению, )?(?:цієї |такої |такой |этой |запитан\w+ |запрошенн\w+ )?(?:сторінк[уаи]|страниц[аыу]) (?:не (?:знайдено|існує|найдена|существует)|більше не існує).{0,60}",
    r"(?:strona|strony)(?: .{0,30})? nie (?:została |istnieje|znaleziono).{0,40}|nie (?:znaleziono|odnaleziono) (?:takiej )?strony.{0,40}|pagina (?:.{0,30} )?nu (?:a fost găsită|există|poate fi găsită).{0,40}",
    r"можливо, її (?:перенесли|перенесено|видалили).{0,80}|возможно, (?:она|её) .{0,20}(?:перенес|удал).{0,60}|(?:it|the page) (?:may|might) have been (?:moved|removed|deleted).{0,60}",
    r"(?:something went wrong|щось пішло не так|что-то пошло не так|coś poszło nie tak|ceva nu a mers bine).{0,60}",
    r"(?:the )?(?:service|site|website|server|page) (?:is )?(?:temporarily|currently) (?:unavailable|down|offline|out of service).{0,70}",
    r"(?:сервіс|сайт|сервер|послуга|сторінка|сервис|страница|услуга) (?:тимчасово|временно) (?:не\s?доступ\w+|не працює|не работает).{0,70}",
    r"(?:usługa|strona|serwis|witryna)(?: jest)? (?:chwilowo|tymczasowo) niedostępn\w+.{0,70}|(?:serviciul|pagina|site-ul)(?: este)? (?:temporar|momentan) (?:indisponibil\w*|inaccesibil\w*).{0,70}|(?:serviciu|pagină) (?:temporar|momentan) (?:indisponibil\w*).{0,70}",
    r"(?:ведуться|проводяться|идут|ведутся|проводятся) (?:технічні|профілактичні|технические|профилактические) (?:роботи|работы).{0,70}|(?:scheduled |under |down for )?maintenance(?: mode| in progress)?.{0,40}|trwają prace (?:techniczne|konserwacyjne|serwisowe).{0,60}|(?:se efectuează )?lucrări (?:tehnice|de mentenanță|de întreținere).{0,60}",
    # access
    r"(?:access|permission) (?:denied|forbidden).{0,60}|доступ (?:заборонено|запрещ[её]н|обмежено|ограничен).{0,60}|(?:dostęp zabroniony|odmowa dostępu|brak dostępu).{0,60}|(?:acces (?:interzis|refuzat|restricționat)).{0,60}",
    r"you (?:do not|don'?t) have (?:permission|access).{0,80}|(?:у вас немає|у вас нет) (?:доступу|доступа|прав).{0,60}|nie masz uprawnień.{0,60}|nu aveți (?:acces|permisiunea).{0,60}",
    r"ваш запит (?:відхилено|заблоковано).{0,50}|ваш запрос (?:отклон[её]н|заблокирован).{0,50}|your request (?:was|has been) (?:blocked|rejected|denied).{0,50}|twoje żądanie zostało (?:odrzucone|zablokowane).{0,50}|cererea (?:dvs\. |dumneavoastră )?a fost (?:respinsă|blocată).{0,50}|(?:код події|код события|event id|ray id|reference)[:#\s]+[#\w.\-]+",
    r"(?:термін дії |срок действия )?(?:сеанс|сесі|сесси)\w* (?:минув|закінчи\w+|ист[её]к\w*|заверш\w+|заверш[её]н\w*).{0,60}|(?:your )?session (?:has )?(?:expired|timed out|ended).{0,60}|(?:twoja )?sesja wygasła.{0,60}|sesiunea (?:a )?expirat.{0,60}",
    r"(?:please )?(?:log|sign) in to (?:continue|view|access|see).{0,60}|(?:увійдіть|войдите)(?: знову| снова|, щоб (?:продовжити|переглянути)|, чтобы (?:продолжить|просмотреть)).{0,50}|(?:zaloguj się,? (?:ponownie|aby (?:zobaczyć|kontynuować))).{0,50}|(?:autentificați-vă|conectați-vă) (?:din nou|pentru a (?:continua|vedea)).{0,50}",
    r"(?:too many (?:requests|attempts)|rate limit exceeded).{0,60}|забагато (?:запитів|спроб).{0,60}|(?:слишком много|превышено число) (?:запросов|попыток).{0,60}|zbyt wiele (?:żądań|prób).{0,60}|prea multe (?:cereri|încercări|solicitări).{0,60}",
    # waiting and bot checks
    r"(?:checking|verifying) (?:your browser|that you are (?:human|not a robot)|you are human).{0,60}|перевіряємо (?:ваш )?браузер.{0,60}|проверяем (?:ваш )?браузер.{0,60}|(?:sprawdzamy|weryfikujemy) (?:twoją )?przeglądark.{0,60}|(?:verificăm|se verifică) browserul.{0,60}",
    r"(?:please )?wait(?: while| a moment| \d+ seconds| for).{0,60}|just a moment.{0,30}|зачекайте,? (?:\d+ секунд|будь ласка|хвилинку|поки).{0,40}|(?:подождите|пожалуйста, подождите),? ?(?:\d+ секунд|пока|минутку)?.{0,30}|(?:proszę czekać|poczekaj|odczekaj \d+ sekund).{0,40}|(?:vă rugăm )?așteptați,? (?:\d+ (?:de )?secunde|un moment|câteva).{0,30}",
    r"loading(?:\.{1,3}|…)?(?: please wait)?|завантаження(?:\.{1,3}|…)|загрузка(?:\.{1,3}|…)|ładowanie(?:\.{1,3}|…)|se încarcă(?:\.{1,3}|…)?",
    r"(?:are you a robot|i'?m not a robot|please (?:verify|confirm|prove) (?:that )?you are (?:human|not a robot)|підтвердьте, що ви не робот|подтвердите, что вы не робот|potwierdź, że nie jesteś robotem|confirmați că nu sunteți robot).{0,40}",
    # scripts
    r"(?:please |you need to |you must |you have to )?(?:enable|turn on|activate|allow) (?:javascript|scripts?|scripting)(?: and cookies)?(?: in your (?:web )?browser)?(?: (?:settings )?(?:to|in order to|and (?:reload|refresh|try))\b.{0,60})?",
    r"javascript (?:is |seems to be )?(?:required|disabled|turned off|not enabled|must be enabled|needs to be enabled).{0,80}|(?:this (?:site|page|app|content|website)|you need) .{0,20}(?:requires?|needs?) javascript.{0,60}|to view this (?:page|content|site),? .{0,20}javascript.{0,40}",
    r"(?:будь ласка, )?(?:увімкніть|активуйте|дозвольте) javascript(?:,? (?:щоб|аби|для) .{0,70}| (?:у|в) .{0,30}браузер\w*(?:,? (?:щоб|аби|для) .{0,60})?)?|(?:для|щоб) (?:перегляду|переглянути|роботи|продовження|продовжити)[^,.]{0,30},? .{0,30}javascript.{0,40}|(?:потрібен|необхідний|вимкнено) javascript.{0,60}|javascript (?:вимкнено|відключено|не підтримується|отключ[её]н|выключен).{0,60}",
    r"(?:пожалуйста, )?(?:включите|активируйте|разрешите) javascript(?:,? (?:чтобы|для) .{0,70}| в .{0,30}браузер\w*(?:,? (?:чтобы|для) .{0,60})?)?|(?:для|чтобы) (?:просмотра|просмотреть|продолжения|продолжить|работы)[^,.]{0,30},? .{0,30}javascript.{0,50}|(?:требуется|необходим) javascript.{0,60}",
    r"(?:proszę )?(?:włącz|włączyć|aktywuj)(?: obsługę)? javascript.{0,70}|(?:aby|by) (?:zobaczyć|wyświetlić|przeglądać|kontynuować)[^.]{0,40} javascript.{0,40}|ta strona wymaga .{0,15}javascript.{0,50}|javascript jest (?:wyłączony|wymagany).{0,50}",
    r"(?:vă rugăm să )?(?:activați|porniți|permiteți) javascript.{0,70}|pentru a (?:vedea|vizualiza|continua)[^.]{0,40} javascript.{0,50}|(?:această pagină|site-ul) necesită javascript.{0,50}|javascript (?:este )?(?:dezactivat|necesar).{0,50}",
]
WHOLE = re.compile("|".join(f"(?:{p})" for p in _WHOLE))
#: The same patterns in an engine that tells whether a string can be the start of a match.
_PREFIX = regex.compile("|".join(f"(?:{p})" for p in _WHOLE))
_HEAD = 12
_heads: dict[str, bool] = {}
#: The same anywhere in a short sentence.
ANYWHERE = re.compile(
    r"\b(?:replace|delete|edit|overwrite) this (?:paragraph|text|sentence|line|heading|block)\b|"
    r"\b(?:замініть|замените|видаліть|удалите) (?:цей|его|цю|этот|її) ?(?:текст|абзац|рядок)?\b.{0,20}$|"
    r"\b(?:zastąp|usuń) ten (?:tekst|akapit)\b|\b(?:înlocuiți|ștergeți) acest (?:text|paragraf)\b"
)
_ANYWHERE_CUES = ("replace", "delete", "edit", "overwrite", "замін", "замен", "видал", "удал", "zastąp", "usuń", "înlocui", "șterge")
_BULLET = re.compile(r"[^\w\[(\"«]+")
_INVISIBLE = re.compile("[\xad\u200b-\u200d\u2060\ufeff]+")
_ODD_SPACE = re.compile("[ \t\r\xa0\u2000-\u200a\u202f\u3000]{2,}|[\t\xa0\xad\u2000-\u200d\u202f\u2060\u3000\ufeff]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: A notice is a short sentence: its patterns bound it. Filler and program output are looked for in sentences of any length.
LONGEST_NOTICE = 220
_LONG = re.compile(
    rf"{_DUMMY}(?:[\s/,|\-]+{_DUMMY})+|\[?object object\]?(?:[\s,]+\[?object object\]?)*|"
    r"(?:warning|notice|fatal error|parse error|deprecated|uncaught \w*error|php \w+): .*\bon line \d+.*|"
    r"traceback \(most recent call last\).*|(?:\w+\.)*\w+(?:error|exception): .*|at [\w.$<>]+\([\w.]+:\d+\).*|file \"[^\"]+\", line \d+.*|"
    r"sqlstate\[?.*|segmentation fault.*|stack trace:.*"
)


def placeholders(text: str) -> list[tuple[str, int, int]]:
    """(grammar, start, end) of each unfilled placeholder after discounting code and tutorials."""
    if not text.startswith(":") and not any(x in text for x in _OPENINGS):
        return []
    found = [(m.lastgroup, m.start(), m.end()) for m in PLACEHOLDER.finditer(text)]
    if not found:
        return []
    code = [m.span() for m in _FENCE.finditer(text)] if "`" in text or "~~~" in text or "<code" in text or "<pre" in text else []
    real = []
    for kind, a, b in found:
        if any(s <= a and b <= e for s, e in code):
            continue
        left, right = text.rfind("\n", 0, a) + 1, text.find("\n", b)
        if _TUTORIAL.search(text, left, len(text) if right < 0 else right):
            continue
        real.append((kind, a, b))
    if not real and 100.0 * len(found) / (1 + text.count(" ")) >= DENSE and not code:
        return found
    return real


def _strip_bullet(line: str) -> str:
    if line and line[0].isalnum():
        return line
    m = _BULLET.match(line)
    return line[m.end() :] if m else line


def _is_whole(s: str) -> bool:
    """fullmatch of WHOLE; sentences whose first characters begin no pattern are told by a small cache."""
    head = s[:_HEAD]
    can = _heads.get(head)
    if can is None:
        if len(_heads) > 200_000:
            _heads.clear()
        can = _heads[head] = _PREFIX.fullmatch(head, partial=True) is not None
    return can and WHOLE.fullmatch(s) is not None


def _dummy_latin(sentence: str) -> bool:
    words = re.findall(r"[^\W\d_]+", sentence)
    return len(words) >= 4 and sum(w in _LATIN for w in words) >= 0.7 * len(words)


def notice_lines(text: str) -> list[tuple[int, str]]:
    """(line number, kind) of lines holding a sentence that is a notice, filler or program output."""
    low = text.lower()
    if _ODD_SPACE.search(low):
        low = _ODD_SPACE.sub(" ", _INVISIBLE.sub("", low))
    latin = "dolor" in low or "quis" in low or "tempor" in low or "vitae" in low or "lorem" in low
    anywhere = any(x in low for x in _ANYWHERE_CUES)
    found = []
    for k, line in enumerate(low.split("\n")):
        if not line:
            continue
        if len(line) <= LONGEST_NOTICE:
            parts = [line]
            if ". " in line or "! " in line or "? " in line:
                parts += _SENTENCE.split(line)
        else:
            parts = _SENTENCE.split(line)
            if _LONG.fullmatch(_strip_bullet(line).rstrip(" .!\r\t")):
                found.append((k, "notice"))
                continue
        for s in parts:
            if len(s) > LONGEST_NOTICE:
                if _LONG.fullmatch(s := _strip_bullet(s).rstrip(" .!\r\t")):
                    found.append((k, "notice"))
                    break
                if latin and _dummy_latin(s):
                    found.append((k, "filler"))
                    break
                continue
            s = _strip_bullet(s).rstrip(" .!\r\t")
            if _is_whole(s) or anywhere and ANYWHERE.search(s):
                found.append((k, "notice"))
                break
            if latin and _dummy_latin(s):
                found.append((k, "filler"))
                break
    return found


def is_residue(text: str | None) -> bool:
    """Whether the text is a case of problem 10. Null and blank texts are none."""
    return bool(text) and bool(placeholders(text) or notice_lines(text))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with residue: id, number of placeholders and of notice or filler lines.

    A map stage: nothing is shuffled, only the id and the text are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"], pdf["t"]):
                if t:
                    p, n = placeholders(t), notice_lines(t)
                    if p or n:
                        rows.append((i, len(p), len(n), p[0][0] if p else n[0][1]))
            yield pd.DataFrame(rows, columns=["i", "n_placeholders", "n_lines", "kind"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = spread(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")))
    out = narrow.mapInPandas(run, f"i {kind}, n_placeholders int, n_lines int, kind string")
    return out.withColumnRenamed("i", id_col)


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are no case, all columns kept, without a shuffle."""

    @F.pandas_udf("boolean")
    def flag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: is_residue(t) if isinstance(t, str) else False)

    return docs.where(~flag(F.col(text_col)))
