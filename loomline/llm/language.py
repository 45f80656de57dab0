"""Problem 1: the language of documents and of their foreign-language lines.

Compression classification: for each language a zstandard dictionary of raw content is made
from labelled samples and a few lines of common words. A line is encoded with each
dictionary; the language whose dictionary gives the smallest output wins, unless the margin
to the second is narrow, in which case the line is rejected (it then counts for no language
of its own). Before that only the script of the letters is looked at: Cyrillic lines are
encoded with the Cyrillic dictionaries, Latin lines with the Latin ones, among them
Ukrainian in Latin letters, made by rule from the Ukrainian samples.

Lines are written in one byte a letter, so that three letters are a match; a letter outside a
language's alphabet is an escape there and costs ``ESCAPE`` bytes more. A document's
language is the one that most letters of its accepted lines are written in; if every line
is rejected, the whole text is encoded at once, and if that is rejected too the language stays
undecided: ``identify`` says ``und`` with confidence 0, and no label is called wrong.
Confidence is the margin: the share of bytes the winner saves against the second; for
documents the share of letters in its language.

Everything is one map stage over (id, text, label); whole texts are read. Null, empty and
letterless texts have no row. Each worker keeps the results of short lines, which recur, in a
memory bounded in bytes. The dictionaries are made of the labelled samples and of ``COMMON``, labelled words written down here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.residue import is_residue
from loomline.session import spread

LANGUAGES = ("uk", "en", "ru", "pl", "ro")
#: At most so many labelled samples, chosen by hash, are read to make the dictionaries.
MOST_SAMPLES = 5000
#: The language of texts that nothing tells apart.
UNDECIDED = "und"
#: A result is rejected if the winner saves less than this share of the second's bytes.
NARROW = 0.025
#: A line is told to be foreign from so many letters on.
LEAST_LETTERS = 25
LEVEL = 6
#: Bytes a letter costs more in a language whose alphabet has no such letter.
ESCAPE = 3

#: Common words of each language, so that lines unlike the samples find matches too.
COMMON = {
    "uk": """і й та в у на з із зі до від для про що як це ця цей ці не є був була було були буде ми ви він вона вони їх його її ваш ваша ваші наш
        який яка яке які коли де чому хто або чи якщо щоб бо але проте тому також ще вже лише тільки можна треба потрібно може можуть всі все усі
        під час після перед між через разом сайт сторінка матеріал портал новини головна пошук питання відповіді контакти карта сайту увійти про нас
        освіта житло робота здоров'я виплати візи читайте також популярне за тиждень схожі матеріали оновлено переглядів час читання автор редакція
        переклад підготувала команда поділитися у соцмережах підпишіться на розсилку усі права захищено умови користування політика приватності
        налаштування можна змінити будь-коли використовуємо файли cookie продовжуючи перегляд ви погоджуєтеся з використанням передрук дозволено
        посиланням є державною установою приймає заяв юридичною порадою зворотний зв'язок угору доступність надішліть друзям своєму чаті
        з чого почати що зробити кому чим перший перша спочатку потім людина день рік місто країна дитина родина гроші мова книга вулиця будинок слово сказав сказала знайшов знайшла біля поруч чому правильна відповідь""",
    "ru": """и в во на с со к от для о об что как это эта этот эти не был была было были будет мы вы он она они их его её ваш ваша ваши наш
        который которая которое которые когда где почему кто или ли если чтобы потому но однако поэтому также ещё уже только можно нужно может могут все всё
        во время после перед между через вместе сайт страница материал портал новости главная поиск вопросы ответы контакты карта сайта войти о нас
        образование жильё работа здоровье выплаты визы читайте также популярное за неделю похожие материалы обновлено просмотров время чтения автор редакция
        перевод подготовила команда поделиться в соцсетях подпишитесь на рассылку все права защищены условия использования политика приватности
        настройки можно изменить в любой момент используем файлы продолжая просмотр вы соглашаетесь с использованием перепечатка разрешена
        ссылкой не является государственным учреждением принимает заявлений юридической консультацией обратная связь наверх доступность отправьте друзьям
        с чего начать что сделать кому чем первый первая сначала потом человек день год город страна ребёнок семья деньги язык книга улица дом слово сказал сказала нашёл нашла возле рядом правильный ответ""",
    "en": """the a an and or but of to in on at by for with from about into over after before between through under is are was were be been being it its
        this that these those we you he she they them his her their your our who which what when where why how if because so that not no yes can could
        may might must should will would have has had do does did all any some more most other only also site page portal news home search help and answers
        contact us site map sign in about us education housing work health benefits visas read next popular this week related guides last updated page views
        reading time written by the desk prepared by the volunteer team reviewed by the language group share this page follow for daily answers sign up to the
        newsletter for updates all rights reserved terms of use privacy policy accessibility you can change your privacy settings at any time we use some
        essential cookies by continuing to browse you agree to the use of cookies reprint only with a link is not a public body and takes no applications
        general information and not legal advice feedback back to top enjoyed this guide send it to a friend accept all manage choices
        person day year city country child family money language book street house word said found near beside correct answer""",
    "pl": """i w we na z ze do od dla o po przy przez nad pod przed między że jak to ta ten te nie jest są był była było byli będzie my wy on ona oni ich jego jej
        wasz wasza nasz który która które kiedy gdzie dlaczego kto albo lub czy jeśli jeżeli żeby aby bo ale jednak więc też także jeszcze już tylko można trzeba
        może mogą wszystko wszystkie wszyscy podczas po strona serwis portal aktualności strona główna szukaj pytania i odpowiedzi kontakt mapa strony zaloguj się o nas
        edukacja mieszkania praca zdrowie zasiłki wizy czytaj dalej popularne w tym tygodniu podobne artykuły aktualizacja godz wyświetlenia czas czytania autor redakcja
        tłumaczenie grupa językowa przygotował zespół wolontariuszy udostępnij tę stronę zapisz się do biuletynu i czytaj nowości wszelkie prawa zastrzeżone
        warunki korzystania polityka prywatności dostępność ustawienia prywatności możesz zmienić w każdej chwili używamy plików cookie aby działał lepiej
        korzystając dalej ze strony zgadzasz się przedruk tylko z odnośnikiem nie jest urzędem i nie przyjmuje wniosków materiały mają charakter informacyjny
        i nie są poradą prawną opinie do góry podoba ci się artykuł wyślij go znajomym akceptuję człowiek dzień rok miasto kraj dziecko rodzina pieniądze""",
    "ro": """și în la cu de din pe pentru despre prin după înainte între sub că ca este sunt era erau fi fost va vor nu da noi voi el ea ei ele lor lui
        dumneavoastră care ce când unde cum dacă deoarece fiindcă dar însă deci sau ori mai foarte doar numai și se poate pot trebuie toate toți tot
        un o unei unui ale al ai lui în timpul pagina site portal știri noutăți acasă căutare întrebări și răspunsuri contact harta site-ului autentificare despre noi
        educație locuințe muncă sănătate alocații vize citiți și popular săptămâna aceasta articole similare actualizat ora vizualizări timp de citire autor redacția
        traducere grupul lingvistic pregătit de echipa de voluntari distribuiți această pagină abonați-vă la buletinul pentru noutăți în fiecare luni toate drepturile
        rezervate termeni de utilizare confidențialitate accesibilitate puteți schimba setările oricând folosim module cookie ca să funcționeze mai bine continuând
        navigarea sunteți de acord reproducere numai cu link nu este instituție publică și nu primește cereri materialele au caracter informativ și nu sunt sfaturi
        juridice păreri sus v-a plăcut articolul trimiteți-l prietenilor accept om zi an oraș țară copil familie bani limbă carte stradă casă cuvânt""",
}

_HOST = re.compile(r"(?:https?://)?(?:[\w\-]+\.)+[a-z]{2,}(?:/\S*)?", re.IGNORECASE)
_DOTTED = re.compile(r"\.[a-zA-Z]{2}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: One byte for each letter the five languages use; others share a byte by their code.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґąćęłńóśźżăâîșțşţ' "
#: Letters of the other languages of the same script that a language does not use.
_FOREIGN = {
    "uk": "ыэёъ", "ru": "іїєґ", "en": "ąćęłńóśźżăâîșțşţ", "pl": "ăâîșțşţqvx", "ro": "ąćęłńóśźżyk", "uk-latin": "ąćęłńóśźżăâîșțşţqxwj",
}
_BYTES = {ord(c): chr(0x21 + k) for k, c in enumerate(_ALPHABET)}
#: The Ukrainian national romanization: first the letters with another form at a word's start.
_ROMAN_FIRST = {"є": "ye", "ї": "yi", "й": "y", "ю": "yu", "я": "ya"}
_ROMAN = dict(zip("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "a b v h g d e ie zh z y i i i k l m n o p r s t u f kh ts ch sh shch _ iu ia".split()))
#: Results kept by a worker, by line and by words, and letters of a line whose result is kept: about 60 MB each.
_KEEP, _KEEP_LETTERS = 100_000, 240


def romanize(text: str) -> str:
    """Ukrainian in Latin letters; soft signs and apostrophes fall away."""
    text = text.lower().replace("зг", "zgh").replace("'", "").replace("’", "")
    text = re.sub(r"(?<!\w)[єїйюя]", lambda m: _ROMAN_FIRST[m[0]], text)
    return "".join(_ROMAN.get(c, c) for c in text).replace("_", "")


def letters_only(line: str) -> str:
    """The words of a line in lower case, without host names, digits and signs."""
    if _DOTTED.search(line):
        line = _HOST.sub(" ", line)
    return _NOT_LETTERS.sub(" ", line.lower().replace("’", "'")).strip()


def _encode(words: str) -> bytes:
    return words.translate(_BYTES).encode("latin-1", "replace")


def _others(letters: str) -> bytes:
    """The bytes that are not those of the letters: what to delete in order to count them."""
    return bytes(set(range(256)) - set(_encode(letters)))


_NOT_CYRILLIC = _others("".join(c for c in _ALPHABET if c >= "Ѐ" and c <= "ӿ"))


class Classifier:
    """Dictionaries from (language, text) samples."""

    def __init__(self, samples: list[tuple[str, str]], narrow: float = NARROW):
        content = {lang: [letters_only(COMMON.get(lang, ""))] for lang in LANGUAGES}
        for lang, text in samples:
            if lang in content and text:
                content[lang].append(letters_only(text))
        latin_uk = [letters_only(romanize(x)) for x in content["uk"]]
        self.narrow = narrow
        escapes = {k: _others(v) for k, v in _FOREIGN.items()}
        self.cyrillic = [(lang, self._compressor(content[lang]), escapes[lang]) for lang in ("uk", "ru")]
        self.latin = [(lang, self._compressor(content[lang]), escapes[lang]) for lang in ("en", "pl", "ro")]
        self.latin.append(("uk", self._compressor(latin_uk), escapes["uk-latin"]))
        self.known: dict[str, tuple[str | None, float]] = {}
        self.lines: dict[str, tuple[str | None, float, int]] = {}

    @staticmethod
    def _compressor(parts: list[str]) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(_encode(" ".join(parts)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=300, dict_size=len(raw), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        raw.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)

    def classify(self, words: str) -> tuple[str | None, float]:
        """(language or None if the margin is narrow, confidence) of the words of a line."""
        got = self.known.get(words)
        if got is None:
            got = self._classify(words)
            if len(words) <= _KEEP_LETTERS:
                if len(self.known) >= _KEEP:
                    self.known.clear()
                self.known[words] = got
        return got

    def _classify(self, words: str) -> tuple[str | None, float]:
        n = len(words) - words.count(" ")
        if not n:
            return None, 0.0
        data = _encode(words)
        cyrillic = len(data.translate(None, _NOT_CYRILLIC))
        # a line in both scripts belongs to the script of most of its letters
        tried = self.cyrillic if 2 * cyrillic >= n else self.latin
        sizes = sorted((len(c.compress(data)) + ESCAPE * len(data.translate(None, escapes)), lang) for lang, c, escapes in tried)
        (best, lang), (second, _) = sizes[0], sizes[1]
        margin = (second - best) / second
        return (lang if margin >= self.narrow and second > best else None), round(margin, 4)

    def document(self, text: str) -> tuple[str | None, float, list[tuple[int, str, float, int]]]:
        """(language, confidence, [(line_no, language, confidence, letters)] of its accepted lines)."""
        lines, votes, total = [], {}, 0
        for k, line in enumerate(text.split("\n")):
            if not line:
                continue
            got = self.lines.get(line)
            if got is None:
                words = letters_only(line)
                n = len(words) - words.count(" ")
                got = (*self.classify(words), n) if n else (None, 0.0, 0)
                if len(line) <= _KEEP_LETTERS:
                    if len(self.lines) >= _KEEP:
                        self.lines.clear()
                    self.lines[line] = got
            lang, confidence, n = got
            total += n
            if lang:
                lines.append((k, lang, confidence, n))
                votes[lang] = votes.get(lang, 0) + n
        if not total:
            return None, 0.0, []
        if not votes:
            lang, confidence = self._classify(letters_only(text))
            return (lang, confidence, []) if lang else (UNDECIDED, 0.0, [])
        lang = max(votes, key=lambda x: (votes[x], x))
        return lang, round(votes[lang] / total, 4), lines


_NAMES = {
    "uk": "uk ukr ukrainian українська ukraińska украинский ucraineană", "en": "en eng english англійська английский angielski engleză",
    "ru": "ru rus russian російська русский rosyjski rusă", "pl": "pl pol polish польська польский polski poloneză",
    "ro": "ro ron rum romanian moldavian mo mol румунська румынский rumuński română",
}
_LABELS = {name: lang for lang, names in _NAMES.items() for name in names.split()}


def label_language(label: str | None) -> str | None:
    """The language a label names, None if it is missing or names no known language."""
    if not isinstance(label, str):
        return None
    label = label.strip().lower()
    return _LABELS.get(label) or _LABELS.get(re.split(r"[-_ (]", label)[0])


def read_samples(samples: DataFrame, lang: str = "lang", text: str = "text", most: int = MOST_SAMPLES) -> list[tuple[str, str]]:
    """The bounded sample of labelled texts the dictionaries are made of: those of the least hashes, in a fixed order."""
    rows = samples.where(F.col(text).isNotNull()).select(lang, text).orderBy(F.xxhash64(text, lang), text, lang).limit(most).collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (len(r[1]), r[1], r[0] or ""))


_made: dict[int, Classifier] = {}


def _worker(samples: list[tuple[str, str]]) -> Classifier:
    key = hash(tuple(samples))
    if key not in _made:
        _made.clear()  # one at a time is in use
        _made[key] = Classifier(samples)
    return _made[key]


def identify(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", skip_residue: bool = True) -> DataFrame:
    """(id, line_no, lang, confidence, label_lang): line_no -1 for the document, then its accepted lines.

    ``skip_residue`` leaves out the cases of problem 10.
    """
    known = docs.sparkSession.sparkContext.broadcast(read_samples(samples))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = _worker(known.value)
        for pdf in batches:
            rows = []
            for i, t, named in zip(pdf["i"], pdf["t"], pdf["named"]):
                if not t or skip_residue and is_residue(t):
                    continue
                lang, confidence, lines = classifier.document(t)
                if lang is None:
                    continue
                named = label_language(named)
                rows.append((i, -1, lang, confidence, named, 0))
                rows += [(i, k, x, c, named, n) for k, x, c, n in lines]
            yield pd.DataFrame(rows, columns=["i", "line_no", "lang", "confidence", "label_lang", "letters"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = spread(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(label).alias("named")))
    out = narrow.mapInPandas(run, f"i {kind}, line_no bigint, lang string, confidence double, label_lang string, letters int")
    return out.withColumnRenamed("i", id_col)


def wrong_labels_and_foreign_lines(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(id, line_no, lang, confidence): documents whose label is missing or wrong, and lines in another language than theirs."""
    known = docs.sparkSession.sparkContext.broadcast(read_samples(samples))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = _worker(known.value)
        for pdf in batches:
            rows = []
            for i, t, named in zip(pdf["i"], pdf["t"], pdf["named"]):
                if not t or is_residue(t):
                    continue
                lang, confidence, lines = classifier.document(t)
                if lang is None:
                    continue
                if lang != UNDECIDED and label_language(named) != lang:
                    rows.append((i, -1, lang, confidence))
                rows += [(i, k, x, c) for k, x, c, n in lines if x != lang and n >= LEAST_LETTERS]
            yield pd.DataFrame(rows, columns=["i", "line_no", "lang", "confidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = spread(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(label).alias("named")))
    return narrow.mapInPandas(run, f"i {kind}, line_no bigint, lang string, confidence double").withColumnRenamed("i", id_col)
