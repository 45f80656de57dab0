"""Problem 1: held-out accuracy, and defined results of odd inputs."""

from pyspark.sql import functions as F

from loomline.llm import language as L

SAMPLES = [
    ("uk", "Щоб отримати житлову виплату, зверніться до міської ради протягом п'яти днів."),
    ("uk", "Волонтери супроводжують родини до лікарні двічі на тиждень, якщо потрібен переклад."),
    ("ru", "Чтобы получить жилищное пособие, обратитесь в городской совет в течение пяти дней."),
    ("ru", "Волонтёры сопровождают семьи в больницу дважды в неделю, если нужен перевод."),
    ("en", "To get housing support, contact the city council within five working days."),
    ("en", "Volunteers accompany families to the hospital twice a week if a translation is needed."),
    ("pl", "Aby otrzymać pomoc mieszkaniową, zgłoś się do rady miasta w ciągu pięciu dni."),
    ("pl", "Wolontariusze towarzyszą rodzinom do szpitala dwa razy w tygodniu."),
    ("ro", "Pentru a obține ajutorul pentru locuință, mergeți la consiliul local în cinci zile."),
    ("ro", "Voluntarii însoțesc familiile la spital de două ori pe săptămână."),
]
HELD_OUT = [
    ("uk", "Коли змінюється адреса, повідомте про це школу та банк, щоб не втратити місце."),
    ("uk", "Koly zminiuietsia adresa, povidomte pro tse shkolu ta bank, shchob ne vtratyty mistse."),
    ("ru", "Когда меняется адрес, сообщите об этом школе и банку, чтобы не потерять место."),
    ("en", "When your address changes, report it to the school and the bank so that you keep your place."),
    ("pl", "Gdy zmienia się adres, zgłoś to szkole i bankowi, żeby nie stracić miejsca."),
    ("ro", "Când se schimbă adresa, anunțați școala și banca, ca să nu pierdeți locul."),
]


def test_held_out_lines():
    c = L.Classifier(SAMPLES)
    assert [c.document(t)[0] for _, t in HELD_OUT] == [lang for lang, _ in HELD_OUT]


def test_narrow_margin_is_rejected():
    c = L.Classifier(SAMPLES)
    assert c.classify("")[0] is None
    assert c.classify("кккк")[0] is None
    assert c.document("кккк")[:2] == ("und", 0.0) and c.document("zz")[:2] == ("und", 0.0)
    assert c.document("123 — 456")[0] is None  # no letters


def test_labels():
    same = {"uk": ["uk", "UK", "uk-UA", "ukr", "Ukrainian", " uk "], "en": ["en-GB", "eng", "English", "EN"], "ro": ["ron", "ro_RO"]}
    for lang, labels in same.items():
        assert {L.label_language(x) for x in labels} == {lang}
    assert {L.label_language(x) for x in (None, "", " ", "n/a", "unknown", "und", "xx")} == {None}


def test_found(spark):
    uk, en = HELD_OUT[0][1], HELD_OUT[3][1]
    rows = [
        (1, uk, "uk", "x"), (2, uk, "ru", None), (3, f"{uk}\n\n{uk}\n{en}", None, "x"), (4, None, None, None), (5, "", "uk", "x"), (6, "123 — 456", None, "x"),
        (7, f"{uk}\nfollow us at very-long-host-name.example.org", "Ukrainian", "x"), (8, "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "uk", "x"), (2, uk, "ru", None),
        (9, (uk + "\n") * 500, "uk", "x"), (10, "кккк", "ru", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, line_no string")
    samples = spark.createDataFrame(SAMPLES, "lang string, text string")
    got = sorted((r.doc_id, r.line_no, r.lang) for r in L.wrong_labels_and_foreign_lines(docs, samples).collect())
    assert got == [(2, -1, "uk"), (2, -1, "uk"), (3, -1, "uk"), (3, 3, "en")]
    whole = L.identify(docs, samples).where("line_no = -1")
    assert {r.doc_id for r in whole.collect()} == {1, 2, 3, 7, 9, 10}
    assert [(r.lang, r.confidence) for r in whole.where("doc_id = 10").collect()] == [("und", 0.0)]
    assert L.wrong_labels_and_foreign_lines(docs.limit(0), samples).count() == 0
    assert L.identify(docs.where("doc_id = 1"), samples.limit(0)).where(F.col("line_no") == -1).first().lang == "uk"


def test_documents_with_residue_have_a_language(spark, tmp_path):
    from loomline.llm import queries

    text = "You can ask the council for help with your housing and your school place this week.\nLorem ipsum dolor sit amet, consectetur adipiscing elit."
    spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(SAMPLES, "lang string, text string").write.parquet(f"{tmp_path}/lang_samples.parquet")
    assert queries.p1_languages(spark, str(tmp_path)).where("line_no = -1").first().lang == "en"
    assert queries.p1_found(spark, str(tmp_path)).count() == 0  # without the cases of problem 10
