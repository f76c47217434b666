from chaptermill.llm import residue as R

CASES = [
    ("title", "Todo: дописать"), ("title", "{{ chapter_title }}"), ("title", "Удаление {{ object }}"), ("title", "[Название компонента]"), ("title", "HTTP 404 - Not Found"), ("title", "3. 502 Bad Gateway – gw-del"),
    ("title", "# Just a moment..."), ("title", "LOREM IPSUM DOLOR."), ("title", "ДЛЯ РАБОТЫ САЙТА ВКЛЮЧИТЕ JAVASCRIPT"), ("title", "....."), ("title", "NaN"), ("title", "[object Object]"), ("title", "aaaa"), ("title", "#REF!"), ("title", "%s"),
    ("title", "Ошибка 504. Попробуйте позже"), ("title", "<Titel hier einfügen>"), ("title", "Página não encontrada"), ("title", "Traceback (most recent call last):"), ("filename", "9.{{slug}}.md"), ("filename", "{{n}}.opisanie.md"), ("filename", "NaN.zaschita.md"),
    ("filename", "N.slug-here.md"), ("filename", "502 Bad Gateway.html"), ("filename", "filename.ext"), ("filename", "9.stranica-ne-najdena.md"), ("filename", "undefined.undefined.md"), ("filename", "9.404.md"), ("filename", "9.:page.md"),
    ("slug", "null"), ("slug", "503"), ("slug", "your-title-here"), ("slug", "$slug"), ("slug", "lorem-ipsum-dolor"), ("slug", "object-object"), ("slug", "vklyuchite-javascript"),
]
NO_CASES = [
    ("title", None), ("title", ""), ("title", " "), ("title", "Ошибка 404: причины и устранение"), ("title", "Раздел 404"), ("title", "Page not found: redirect rules"), ("title", "Fehler 403 beheben"), ("title", "Null values in reports"), ("title", "Доступ запрещён: разбор случаев"),
    ("title", "Параметр <name> в описании раздела"), ("title", "Шаблоны {{ ... }} в сценариях развёртывания"), ("title", "Template variables and %PATH% values"), ("title", "Переменные вида ${NAME} в файле настроек"), ("title", "When a page asks to enable JavaScript"),
    ("title", "Service Unavailable: a guide for operators"), ("title", "Список TODO в карточке задачи"), ("title", "Тестовый стенд"), ("title", "Элемент <body> страницы"), ("title", "Тег :latest в реестре образов"), ("title", "Настройка хранилища S3"), ("title", "Proteção do registo do sistema"), ("filename", "9.oshibka-404-prichiny-i-ustranenie.md"),
    ("filename", "12.kody-otveta-http.md"), ("slug", "page-not-found-redirect-rules"), ("slug", "razdel-404"), ("slug", "testovyj-stend-ost-queue"), ("slug", "undefined-behaviour-of-the-scheduler"),
]


def test_cases():
    assert [c for c in CASES if R.judged(*c)[0] < R.COVERAGE] == []
    assert [c for c in NO_CASES if R.judged(*c)[0] >= R.COVERAGE] == []


def test_phrases_that_are_not_listed():
    """Notices in other words than the lists have, and single words that name something."""
    found = ["Please turn JavaScript on and reload the page", "Page cannot be displayed", "Sorry, we can't find that page", "This page can't be displayed right now, try again later", "Ut labore et dolore", "Sed do", "Seite kann nicht angezeigt werden", "La página no existe", "{{ name }} — a guide to backups"]
    kept = ["Value", "Exception", "Ref", "Do", "JavaScript", "JavaScript on the page", "The page", "Try again", "Text and title", "Values that cannot be displayed here", "Et", "Reload and refresh"]
    assert [t for t in found if R.judged("title", t)[0] < R.COVERAGE] == []
    assert [t for t in kept if R.judged("title", t)[0] >= R.COVERAGE] == []


def test_batches_give_what_single_values_give():
    cases = CASES + NO_CASES + [("title", "a\nTODO"), ("title", "\n")]
    share, kinds = R.judged_all([f for f, _ in cases], [v for _, v in cases])
    assert [(s, k) for s, k in zip(share.tolist(), kinds)] == [R.judged(*c) for c in cases]


def test_long_value():
    assert R.judged("title", "word " * 100_000)[0] < 0.1


def test_rows(spark):
    df = spark.createDataFrame([(1, "TODO", "1.a.md", None), (1, "TODO", "1.a.md", None), (2, None, "", "null"), (3, "Fine", "3.fine.md", "fine")], "manifest_id long, title string, filename string, slug string")
    got = {tuple(r)[:2] for r in R.residue(df, "manifest_id", ("title", "filename", "slug")).collect()}
    assert got == {(1, "title"), (2, "slug")}
    assert R.residue(df, "manifest_id", ("title", "filename", "slug")).count() == 2
    assert R.residue(df.limit(0), "manifest_id", ("title",)).count() == 0
