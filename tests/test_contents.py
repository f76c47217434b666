import random
import time

from pyspark.sql import functions as F

from chaptermill.operators import contents as C


def fold(spark, html, toc, **options):
    df = spark.createDataFrame([(html, toc)], "html string, toc array<struct<level int, number string, title string>>")
    return df.select(C.folded(F.col("html"), F.col("toc"), **options).alias("x")).first().x


def test_parse(spark):
    rows = [("toc 1", " 1 Общие\t3"), ("toc 12", "1.2.3 a b"), ("toc", "1 x"), ("Toc 1", "1 x"), ("toc 2", "no number"), (None, "1 x"), ("toc 1", None), ("toc 1", "\xa0"), ("toc 3", "4.1\xa0c\t")]
    got = C.parsed_contents(spark.createDataFrame(rows, "style string, text string")).select("level", "number", "title").collect()
    assert [tuple(r) for r in got] == [(1, "1", "Общие"), (12, "1.2.3", "a b"), (3, "4.1", "c")]


def test_parse_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "style string, text string, level string, title int, number int")
    assert C.parsed_contents(empty).count() == 0
    one = spark.createDataFrame([("toc 1", "1 a", "x", 5, 6)], empty.schema)
    assert C.parsed_contents(one).select("level", "number", "title").first()[:] == (1, "1", "a")


def test_fold_glued_title(spark):
    html = '<a id="__RefHeading___3"></a>ФункцииКомплекс реализует функции'
    assert fold(spark, html, [(2, "1.2", "Функции")]) == "<h2>1.2 Функции</h2>Комплекс реализует функции"


def test_fold_case_tags_signs(spark):
    html = '<p><a id="__RefHeading___1"></a> <b><i>СТОИМОСТЬ ($5)</i></b></p>'
    assert fold(spark, html, [(1, "1", "Стоимость ($5)")]) == "<p><h1>1 Стоимость ($5)</h1></i></b></p>"


def test_fold_miss_drops_the_first_anchor(spark):
    html = '<a id="__RefHeading___1"></a>x<a id="__RefHeading___2"></a>One'
    toc = [(1, "1", "Absent"), (1, "2", "One")]
    assert fold(spark, html, toc) == "x<h1>2 One</h1>"
    assert fold(spark, html, [(1, "1", "A"), (1, "2", "B"), (1, "3", "One")]) == "xOne"
    assert fold(spark, html, [(1, "1", "A"), (1, "2", "B"), (1, "3", "One")], drop_on_miss=False) == "x<h1>3 One</h1>"


def test_fold_empty_and_null(spark):
    html = '<a id="__RefHeading___1"></a>x'
    assert fold(spark, html, []) == html
    assert fold(spark, None, [(1, "1", "x")]) is None


def test_numbering_map_first_place_last_number(spark):
    rows = [(1, 1, "a", "1"), (1, 5, "a", "9"), (1, 3, "b", "2"), (2, 1, "a", "7"), (1, 9, None, "8")]
    df = spark.createDataFrame(rows, "g int, pos int, title string, number string")
    assert {tuple(r) for r in C.numbering_map(df, "g").collect()} == {(1, "a", "9", 1), (1, "b", "2", 3), (2, "a", "7", 1)}


def test_from_first(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "go"), (1, 3, "y"), (2, 1, "x"), (1, 5, "go")], "g int, pos int, t string")
    assert {tuple(r) for r in C.from_first(df, "g", "pos", F.col("t") == "go").collect()} == {(1, 2, "go"), (1, 3, "y"), (1, 5, "go")}


def test_cascade(spark):
    texts = ["4.1.2.1 Подготовка", "4.1.2 П", "4.1 П", "4 На", "4 НА", "4.1 x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.numbered_depth(F.col("t"))).collect()] == [4, 3, 2, 1, None, None, None]


def test_fold_of_pages_is_that_of_columns(spark):
    rng = random.Random(11)
    words = ["Alpha", "beta", "Alpha beta", "gamma", " ", "<b>", "</b>", "<i> ", "\n", "x"]
    rows = []
    for n in range(400):
        page = "".join(f'<a id="__RefHeading___{rng.randrange(9)}"></a>' if rng.random() < 0.35 else rng.choice(words) for _ in range(rng.randrange(14)))
        toc = [(rng.randrange(1, 4), f"{k}.{rng.randrange(3)}", rng.choice(["alpha", "Beta", "ALPHA BETA", "gamma", "none", "x"])) for k in range(rng.randrange(5))]
        rows.append((n, page, toc))
    df = spark.createDataFrame(rows, "n int, page string, toc array<struct<level int, number string, title string>>")
    got = {r.n: r.h for r in df.select("n", C.folded(F.col("page"), F.col("toc")).alias("h")).collect()}
    for n, page, toc in rows:
        assert C.fold_page(page, toc) == got[n], (page, toc)
    assert len({got[n] for n, _, _ in rows}) > 200


def test_fold_of_a_book():
    titles = [f"Title number {k} of the book" for k in range(2000)]
    page = "".join(f'<p>{"word " * 50}</p><a id="__RefHeading___{k}"></a><b>{t}</b>' for k, t in enumerate(titles))
    began = time.perf_counter()
    folded = C.fold_page(page, [(1, str(k), t) for k, t in enumerate(titles)])
    assert folded.count("<h1>") == 2000 and "__RefHeading" not in folded and time.perf_counter() - began < 5
