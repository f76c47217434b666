import random

from pyspark.sql import functions as F

from chaptermill.operators import matching as J


def plainly(text, titles, boost=0.0, above=0.5):
    best = None
    for i, t in sorted(titles):
        a, b = set(text.lower().split()), set(t.lower().split())
        score = len(a & b) / len(a | b) if a | b else 0.0
        if boost and text.lower().split()[:3] == t.lower().split()[:3]:
            score += boost
        if (text.lower() == t.lower()) if boost else text == t:
            score = 2.0
        if score > above and (best is None or score > best[1]):
            best = (i, score)
    return best


def test_best_matches(spark):
    rng = random.Random(3)
    words = ["Настройка", "агента", "Node", "2", "API", "шлюза", "node"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    titles = [(i, make()) for i in range(15)] + [(15, "")]
    texts = [make() for _ in range(120)] + ["", None, " "]
    left = spark.createDataFrame([(t, 1) for t in texts], "text string, score int").union(spark.createDataFrame([(texts[0], 2)], "text string, score int"))
    right = spark.createDataFrame(titles + [titles[0]], "id int, title string")
    for boost, above in ((0.0, 0.5), (0.3, 0.6)):
        got = {r.text: (r.id, round(float(r.score), 6)) for r in J.best_matches(left, "text", right, "title", "id", above, boost).collect()}
        want = {t: (p[0], round(p[1], 6)) for t in set(texts) - {None} if (p := plainly(t, titles, boost, above))}
        assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    titles = spark.createDataFrame([(1, "a")], "id int, title string")
    assert J.best_matches(none, "text", titles, "title", "id").count() == 0


def test_lookup_in_markup(spark):
    html = '<a id="__RefHeading___1"></a>Назначение системы. x <a id="__RefHeading___2"></a>Другое слово<b>'
    df = spark.createDataFrame([(html, [(2, "1.1", "назначение Системы"), (3, "9", "Нет")])], "h string, toc array<struct<level int, number string, title string>>")
    assert df.select(J.headings_from_anchors(F.col("h"), F.col("toc"))).first()[0] == '<h2>1.1 назначение Системы</h2>. x <a id="__RefHeading___2"></a>Другое слово<b>'


def test_search(spark):
    df = spark.createDataFrame([(i, f"text {i} Docker") for i in range(9)] + [(10, None), (11, "")], "id int, t string")
    hits = J.text_hits(df, "id", "t", ["DOCKER", "absent"])
    assert hits.count() == 9 and hits.first().term == "DOCKER"
    assert [r.id for r in J.first_hits(hits, 5, "id").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_fallback(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    one = J.primary_or_fallback(df, F.col("t") == "a", F.col("t") == "b")
    two = J.primary_or_fallback(df, F.col("t") == "z", F.col("t") == "b")
    assert [r.t for r in one.collect()] == ["a"] and [r.t for r in two.collect()] == ["b"]


def test_missing_texts(spark):
    df = spark.createDataFrame([(["a", " ", "b"], "xa")], "t array<string>, w string")
    assert df.select(J.missing_texts(F.col("t"), F.col("w"))).first()[0] == ["b"]
