import random

from pyspark.sql import functions as F

from chaptermill.llm import split as S


def checked(text, limit=4000, overlap=200):
    spans = S.cuts(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert 0 < b - a <= limit or not text
    for (_, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - overlap and d > b
    return spans


def test_limits():
    assert len(checked("x" * 4000)) == 1 and len(checked("x" * 4001)) == 2
    assert checked("") == [(0, 0)]
    checked("я" * 50_000)


def test_cuts_at_blocks():
    page = "".join(f"<p>{'word ' * 40}</p>\n" for _ in range(60))
    for _, b in checked(page)[:-1]:
        assert page[:b].rstrip().endswith("</p>")


def test_deepest_valley_wins():
    one = "".join(f"<p>{'router network packet address route ' * 5}</p>" for _ in range(11))
    two = "".join(f"<p>{'garden flower water soil plant tree ' * 5}</p>" for _ in range(30))
    first = checked(one + two)[0]
    assert first[1] == len(one)


def test_sentences_spaces_tags():
    text = "<p>" + "A sentence of words goes here. " * 400 + "</p>"
    assert all(text[:b].endswith(". ") for _, b in checked(text)[:-1])
    spaced = "<p>" + "word " * 3000
    assert all(spaced[b - 1] == " " for _, b in checked(spaced)[:-1])
    tagged = ("a" * 3990 + '<img src="x" alt="y">') * 3
    for _, b in checked(tagged)[:-1]:
        assert tagged.rfind("<", 0, b) <= tagged.rfind(">", 0, b) or b - tagged.rfind("<", 0, b) > 21
    marked = "é" * 5000
    assert all(marked[b] != "́" for _, b in checked(marked)[:-1])


def test_random_pages():
    rng = random.Random(1)
    bits = ["<h2>t</h2>", "<p>some words here.</p>", "<li>x</li>", "plain text. ", "<table><tr><td>1</td></tr></table>", "&amp;", "\n\n", "base64" * 90, "<", ">", "é" * 300]
    for _ in range(60):
        checked("".join(rng.choice(bits) for _ in range(rng.randrange(1, 400))), rng.choice([400, 1000, 4000]), rng.choice([0, 50, 150]))


def test_rows(spark):
    long = "<p>" + "слово " * 1500 + "</p>"
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, "x" * 4000, 0), (3, None, 0), (4, "", 0)], "chapter_id long, chapter_html string, piece_no int")
    rows = S.split_oversized(df, "chapter_id", "chapter_html").orderBy("piece_no").collect()
    assert {r.chapter_id for r in rows} == {1} and [r.piece_no for r in rows] == list(range(1, rows[0].n_pieces + 1))
    assert rows[0].piece + "".join(r.piece[200:] for r in rows[1:]) == long
    assert all(b.piece[:200] == a.piece[-200:] for a, b in zip(rows, rows[1:]))
    assert S.split_oversized(df.filter(F.lit(False)), "chapter_id", "chapter_html").count() == 0


def test_windows_without_shared_words_are_unlike():
    letters = [chr(97 + i) * 2 + chr(97 + j) for i in range(12) for j in range(10)]
    one, two = " ".join(letters[:60]) + "\n\n", " ".join(letters[60:]) + "\n\n"
    text, gaps = one + one + two + two, [len(one), 2 * len(one), 2 * len(one) + len(two)]
    assert [round(float(d), 6) for d in S.valley_depths(text, gaps)] == [0, 2, 0]
    assert len(S.valley_depths("<p>1</p>" * 600, list(range(8, 4800, 8)))) == 599
