from pyspark.sql import functions as F

from chaptermill.operators import pages as P


def test_split():
    first, second = "<h1 id='a'>Install</h1><pre>ls</pre><p>then</p>", "<h1>Remove</h1><ol><li>x</li></ol>"
    assert P.split_at("<div>cover</div>" + first + second) == [first, second]
    assert P.split_at("<h2>only a section</h2>") == [] and P.split_at(" ") == []
    assert P.split_at("<p>before</p><html><body><H1>x</H1>text<br>y<ul><li>1<li>2</ul></body></html>") == ["<H1>x</H1>text<br>y<ul><li>1<li>2</ul>"]


def test_siblings_repair():
    assert P.siblings("<p>a<p>b<div>c</div>") == [("p", "<p>a</p>"), ("p", "<p>b</p>"), ("div", "<div>c</div>")]
    assert P.siblings("<script>var x = '</p><h1>';</script><h1>t</h1>") == [("script", "<script>var x = '</p><h1>';</script>"), ("h1", "<h1>t</h1>")]
    assert P.siblings("</p>x<h1>t") == [("", "x"), ("h1", "<h1>t")]


def test_contents_removed():
    link = lambda n, text: f'<a href="#__RefHeading___{n}">{text}</a>'
    kept = '<p>See <a href="https://example.org/x">there</a> or <a href="#notes">below</a>.</p><table><tr><td>1</td></tr></table>'
    page = f"<p><b>СОДЕРЖАНИЕ</b> {link(7, 'Setup')}</p><hr><p>{link(8, 'Use')}</p>{kept}<p>{link(9, '3.2 Backup 14')}</p><p>{link(1, 'x')}; {link(2, 'y')}</p>"
    assert P.contents_removed(page) == f"<html><body><hr>{kept}</body></html>"
    assert P.contents_removed(kept) == f"<html><body>{kept}</body></html>"
    one = f"<p>Read {link(4, 'Restore')} first</p>"
    assert P.contents_removed(one) == f"<html><body>{one}</body></html>"
    assert "СОДЕРЖАНИЕ" in P.contents_removed(f"<p>СОДЕРЖАНИЕ</p>{one}")


def test_rows(spark):
    df = spark.createDataFrame([(1, "<h1>a</h1><h1>b</h1>"), (2, "<p>x</p>"), (3, None), (4, "")], "id int, html string")
    assert {tuple(r) for r in P.chapters(df, "id", "html").collect()} == {(1, 1, "<h1>a</h1>"), (1, 2, "<h1>b</h1>")}
    assert {r.id for r in P.without_chapters(df, "id", "html").collect()} == {2, 3, 4}
    assert {tuple(r) for r in P.chapters(df, "id", "html", only=2).collect()} == {(1, 2, "<h1>b</h1>")}
    assert P.sibling_rows(df, "id", "html").count() == 3
    assert P.chapters(df.filter("id > 9"), "id", "html").count() == 0


def test_completeness(spark):
    html = "<h1>One</h1><h2> </h2><h3>Two</h3><pre><code>print('hello')&lt;</code></pre><code>short</code>"
    df = spark.createDataFrame([(html, "# One\n## Two\nprint('hello')<"), (html, "# One"), (None, "x"), (html, None), ("", "")], "h string, m string")
    got = [r[0] for r in df.select(P.completeness(F.col("h"), F.col("m"))).collect()]
    assert tuple(got[0]) == (3, 0, 3, 0, False) and tuple(got[1]) == (3, 1, 3, 2, True)
    assert got[2] is None and got[3] is None and tuple(got[4]) == (0, 0, 0, 0, False)


def test_split_at_nested_headings():
    assert P.split_at("<ul><li>x<h1>One</h1><p>A</p></li><li><H1 id='2'>Two</H1>B</li></ul><p>C</p>") == ["<h1>One</h1><p>A</p>", "<H1 id='2'>Two</H1>B"]
    assert P.split_at("<table><tr><td><h1>T</h1>t</td></tr></table><h1>Top</h1><div>d<section><h1>In</h1>i</section></div><p>p</p><h1>End</h1>") == [
        "<h1>T</h1>t", "<h1>Top</h1><div>d<section><h1>In</h1>i</section></div><p>p</p>", "<h1>In</h1>i", "<h1>End</h1>",
    ]
    assert P.split_at("<div><!-- <h1>no</h1> --><script>'<h1>'</script><p title='<h1>'>x</p></div>") == [] and P.split_at("<div><div><h1>open") == ["<h1>open"]
    assert P.split_at("<div>" * 2000 + "<h1>deep</h1>" + "</div>" * 2000) == ["<h1>deep</h1>"]
