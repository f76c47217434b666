"""Rules of style: nulls, empty texts and the cases that the tables lack."""

from pyspark.sql import functions as F

from chaptermill.operators import contents as C
from chaptermill.operators import matching as J
from chaptermill.operators import rules as R


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_pages(spark):
    html = '<pre><code class="language-terminal">$ ls &lt;x\n</code></pre><pre><code class="language-conf filename-nginx">a</code></pre><pre><code>no</code></pre>'
    assert one(spark, html, R.code_fences) == ["```bash Terminal\n$ ls <x\n```", "```conf nginx.conf\na\n```"]
    assert one(spark, '<ul class="component-list"><li>a;</li><li>b.</li></ul><ul><li>c</li></ul>', R.component_lists) == ["- a;", "- b;"]
    for f in (R.code_fences, R.annotations, R.captions, R.component_lists):
        assert one(spark, "", f) == [] and one(spark, None, f) in (None, [])


def test_markdown(spark):
    assert one(spark, "Do:\n\na;\n\nb;\n\nc.\n\nEnd.", R.listed_paragraphs) == "Do:\n\n- a;\n- b;\n- c.\n\nEnd."
    assert one(spark, "# x;\n\ny", R.listed_paragraphs) == "# x;\n\ny" and one(spark, "", R.listed_paragraphs) == ""
    assert [tuple(r)[::2] for r in one(spark, "- `a` — b;\n- `c` - d;\n- `e` — f.", R.component_items)] == [(0, True), (1, False), (2, True)]
    assert [tuple(r) for r in one(spark, "|a|b|c|\n|:-|:-:|-:|\n|1<br>2|3|4|", R.table_columns)] == [(1, "lcr", 1)]
    assert [r.line_no for r in one(spark, "Note: x\n> _Note_ – y\n> **Note** – z\nNotes are", R.bare_notes)] == [0, 2]
    assert [r.line_no for r in one(spark, "# 1 A\n# B\n## 1.1 C\n## D\n### 1.1 E\n##### F", R.misnumbered_headings)] == [0, 3, 4]
    assert [tuple(r) for r in one(spark, "::sign-image\nsrc: /a.png\nsign: Рисунок 3 – x\n::\n", R.sign_images)] == [("/a.png", "Рисунок 3 – x", "3")]
    wrapped = one(spark, "a <table><tr></tr></table> b", R.wrapped_tables)
    assert wrapped == 'a <div class="joplin-table-wrapper">\n<table><tr></tr></table>\n</div> b' and one(spark, wrapped, R.wrapped_tables) == wrapped
    for f in (R.listed_paragraphs, R.component_items, R.table_columns, R.bare_notes, R.misnumbered_headings, R.image_blocks, R.sign_images, R.wrapped_tables):
        assert one(spark, None, f) is None


def test_numbers_of_texts(spark):
    toc = C.numbering_map(spark.createDataFrame([(1, 5, "Set up the node", "1.1"), (1, 2, "Set up the host", "1.2"), (1, 9, "Set up the host", "1.3"), (2, 1, "Set up the node", "7")], "g int, pos int, title string, number string"), "g")
    texts = spark.createDataFrame([(1, "Set up the node"), (1, "set up the"), (1, "nothing"), (2, "SET UP the node"), (3, "Set up the node"), (None, "x"), (1, None), (1, "set up the")], "g int, t string")
    got = {(r.g, r.t): (r.number, r.score) for r in J.numbers_of_texts(texts, toc, "g", "t").collect()}
    assert got == {(1, "Set up the node"): ("1.1", 2.0), (1, "set up the"): ("1.3", 0.75), (2, "SET UP the node"): ("7", 1.0)}
