"""DOCX files, text files, sinks, the whole way of a document, and the stream."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from chaptermill.operators import answers, enrich, pages
from chaptermill.plans import pipeline
from chaptermill.sources import docx, docx_writer, files, sinks
from chaptermill.sources.files import Settings
from chaptermill.streaming import chapters as stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style="", extra="", before=""):
    pr = f'<w:pPr><w:pStyle w:val="{style}"/>{extra}</w:pPr>' if style else f"<w:pPr>{extra}</w:pPr>" if extra else ""
    return f"<w:p>{pr}{before}<w:r><w:t>{text}</w:t></w:r></w:p>"


def make_docx(body):
    styles = [("a1", "paragraph", "toc 1"), ("a2", "paragraph", "toc 2"), ("h1", "paragraph", "Heading 1"), ("c", "character", "Heading Char")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>" + "".join(f'<w:style w:type="{k}" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, k, n in styles) + "</w:styles>")
        z.writestr("word/media/image1.png", b"\x89PNG")
    return out.getvalue()


BODY = (
    paragraph("СОДЕРЖАНИЕ") + paragraph("1 Первая\t3", "a1") + paragraph("2 Вторая\t9", "a1")
    + paragraph("Первая", before='<w:bookmarkStart w:name="__RefHeading___1"/>') + paragraph("Text &lt;one&gt;", extra='<w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr>')
    + paragraph("Вторая", before='<w:bookmarkStart w:name="__RefHeading___2"/>') + paragraph("More")
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(make_docx(BODY))
    (tmp_path / "in" / "broken.docx").write_bytes(b"no zip")
    return tmp_path


def test_docx(spark, folder):
    df = docx.files(spark, str(folder / "in"))
    rows = docx.paragraphs(df).orderBy("path", "pos").collect()
    good = [r for r in rows if r.error is None]
    assert [r.text for r in good] == ["СОДЕРЖАНИЕ", "1 Первая\t3", "2 Вторая\t9", "Первая", "Text <one>", "Вторая", "More"]
    assert good[1].style == "toc 1" and (good[4].num_id, good[4].ilvl) == (5, 1) and good[0].num_id is None
    assert len(rows) == 8 and [r for r in rows if r.error][0].path.endswith("broken.docx")
    assert [(r.style_id, r.name) for r in docx.heading_styles(df).collect()] == [("h1", "Heading 1")]
    assert [(r.name, bytes(r.data)) for r in docx.media(df).collect()] == [("image1.png", b"\x89PNG")]
    page = docx.pages(df).filter("html is not null").first().html
    assert '<p><a id="__RefHeading___1"></a>Первая</p><ul><li>Text &lt;one&gt;</li></ul>' in page
    assert docx.style_map_of("p[style-name='Big'] => h2:fresh\n# x") == {"big": "h2"}


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "10.b.md").write_text("---\ntitle: Ten\n---\n# x", "utf-8")
    (tmp_path / "2.a.md").write_text("# plain", "utf-8")
    (tmp_path / "sub" / "c.md").write_text("deep", "utf-8")
    (tmp_path / "d.html").write_text("<h1>x</h1>", "utf-8")
    assert [(r.name, r.title) for r in files.markdown_files(spark, str(tmp_path)).collect()] == [("10.b.md", "Ten"), ("2.a.md", "")]
    assert files.samples(spark, str(tmp_path)).count() == 3 and files.html_files(spark, str(tmp_path)).first().text == "<h1>x</h1>"


def test_sinks(spark, tmp_path):
    names = [("../../etc/x.md",), ("a\\b.md",), ("..",), (None,), (" ",), ("ok.md",)]
    got = [r[0] for r in spark.createDataFrame(names, "n string").select(sinks.safe_name(F.col("n"))).collect()]
    assert got == ["x.md", "b.md", "unnamed", "unnamed", "unnamed", "ok.md"]
    df = spark.createDataFrame([("d", 1, "<h1>Ж</h1>"), ("d", 2, None)], "doc string, n int, html string")
    written = {os.path.relpath(r.path, tmp_path): r.n_bytes for r in sinks.chapter_files(df, str(tmp_path), "doc", "n", "html").collect()}
    assert written == {"d/html/chapter_1.html": 11, "d/html/chapter_2.html": 0} and (tmp_path / "d/html/chapter_1.html").read_text("utf-8") == "<h1>Ж</h1>"
    with pytest.raises(Exception, match="leaves the folder"):
        sinks.write_files(spark.createDataFrame([("../x", "y")], "n string, c string"), str(tmp_path / "d"), "n", "c").collect()
    toc = spark.createDataFrame([("g", "b.md", "Два"), ("g", "a.md", "Раз")], "g string, name string, title string")
    sinks.contents_lines(toc, str(tmp_path / "toc"), "g", "name", "title")
    lines = [json.loads(x) for p in sorted((tmp_path / "toc" / "g=g").glob("*.json")) for x in p.read_text("utf-8").splitlines()]
    assert [(x["ord"], x["title"], x["to"]) for x in lines] == [(1, "Раз", "/a"), (2, "Два", "/b")]


def test_names_stay_apart(spark, tmp_path):
    long = "Ж" * 200
    names = [f"{long}a.md", f"{long}b.md", "a:b.md", "a_b.md", "plain.md", "a~b.md"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    safe = [r[0] for r in df.select(sinks.safe_name(F.col("n"))).collect()]
    assert len(set(safe[:2])) == 2 and all(len(n.encode()) <= 255 and n.endswith(".md") for n in safe)
    own = [r[0] for r in df.select(sinks.own_name(F.col("n"))).collect()]
    assert len(set(own)) == len(names) and own[3:5] == names[3:5]
    again = sinks.distinct_names(spark.createDataFrame([("g", "A.md", 1), ("g", "a.md", 2), ("g", "b", 3), ("g", "b", 4), ("h", "a.md", 5)], "g string, n string, i int"), ["g"], "n", ["i"])
    assert {r.i: r.n for r in again.collect()} == {1: "A.md", 2: "a~2.md", 3: "b", 4: "b~2", 5: "a.md"}
    paths = spark.createDataFrame([("file:/in/x/a.b.docx",), ("file:///in/c.docx",), ("s3a://in/d/e.docx",)], "p string")
    assert [r[0] for r in paths.select(sinks.document_folder(F.col("p"), "/in")).collect()] == ["x/a.b", "c", "in/d/e"]
    sinks.write_files(df.filter("n = 'plain.md'"), f"file://{tmp_path}/o", "n", "n").count()
    assert (tmp_path / "o" / "plain.md").read_text("utf-8") == "plain.md"


def test_docx_content(spark):
    P = docx_writer.Paragraph
    body = [P("Heading 1", "T"), P("Normal", "one", 5), P("Normal", "two", 5, 1), P("Normal", "three", 6, 1), P("Normal", "four", 5), P("Normal", "out", link="http://x/?a&b"), P("Normal", "in", inserted=True), P("Normal", "kept", control=True), P("Normal", "cell", nested=True)]
    raw = docx_writer.written(body, ordered=(6,))
    want = (
        "<h1>T</h1><ul><li>one<ul><li>two</li></ul><ol><li>three</li></ol></li><li>four</li></ul>"
        '<p><a href="http://x/?a&amp;b">out</a></p><p>in</p><p>kept</p><table><tr><td><table><tr><td><p>cell</p></td></tr></table></td></tr></table>'
    )
    assert docx.to_html(raw) == want
    assert [r[2] for r in docx.parsed(raw)] == [p.text for p in body] and [r[3:] for r in docx.parsed(raw)][1:5] == [(5, 0), (5, 1), (6, 1), (5, 0)]
    both = docx.documents(spark.createDataFrame([("a", bytearray(docx_writer.written([("toc 1", "1 One\t2"), *body]))), ("b", bytearray(b"x")), ("c", None)], "path string, content binary"))
    rows = {r.path: r for r in both.collect()}
    assert rows["a"].html == "<p>1 One\t2</p>" + docx.to_html(docx_writer.written(body)) and [tuple(c) for c in rows["a"].contents] == [(0, "toc 1", "1 One\t2")]
    assert rows["b"].html is None and rows["b"].error and rows["c"].error


def test_whole_way(spark, folder):
    chapters = pipeline.document_chapters(docx.files(spark, str(folder / "in"))).orderBy("chapter_no").collect()
    assert [(c.chapter_no, c.html) for c in chapters] == [(1, "<h1>1 Первая</h1><ul><li>Text &lt;one&gt;</li></ul>"), (2, "<h1>2 Вторая</h1><p>More</p>")]

    def model(user):
        n = 1 if "Первая" in user else 2
        if n == 2 and "broken" in user:
            return "nothing"
        manifest = {"chapter_number": n, "title": f"T{n}", "filename": f"{n}.t.md", "slug": "s"}
        return json.dumps({"manifest": manifest, "markdown": f"# {n} {'Первая' if n == 1 else 'Вторая'}\n## a\n- x\n![i](p.png)"}, ensure_ascii=False)

    result = pipeline.converted(docx.files(spark, str(folder / "in")), Settings(model="m", api_key="k"), "R", "E", enrich.offline(model))
    rows = result.markdown.orderBy("chapter_no").collect()
    assert [r.filename for r in rows] == ["1.t.md", "2.t.md"]
    assert "## 1.1 a" in rows[0].markdown and "/images/developer/administrator/a/p.png" in rows[0].markdown and "readNext:\n  to: '/2.t'\n  label: 'T2'" in rows[0].markdown
    assert "readPrev" not in rows[0].markdown and "readNext" not in rows[1].markdown
    assert result.warnings.count() == 2 and result.rejected.count() == 0


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "## a", 4), (2, None, 1), (3, "- x", 1)], "id int, md string, n int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = stream.markdown_stream(spark, str(tmp_path / "in"), df.schema, files_at_once=1)
    query = stream.written(stream.checked(read, "id", "md", "n"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {r.id: (r.markdown, r.warnings) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: (r.markdown, r.warnings) for r in stream.checked(df, "id", "md", "n").collect()} and got[1][0] == "## 4.1 a"


def test_incomplete_answers_are_asked_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = [("Heading 1", "First"), ("Heading 2", "Inner"), ("Heading 1", "Second"), ("Heading 2", "Deep")]
    (tmp_path / "in" / "a.docx").write_bytes(docx_writer.written(body))

    def factory():
        seen = {}

        def post(payload, headers):
            n = 1 if "First" in json.loads(payload)["messages"][-1]["content"] else 2
            seen[n] = seen.get(n, 0) + 1
            whole = n == 1 and seen[n] == 2
            markdown = "# First\n## Inner" if whole else f"# {'First' if n == 1 else 'Second'}"
            manifest = {"chapter_number": n, "title": f"T{n}", "filename": f"{n}.t.md", "slug": "s"}
            return 200, "application/json", json.dumps({"choices": [{"message": {"content": json.dumps({"manifest": manifest, "markdown": markdown})}}]})

        return post

    result = pipeline.converted(docx.files(spark, str(tmp_path / "in")), Settings(model="m", api_key="k", attempts=2), "R", "E", factory)
    rows = {r.chapter_no: r.markdown for r in result.markdown.collect()}
    assert "## 1.1 Inner" in rows[1] and "Deep" not in rows[2] and result.rejected.count() == 0
    assert [tuple(r)[1:] for r in result.warnings.collect()] == [(2, 0, "Incomplete answer: 1 of 2 headings and 0 of 0 pieces of code are missing")]


def test_completeness_of_rows_is_that_of_columns(spark):
    page = "<h1>One &amp; two</h1><h2> </h2><H3 id='x'>Three</H3><pre><code>print('hello')&lt;</code></pre><code>short</code>"
    texts = ["# One & two\n## Three\nprint('hello')<", "# One & two", "Three print('hello')<", "", "# One & two\nThree"]
    for html in (page, "", "<p>x</p>", "<h1>a</h1>\xa0<h2>\x85b</h2>"):
        df = spark.createDataFrame([(html, t) for t in texts], "h string, m string")
        got = [(r.m, r.c) for r in df.select("m", pages.completeness(F.col("h"), F.col("m"))["incomplete"].alias("c")).collect()]
        assert got == [(t, not pages.complete(html, t)) for t in texts]
    contents = [json.dumps({"manifest": {"a": 1}, "markdown": "x"}), json.dumps({"manifest": {}, "markdown": "x"}), json.dumps({"manifest": {"a": 1}, "markdown": ""}), "plain", "[]", "", None]
    df = spark.createDataFrame([(c,) for c in contents], "c string")
    assert [r.m for r in df.select(answers.parsed_answer(F.col("c"))["markdown"].alias("m")).collect()] == [answers.json_markdown(c) for c in contents]


def test_documents_with_nested_or_no_chapters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    numbered = paragraph("Первая", extra='<w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr>', before='<w:bookmarkStart w:name="__RefHeading___1"/>')
    (tmp_path / "in" / "list.docx").write_bytes(make_docx(paragraph("1 Первая\t3", "a1") + numbered))
    (tmp_path / "in" / "plain.docx").write_bytes(make_docx(paragraph("no heading")))
    found = docx.files(spark, str(tmp_path / "in"))
    assert [(c.path.rpartition("/")[2], c.chapter_no, c.html) for c in pipeline.document_chapters(found).collect()] == [("list.docx", 1, "<h1>1 Первая</h1>")]
    assert [(r.path.rpartition("/")[2], r.error) for r in pipeline.unconverted(found).collect()] == [("plain.docx", "no h1 begins a chapter")]


def test_large_parts_are_read_as_a_stream(monkeypatch):
    table = f"<w:tbl><w:tr><w:tc>{paragraph('cell')}</w:tc></w:tr></w:tbl>"
    content = make_docx(BODY + table + paragraph("Head", "h1"))
    want = (docx.parsed(content), docx.to_html(content))
    monkeypatch.setattr(docx, "PART_BYTES", 10)
    assert (docx.parsed(content), docx.to_html(content)) == want and "<h1>Head</h1>" in want[1] and len(want[0]) == 9
    monkeypatch.setattr(docx, "PIECE_BYTES", 3)
    assert list(docx.media_of(content)) == [("image1.png", 0, b"\x89PN", None), ("image1.png", 3, b"G", None)]


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = docx_writer.written([("Heading 1", "First")], {"bad.png": b"BADBYTES" * 9, "good.png": b"x"})
    at = raw.index(b"word/media/bad.png") + len(b"word/media/bad.png")
    (tmp_path / "in" / "a.docx").write_bytes(raw[:at] + b"\xff\xff" + raw[at + 2 :])
    (tmp_path / "in" / "broken.docx").write_bytes(b"no zip")
    found = docx.files(spark, str(tmp_path / "in"))
    model = enrich.offline(lambda user: json.dumps({"manifest": {"chapter_number": 1, "title": "T", "filename": "1.md", "slug": "s"}, "markdown": "# First"}))
    result = pipeline.converted(found, Settings(model="m", api_key="k"), "R", "E", model)
    assert [(r.path.rpartition("/")[2], r.error) for r in result.unconverted.collect()] == [("broken.docx", "File is not a zip file")]
    rows = docx.media(found).collect()
    assert [(r.name, r.at, r.data and bytes(r.data)) for r in rows] == [("bad.png", 0, None), ("good.png", 0, b"x")] and rows[0].error.startswith("bad.png: ")


def test_pieces_become_files(spark, tmp_path):
    rows = [("d", "m/a", 0, b"ab", None), ("d", "m/a", 2, b"c", None), ("d", "m/b", 0, b"xy", None), ("d", "m/b", 2, None, "b: torn"), ("d", "m/c", 0, b"", None), ("d", "m/d", 0, None, "d: no")]
    df = spark.createDataFrame(rows, "path string, name string, at long, data binary, error string").coalesce(1)
    got = {os.path.relpath(r.file, tmp_path): (r.path, r.n_bytes, r.error) for r in sinks.write_pieces(df, str(tmp_path), "path", "name").collect()}
    assert got == {"m/a": ("d", 3, None), "m/b": ("d", None, "b: torn"), "m/c": ("d", 0, None), "m/d": ("d", None, "d: no")}
    assert {p.name: p.read_bytes() for p in (tmp_path / "m").iterdir()} == {"a": b"abc", "c": b""}
