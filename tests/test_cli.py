import json

import pytest

from chaptermill.__main__ import main
from chaptermill.operators import enrich
from chaptermill.sources import docx_writer
from chaptermill.sources.files import Settings


@pytest.fixture
def documents(tmp_path):
    (tmp_path / "in").mkdir()
    body = [("Heading 1", "First"), ("Normal", "text\tone"), ("Heading 1", "Second")]
    (tmp_path / "in" / "a.docx").write_bytes(docx_writer.written(body, {"i.png": b"x"}))
    (tmp_path / "in" / "b.docx").write_bytes(docx_writer.written([("Normal", "no chapter")]))
    return tmp_path


def test_dry_run_asks_no_model(spark, documents, capsys):
    def never():
        raise AssertionError("no model in a dry run")

    assert main(["run", str(documents / "in"), "--out", str(documents / "out"), "--dry-run"], spark, never) == 0
    names = {p.relative_to(documents / "out").as_posix(): p.read_text("utf-8") for p in (documents / "out").rglob("*.html")}
    assert names == {"a/html/chapter_1.html": "<h1>First</h1><p>text\tone</p>", "a/html/chapter_2.html": "<h1>Second</h1>", "b/html/full_document.html": "<html><body><p>no chapter</p></body></html>"}
    assert capsys.readouterr().out == "3 files\n"


def test_run(spark, documents, monkeypatch):

    def answer(user):
        n = 1 if "First" in user else 2
        return json.dumps({"manifest": {"chapter_number": n, "title": f"T{n}", "filename": f"../{n}.md", "slug": "s"}, "markdown": f"# {'First' if n == 1 else 'Second'}\n## x"})

    (documents / "s").mkdir()
    (documents / "s" / "one.md").write_text("EXAMPLE", "utf-8")
    monkeypatch.setattr(Settings, "attempts", 1)
    out = documents / "out"
    assert main(["run", str(documents / "in"), "--out", str(out), "--model", "m", "--samples", str(documents / "s"), "--chapter", "2"], spark, enrich.offline(answer)) == 0
    assert (out / "a" / "2.md").read_text("utf-8") == "---\n---\n# Second\n## 2.1 x" and not (out / "a" / "1.md").exists()
    assert (out / "a" / "media" / "i.png").read_bytes() == b"x" and spark.read.parquet(str(out / "_rejected")).count() == 0


def test_navigate(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, title in (("a", "First"), ("b", "Второй"), ("c", "Third")):
        (tmp_path / "in" / f"{name}.md").write_text(f"---\ntitle: {title}\n---\n# x", "utf-8")
    assert main(["navigate", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 0
    text = (tmp_path / "out" / "b.md").read_text("utf-8")
    assert "readPrev:\n  to: '/a'\n  label: 'First'" in text and "readNext:\n  to: '/c'\n  label: 'Third'" in text
    raw = (tmp_path / "out" / "toc.json").read_text("utf-8")
    assert json.loads(raw) == [{"title": "First", "to": "/a"}, {"title": "Второй", "to": "/b"}, {"title": "Third", "to": "/c"}] and "Второй" in raw and raw.startswith('[\n  {\n    "title"')


def test_key_is_needed(spark, documents, monkeypatch):
    monkeypatch.delenv("OPENROUTER_API_KEY", raising=False)
    with pytest.raises(RuntimeError):
        main(["run", str(documents / "in"), "--out", str(documents / "out")], spark)


def test_equal_names_keep_all_documents_and_chapters(spark, tmp_path, monkeypatch):
    for folder, body in (("x", [("Heading 1", "First"), ("Heading 1", "Second")]), ("y", [("Heading 1", "First")]), ("z", [("Normal", "none")])):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "guide.docx").write_bytes(docx_writer.written(body, {"i.png": folder.encode()}))
    out = tmp_path / "out"
    assert main(["run", str(tmp_path / "in"), "--out", str(out), "--dry-run"], spark) == 0
    found = sorted(p.relative_to(out).as_posix() for p in out.rglob("*.html"))
    assert found == ["x/guide/html/chapter_1.html", "x/guide/html/chapter_2.html", "y/guide/html/chapter_1.html", "z/guide/html/full_document.html"]

    def answer(user):
        return json.dumps({"manifest": {"chapter_number": 1, "title": "T", "filename": "same.md", "slug": "s"}, "markdown": f"# {'First' if 'First' in user else 'Second'}\n## a"})

    monkeypatch.setattr(Settings, "attempts", 1)
    assert main(["run", str(tmp_path / "in"), "--out", str(out), "--model", "m"], spark, enrich.offline(answer)) == 0
    texts = {p.relative_to(out).as_posix(): p.read_text("utf-8").splitlines()[-1] for p in out.rglob("*.md")}
    assert texts == {"x/guide/same.md": "## 1.1 a", "x/guide/same~2.md": "## 2.1 a", "y/guide/same.md": "## 1.1 a"}
    assert {p.relative_to(out).as_posix(): p.read_text() for p in out.rglob("i.png")} == {f"{f}/guide/media/i.png": f for f in "xyz"}
