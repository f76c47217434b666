import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from chaptermill.operators import answers as A
from chaptermill.operators import enrich as E
from chaptermill.sources.files import Settings, checked

GOOD = {"chapter_number": 1, "title": "T", "filename": "1.t.md", "slug": "t"}


def violations(spark, manifests):
    df = spark.createDataFrame([(m if m is None or isinstance(m, str) else json.dumps(m, ensure_ascii=False),) for m in manifests], "m string")
    return [r[0] for r in df.select(A.manifest_violations(F.col("m"))).collect()]


def test_manifests(spark):
    link = {"to": "/a", "label": "b"}
    right = [GOOD, GOOD | {"readPrev": None, "readNext": link, "nextRead": link, "description": "", "keywords": ["a"]}, GOOD | {"chapter_number": 1.0, "keywords": []}]
    wrong = [
        GOOD | {"chapter_number": "1"}, GOOD | {"readPrev": {"to": "", "label": "x"}}, {"title": "x"}, GOOD | {"extra": 1, "more": 2}, GOOD | {"chapter_number": 0, "title": ""},
        GOOD | {"title": None}, GOOD | {"keywords": ["a", "", 3]}, GOOD | {"keywords": ["a", ""]}, GOOD | {"readNext": {"to": "x", "label": "y", "z": 1}}, GOOD | {"chapter_number": 1.5}, [], "no json", None,
    ]
    assert violations(spark, right) == [[], [], []]
    got = violations(spark, wrong)
    assert got[0] == ["chapter_number: not an integer"] and got[1] == ["readPrev.to: empty"]
    assert got[2] == ["chapter_number: required", "filename: required", "slug: required"] and got[3] == ["unknown extra, more"]
    assert got[4] == ["chapter_number: below 1", "title: empty"] and got[5] == ["title: not a string"]
    assert got[6] == ["keywords: not strings"] and got[7] == ["keywords: empty word"] and got[8] == ["readNext: unknown z"] and got[9] == ["chapter_number: not an integer"]
    assert got[10][0] == "not an object" and got[11][0] == "not an object" and got[12] is None


def test_parsing(spark):
    fenced = 'Sure:\n```json\n{"title": "x"}\n```\n\n```markdown\n# One\n```\n'
    rows = [json.dumps({"manifest": GOOD, "markdown": "# M"}), fenced, json.dumps({"manifest": {}, "markdown": "x"}), json.dumps({"markdown": "x"}), "plain", None, "", '{"manifest": {"a": 1}, "markdown": ""}']
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = [r[0] for r in df.select(A.parsed_answer(F.col("c"))).collect()]
    assert (got[0].way, got[0].markdown, json.loads(got[0].manifest)) == ("json", "# M", GOOD)
    assert (got[1].way, got[1].markdown, got[1].manifest) == ("fences", "# One", '{"title": "x"}')
    assert all(g.way is None and g.error for g in (got[2], got[3], got[4], got[6], got[7]))
    assert got[5].way is None and got[5].error is None


def test_prompt_and_payload(spark):
    df = spark.createDataFrame([("<h1>Ж</h1>",), (None,)], "h string")
    for provider, seed in (("mistral", "random_seed"), ("openrouter", "seed")):
        rows = df.select(A.payload(A.messages(F.col("h"), "RULES", "EX"), "m", provider).alias("p"), A.messages(F.col("h"), "RULES", "EX").alias("m")).collect()
        sent = json.loads(rows[0].p)
        assert sent[seed] == 42 and len([k for k in sent if "seed" in k]) == 1 and sent["temperature"] == 0 and sent["response_format"] == {"type": "json_object"}
        system, user = sent["messages"]
        assert "FORMATTING RULES:\nRULES" in system["content"] and "EXAMPLES:\nEX" in system["content"] and "CHAPTER HTML:\n```html\n<h1>Ж</h1>" in user["content"]
        assert rows[1].m is None


def test_sample(spark):
    df = spark.createDataFrame([(f"a/{i}", f"g{i % 3}") for i in range(30)], "path string, g string")
    one = [r.path for r in A.example_sample(df, "path").collect()]
    assert len(one) == 2 and one == [r.path for r in A.example_sample(df.repartition(5), "path").collect()]
    assert A.example_sample(df, "path", group="g").groupBy("g").count().filter("count = 2").count() == 3
    assert df.limit(0).agg(A.joined_examples(df, "path", "g")).first()[0] == ""


def answer(content):
    return 200, "application/json", json.dumps({"choices": [{"message": {"content": content}}]})


def test_retries():
    calls, waits = [], []

    def transport(payload, headers):
        calls.append(payload)
        return (429, "", "slow down") if len(calls) == 1 else answer("ok")

    assert E.asked("p", transport, {}, sleep=waits.append) == (200, 2, "ok", None) and waits == [1.0]
    waits.clear()
    assert E.asked("p", lambda p, h: (503, "", "down"), {}, sleep=waits.append) == (503, 5, None, "down") and waits == [1, 2, 4, 8]
    assert E.asked("p", lambda p, h: (422, "", "bad"), {}, sleep=waits.append)[:3] == (422, 1, None)
    status, n, content, error = E.asked("p", lambda p, h: (200, "text/html", "<html>"), {})
    assert (status, n, content) == (200, 1, None) and "text/html" in error and "<html>" in error
    waits.clear()
    assert E.asked("p", lambda p, h: answer("half"), {}, complete=lambda c: False, sleep=waits.append) == (200, 5, "half", "incomplete answer")


def test_enriched(spark):
    df = spark.createDataFrame([(1, json.dumps({"messages": [{"content": "a"}]}), "s"), (2, None, "s")], "id int, p string, s string")
    got = {r.id: (r.status, r.content, r.error) for r in E.enriched(df, "id", "p", Settings(), E.offline(str.upper)).collect()}
    assert got == {1: (200, "A", None), 2: (None, None, "no payload")}
    answered = df.select(F.sha2("p", 256).alias("request"))
    assert [r.id for r in E.cached_answers(df.filter("p is not null"), "p", answered).collect()] == []


def test_settings():
    with pytest.raises(ValueError):
        checked(Settings(provider="other", api_key="x"))
    with pytest.raises(RuntimeError):
        checked(Settings())
    s = Settings.from_environment({"LLM_PROVIDER": "Mistral", "MISTRAL_API_KEY": "key"})
    assert checked(s).model and "key" not in repr(s) and A.headers_of("k", "r", "t") == {"Authorization": "Bearer k", "Content-Type": "application/json", "HTTP-Referer": "r", "X-Title": "t"}


def test_http_transport():
    """A real endpoint: a failure that passes, headers, and a page that is no JSON."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], self.headers["HTTP-Referer"], sent["model"]))
            status, kind, body = (503, "text/plain", "busy") if len(seen) == 1 else (200, "application/json", json.dumps({"choices": [{"message": {"content": "ok"}}]})) if sent["model"] == "m" else (200, "text/html", "<p>")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        settings = Settings(endpoint=f"http://127.0.0.1:{server.server_port}/", api_key="k", referer="r")
        post, headers, waits = E.http_transport(settings)(), A.headers_of("k", "r"), []
        assert E.asked('{"model": "m"}', post, headers, sleep=waits.append) == (200, 2, "ok", None) and waits == [1.0]
        assert E.asked('{"model": "x"}', post, headers, sleep=waits.append) == (200, 1, None, "not JSON (text/html): <p>")
        assert seen == [("Bearer k", "r", "m"), ("Bearer k", "r", "m"), ("Bearer k", "r", "x")]
    finally:
        server.shutdown()
