"""Queries on files, models and the whole way of a document, and their SQL.

Files are made from the tables, written to the folder that all executors share, and read back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import enrich as E
from ..sources import docx, docx_writer, files, sinks
from . import pipeline
from .catalog import _H, _SENT, _chapters, _headings, _query, _table
from .lineage import checkpoint_folder, kept

_CH = "c as (select distinct chapter_id, chapter_html from chapter where chapter_html is not null)"
_D = "d as (select distinct docx_id, path, product, coalesce(audience, '') as audience, lang from docx_source)"
_STEM = r"regexp_replace(path, '^/in/|\.docx$', '', 'g')"


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "docx_source").select("docx_id", "path", "product", F.coalesce("audience", F.lit("")).alias("audience"), "lang").distinct()


def _written(df: DataFrame, paragraphs, media: dict[str, bytes] | None = None, ordered: tuple[int, ...] = ()) -> DataFrame:
    """(path, content): a DOCX for each row of df, of what paragraphs(row) gives."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = part.to_dict("records")
            yield pd.DataFrame({"path": part["path"], "content": [docx_writer.written(paragraphs(row), media, ordered) for row in rows]})

    return df.mapInPandas(run, "path string, content binary")


def _small(row: dict) -> list:
    """A document with as many chapters as it has names: none without an audience."""
    if not row["audience"]:
        return [("Normal", row["product"])]
    return [("Heading 1", row["product"]), ("Heading 2", row["audience"]), ("Heading 1", row["lang"]), ("Heading 2", row["audience"])]


@_query(
    rf"""with {_D}, w as (select {_STEM} || '/html/full_document.html' as path, '<html><body><p>' || product || '</p></body></html>' as html from d where audience = ''
    union all select {_STEM} || '/html/chapter_' || n || '.html', '<h1>' || case n when 1 then product else lang end || '</h1><h2>' || audience || '</h2>' from d, (values (1), (2)) as t(n) where audience <> '')
    select path, strlen(html) as n_bytes from w"""
)
def written_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as DOCX under its own path (most names occur many times) and taken through a dry run: the files that stand in the output folder."""
    from ..__main__ import dry_run

    out = _shared(spark, "dry-run")
    made = dry_run(_written(_sources(spark, d), _small), "/in", out, {}, None)
    base = sinks.file_system(out)[1]
    done = kept(made.select(F.substr("path", F.lit(len(base) + 2)).alias("path"), "n_bytes"))
    there = docx.files(spark, out, "*.html").select(F.substr(F.regexp_replace("path", r"\A\w+:/+", "/"), F.lit(len(base) + 2)).alias("path"), F.col("length").alias("n_bytes"))
    return done.join(there, ["path", "n_bytes"])


@_query(rf"with {_D} select {_STEM} || '/media/' || n as path, 3 as n_bytes from d, (values ('a.png'), ('b.svg')) as t(n)")
def written_media(spark: SparkSession, d: str) -> DataFrame:
    out = _shared(spark, "media")
    found = docx.media(_written(_sources(spark, d), _small, {"a.png": b"png", "b.svg": b"svg"}))
    made = sinks.media_files(found, "/in", out)
    return made.select(F.substr("file", F.lit(len(sinks.file_system(out)[1]) + 2)).alias("path"), "n_bytes")


@_query(r"select lpad(doc_id::varchar, 12, '0') as name, md5(text) as hash, row_number() over (order by doc_id) as ord from documents where text is not null and text <> ''")
def read_back(spark: SparkSession, d: str) -> DataFrame:
    """Every text written as a Markdown file in one of a few folders, read with its folders, and put in the order of names."""
    out = _shared(spark, "texts")
    df = _table(spark, d, "documents").filter("text is not null and text <> ''").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "text")
    kept(sinks.write_files(df.select(F.concat(F.lit("a/"), F.substr("name", F.lit(12)), F.lit("/"), "name", F.lit(".md")).alias("n"), "text"), out, "n", "text"))
    read = files.samples(spark, out).select(T.stem(F.col("path")).alias("name"), F.md5("text").alias("hash"))
    from ..operators import navigation

    return navigation.neighbours(read.withColumn("g", F.lit("")), "g", ["name"], []).select("name", "hash", "ord")


@_query(
    r"""with t as (select doc_id, '---' || chr(10) || 'title: ''Doc ' || doc_id || '''' || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '---' || chr(10) || '# x' as text from documents)
    select lpad(doc_id::varchar, 12, '0') || '.md' as name, 'Doc ' || doc_id as title, '# x' as body, row_number() over (order by doc_id) as ord from t"""
)
def markdown_folder(spark: SparkSession, d: str) -> DataFrame:
    """A flat folder of Markdown with front matter, read with titles and bodies; files in folders below don't count."""
    out = _shared(spark, "flat")
    title = F.concat(F.lit("---\ntitle: 'Doc "), F.col("doc_id").cast("string"), F.lit("'\ntags:\n  - a\n---\n# x"))
    df = _table(spark, d, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("name"), title.alias("text"))
    kept(sinks.write_files(df.unionByName(df.select(F.concat(F.lit("below/"), "name").alias("name"), "text")), out, "name", "text"))
    read = files.markdown_files(spark, out)
    from ..operators import navigation

    return navigation.neighbours(read.select("name", "title", "body").withColumn("g", F.lit("")), "g", ["name"], []).select("name", "title", "body", "ord")


@_query(f"with {_CH} select chapter_id, md5(chapter_html) as hash from c where chapter_html <> ''")
def saved_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page saved as an HTML file and read again."""
    out = _shared(spark, "pages")
    df = _chapters(spark, d).filter("chapter_html <> ''").distinct().select(F.concat(F.col("chapter_id").cast("string"), F.lit(".html")).alias("n"), "chapter_html")
    kept(sinks.write_files(df, out, "n", "chapter_html"))
    return files.html_files(spark, out).select(T.stem(F.col("path")).cast("long").alias("chapter_id"), F.md5("text").alias("hash"))


# DOCX with everything that the reader keeps. A file holds up to a hundred places of a document.


def _rich_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", F.col("docx_id").cast("string"), F.floor(F.col("pos") / 100).cast("string"))
    rows = _headings(spark, d).select(path.alias("path"), F.struct("pos", "heading_id", "style", "level", "number", F.coalesce("title", F.lit("")).alias("title")).alias("p"))
    packed = rows.groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def paragraphs(row: dict) -> list:
        P, out = docx_writer.Paragraph, []
        for p in row["ps"]:
            out += [
                P(f"heading {p['level']}", p["title"]), P("Normal", p["number"], 5), P("Normal", str(p["pos"]), 6, 1), P("Normal", p["style"], 5),
                P("Normal", "go", link=f"http://x/?a&b={p['heading_id']}"), P("Normal", p["number"], inserted=True), P("Normal", "kept", control=True), P("Normal", p["style"], nested=True),
            ]
        return out

    return _written(packed, paragraphs, ordered=(6,))


_PATH = "docx_id || '/' || (pos // 100) as path"
_ESCAPED = "replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RICH = f"""case when coalesce(title, '') = '' then '' else '<h' || level || '>' || {_ESCAPED % 'title'} || '</h' || level || '>' end || '<ul><li>' || number || '<ol><li>' || pos || '</li></ol></li><li>' || style || '</li></ul>'
    || '<p><a href="http://x/?a&amp;b=' || heading_id || '">go</a></p><p>' || number || '</p><p>kept</p><table><tr><td><table><tr><td><p>' || style || '</p></td></tr></table></td></tr></table>'"""


@_query(f"with {_H}, r as (select {_PATH}, pos, {_RICH} as x from h) select path, md5(string_agg(x, '' order by pos)) as hash from r group by path")
def docx_html(spark: SparkSession, d: str) -> DataFrame:
    """Headings, nested lists of both kinds, links, insertions, content controls and tables in tables."""
    return docx.pages(_rich_files(spark, d)).select("path", F.md5("html").alias("hash"))


@_query(f"with {_H}, r as (select {_PATH}, row_number() over (partition by docx_id, pos // 100 order by pos) - 1 as n, number, pos, style from h) select path, n * 8 + k as pos, case when k = 1 then number when k = 2 then pos::varchar else style end as text, case when k = 2 then 6 else 5 end as num_id, (k = 2)::int as ilvl from r, (values (1), (2), (3)) as t(k)")
def docx_lists(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of lists with the ids and levels of their lists."""
    return docx.paragraphs(_rich_files(spark, d)).filter("num_id is not null").select("path", F.col("pos").cast("long").alias("pos"), "text", "num_id", "ilvl")


@_query(f"with {_H} select distinct {_PATH}, 'heading ' || level as name from h")
def docx_styles(spark: SparkSession, d: str) -> DataFrame:
    return docx.heading_styles(_rich_files(spark, d)).select("path", "name")


# Models.

_NAMED = "'Answer with one JSON object"


@_query(
    f"""with {_CH} select chapter_id, provider, 'm' as model, '0.0' as temperature, case provider when 'mistral' then null else '42' end as seed, case provider when 'mistral' then '42' end as random_seed, 'json_object' as format,
    'system,user' as roles, md5({_SENT}) as hash from c, (values ('mistral'), ('openrouter')) as t(provider)"""
)
def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for every chapter to both providers."""
    sent = A.messages(F.col("chapter_html"), "rules", "examples")
    both = F.array(*(F.struct(F.lit(p).alias("provider"), A.payload(sent, "m", p).alias("p")) for p in ("mistral", "openrouter")))
    df = _chapters(spark, d).select("chapter_id", F.explode(both).alias("x")).select("chapter_id", "x.provider", "x.p")
    value = lambda path: F.get_json_object("p", path)
    roles = F.concat_ws(",", value("$.messages[0].role"), value("$.messages[1].role"))
    return df.select("chapter_id", "provider", value("$.model").alias("model"), value("$.temperature").alias("temperature"), value("$.seed").alias("seed"), value("$.random_seed").alias("random_seed"), value("$.response_format.type").alias("format"), roles.alias("roles"), F.md5(value("$.messages[1].content")).alias("hash")).distinct()


def _stubborn():
    """A transport and a sleep that share what was waited. The size of the message says what happens to it."""
    waits: list[str] = []

    def sleep(seconds: float) -> None:
        waits.append(f"{seconds:g}")

    def factory():
        seen: dict[str, int] = {}

        def post(payload: str, headers: dict[str, str]) -> tuple[int, str, str]:
            user = json.loads(payload)["messages"][-1]["content"]
            way = len(user) % 7
            seen[user] = n = seen.get(user, 0) + 1
            if n == 1:
                waits.clear()
            if way == 1 and n < 3:
                return 429, "", "slow down"
            if way == 2:
                return 503, "", "busy"
            if way == 3:
                seen.pop(user)
                return 404, "", "gone"
            if way == 4:
                seen.pop(user)
                return 200, "text/html", "<p>"
            if way == 5:
                seen[user] = n % 5
                raise OSError("refused")
            content = "part" if way == 6 and n < 2 else "whole"
            if content == "whole":
                seen.pop(user)
            return 200, "application/json", json.dumps({"choices": [{"message": {"content": f"{content} {','.join(waits)}"}}]})

        return post

    return factory, sleep


@_query(
    f"""with {_CH}, w as (select chapter_id, length({_SENT}) % 7 as way from c)
    select chapter_id, case way when 2 then 503 when 3 then 404 when 5 then null else 200 end as status, case way when 0 then 1 when 1 then 3 when 2 then 5 when 3 then 1 when 4 then 1 when 5 then 5 else 2 end as attempts,
    case way when 0 then 'whole ' when 1 then 'whole 1,2' when 6 then 'whole 1' end as content, case way when 2 then 'busy' when 3 then 'gone' when 4 then 'not JSON (text/html): <p>' when 5 then 'refused' end as error from w"""
)
def asked_again(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter sent to a stand-in that is slow, busy, gone, not JSON, refusing or incomplete at first; what was waited stands in the answers."""
    factory, sleep = _stubborn()
    asked = _chapters(spark, d).distinct().select("chapter_id", A.payload(A.messages(F.col("chapter_html"), "rules", "examples"), "m", "openrouter").alias("payload"), F.lit("").alias("s"))
    got = E.enriched(asked, "chapter_id", "payload", files.Settings(api_key="none"), factory, lambda source, content: content.startswith("whole"), "s", sleep=sleep)
    return got.select("chapter_id", "status", "attempts", "content", "error")


@_query(
    f"""with {_CH}, a as (select distinct chapter_html from c join (select distinct chapter_id from llm_response where status = 200) using (chapter_id)) select chapter_id from c where chapter_html not in (select chapter_html from a)"""
)
def unanswered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Chapters whose request isn't among those that have an answer."""
    payload = A.payload(A.messages(F.col("chapter_html"), "r", "e"), "m", "openrouter")
    asked = _chapters(spark, d).select("chapter_id", payload.alias("payload")).distinct()
    done = _table(spark, d, "llm_response").filter("status = 200").select("chapter_id").distinct()
    return E.cached_answers(asked, "payload", asked.join(done, "chapter_id").select(F.sha2("payload", 256).alias("request"))).select("chapter_id")


_CASES = {
    "default": {"OPENROUTER_API_KEY": "k"},
    "upper": {"LLM_PROVIDER": "MISTRAL", "MISTRAL_API_KEY": "k"},
    "own": {"LLM_PROVIDER": "mistral", "MISTRAL_API_KEY": "k", "MISTRAL_MODEL": "tiny", "MISTRAL_ENDPOINT": "http://here", "HTTP_REFERER": "r", "APP_TITLE": "t"},
    "no key": {},
    "unknown": {"LLM_PROVIDER": "other"},
}


@_query(
    """select * from (values
    ('default', 'openrouter', 'openai/gpt-4o-mini', 'https://openrouter.ai/api/v1/chat/completions', 'Authorization,Content-Type', null),
    ('upper', 'mistral', 'mistral-large-latest', 'https://api.mistral.ai/v1/chat/completions', 'Authorization,Content-Type', null),
    ('own', 'mistral', 'tiny', 'http://here', 'Authorization,Content-Type,HTTP-Referer,X-Title', null),
    ('no key', 'openrouter', null, null, null, 'RuntimeError'),
    ('unknown', 'other', null, null, null, 'ValueError')) as t("case", provider, model, endpoint, headers, error)"""
)
def provider_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings from environments: defaults, own values, a missing key, an unknown provider."""
    rows = []
    for case, env in _CASES.items():
        settings = files.Settings.from_environment(env)
        try:
            good = files.checked(settings)
            rows.append((case, good.provider, good.model, good.endpoint, ",".join(sorted(A.headers_of(good.api_key, good.referer, good.app_title))), None))
        except (RuntimeError, ValueError) as e:
            rows.append((case, settings.provider, None, None, None, type(e).__name__))
    return spark.createDataFrame(rows, "case string, provider string, model string, endpoint string, headers string, error string")


def _hasty():
    """A stand-in for a model whose first answer to each chapter lacks a heading and calls every chapter the first."""
    seen: dict[str, int] = {}

    def post(payload: str, headers: dict[str, str]) -> tuple[int, str, str]:
        user = json.loads(payload)["messages"][-1]["content"]
        one, two = (user.split(f"<h{n}>")[1].split(f"</h{n}>")[0] for n in (1, 2))
        seen[user] = n = seen.get(user, 0) + 1
        if n == 2:
            seen.pop(user)
        markdown = f"# {one}" if n == 1 else f"# {one}\n## {two}\n![i](p.png)\n- x"
        content = {"manifest": {"chapter_number": 1, "title": one, "filename": f"{one}.md", "slug": "s"}, "markdown": markdown}
        return 200, "application/json", json.dumps({"choices": [{"message": {"content": json.dumps(content)}}]})

    return post


_PAGE = r"""'---' || chr(10) || case when prev is null then '' else 'readPrev:' || chr(10) || '  to: ''/' || prev || '''' || chr(10) || '  label: ''' || prev || '''' || chr(10) end || case when next is null then '' else 'readNext:' || chr(10) || '  to: ''/' || next || '''' || chr(10) || '  label: ''' || next || '''' || chr(10) end || '---' || chr(10)
    || '# ' || title || chr(10) || '## ' || n || '.1 ' || audience || chr(10) || '![i](/images/developer/administrator/' || slug || '/p.png)' || chr(10) || '- x'"""
_WAY = rf"""{_D}, c as (select path, n, case n when 1 then product else lang end as title, audience, regexp_replace(regexp_extract(lower(path), '([^/]*)\.docx$', 1), '[^a-z0-9]+', '-', 'g') as slug from d, (values (1), (2)) as t(n) where audience <> ''),
    p as (select *, lag(title) over w as prev, lead(title) over w as next from c window w as (partition by path order by title || '.md', n))"""


def _converted(spark: SparkSession, d: str) -> pipeline.Result:
    found = _written(_sources(spark, d), _small)
    return pipeline.converted(found, files.Settings(model="m", api_key="k"), "rules", "examples", lambda: _hasty(), sleep=lambda seconds: None)


@_query(f"with {_WAY} select path, n as chapter_no, title || '.md' as filename, title, md5({_PAGE}) as hash from p")
def converted_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole way of every document: DOCX, chapters, an incomplete first answer that is asked again, numbers by place, images by document, links to neighbours."""
    return _converted(spark, d).markdown.select("path", "chapter_no", "filename", "title", F.md5("markdown").alias("hash"))


@_query(f"with {_WAY} select path, n as chapter_no, 200 as status, 2 as attempts from c")
def conversion_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d).asked


@_query(f"with {_WAY} select path, n as chapter_no, 0 as ord, 'Last list item should end with ''.'': - x' as message from c union all select path, null, null, 'no h1 begins a chapter' from d where audience = ''")
def conversion_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of chapters, and documents of which no chapter comes out."""
    result = _converted(spark, d)
    none = result.unconverted.select("path", F.lit(None).cast("int").alias("chapter_no"), F.lit(None).cast("int").alias("ord"), F.col("error").alias("message"))
    return result.warnings.select("path", "chapter_no", "ord", "message").unionByName(none)
