"""All queries of the core over whole tables, and their SQL.

A repeated row is one record, so tables that repeat rows are made distinct first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import slugs
from ..functions import text as T
from ..operators import answers as A
from ..operators import contents as C
from ..operators import enrich as E
from ..operators import markdown as M
from ..operators import matching as J
from ..operators import navigation as N
from ..operators import pages as P
from ..sources import docx, docx_writer
from ..sources.files import Settings
from .skew import split_join

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Parts of SQL that several queries share.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_END = r"\r\n|[\n\x{b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_STRIP = rf"regexp_replace(%s, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_RSTRIP = rf"regexp_replace(%s, '[{_SPACE}]+$', '')"
_WORDS = rf"list_filter(string_split_regex(%s, '[{_SPACE}]+'), lambda x: x <> '')"
_CHAPTER = r"coalesce(try_cast(regexp_extract(path, '/(\d+)\.[^/]*$', 1) as int), 1)"
_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')"


def _lines_of(text: str) -> str:
    return rf"""lines as (
    select doc_id, source, path, i - 1 as line_no, a[i] as line, a[i + 1] as following from (
        select doc_id, source, path, case when text = '' then [] else string_split_regex(regexp_replace(text, '(?:{_END})$', ''), '{_END}') end as a from (select doc_id, source, path, {text} as text from documents where text is not null)
    ), unnest(range(1, len(a) + 1)) as t(i)
)"""


_LINES = _lines_of("text")
#: Lines put after a text, by its length, so that every validator finds something: bad captions, annotations left open or ended before they start, headings and pictures that occur again.
_TAILS = (
    "> Таблица X – a\n::AppAnnotation b\n::\n# Again\n# Again\n> Рисунок 3 – a\n> Рисунок 3 – b",
    "> Таблица 5 - a\n> Таблица 5 – a\n::AppAnnotation ::AppAnnotation\n::\n> Figure 9 – a\n> Figure 9 – a",
    "::\n::AppAnnotation\n## Again\n## Again\n> Таблица 1 – ",
)
_MADE = "text || chr(10) || case length(text) % 3 " + " ".join(f"when {i} then '{tail.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}'" for i, tail in enumerate(_TAILS)) + " end"
_NUMBERS = rf"""{_LINES}, heads as (
    select doc_id, path, line_no, case when regexp_matches(line, '^## .') then 2 when regexp_matches(line, '^### .') then 3 when regexp_matches(line, '^#### .') then 4 end as level
    from lines where regexp_matches(line, '^#{{2,4}} .')
), h2 as (select *, sum((level = 2)::int) over (partition by doc_id order by line_no) as a from heads
), h3 as (select *, sum((level = 3)::int) over (partition by doc_id, a order by line_no) as b from h2
), h4 as (select *, sum((level = 4)::int) over (partition by doc_id, a, b order by line_no) as c from h3
), numbers as (
    select doc_id, line_no, concat_ws('.', {_CHAPTER}, a, case when level >= 3 then b end, case when level = 4 then c end) as number from h4
)"""
_RENUMBERED = rf"""{_NUMBERS}, renumbered as (
    select l.doc_id, string_agg(case when n.number is null then line else regexp_extract(line, '^(#+) ', 1) || ' ' || n.number || ' ' || substr(line, length(regexp_extract(line, '^(#+) ', 1)) + 2) end, chr(10) order by l.line_no) as markdown
    from lines l left join numbers n using (doc_id, line_no) group by l.doc_id
)"""
_WARNED = rf"""{_LINES}, captions as (
    select doc_id, 2 as kind, line_no, 'Invalid table caption: ' || line as message from lines where starts_with(line, '> Таблица') and not regexp_matches(line, '^> Таблица \d+ – .')
), items as (
    select doc_id, 3 as kind, line_no, line, {_RSTRIP % 'line'} as text, coalesce(starts_with(following, '- '), false) as goes_on from lines where starts_with(line, '- ')
), lists as (
    select doc_id, kind, line_no, case when goes_on then 'List item should end with '';'': ' else 'Last list item should end with ''.'': ' end || line as message
    from items where case when goes_on then not ends_with(text, ';') else not ends_with(text, '.') end
), starts as (
    select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as n from (select doc_id, line_no, unnest(regexp_extract_all(line, '::AppAnnotation')) from lines)
), ends as (
    select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as n from lines where regexp_matches(line, '^::[{_SPACE}]*$')
), balance as (
    select doc_id, count(s.n) as n_starts, count(e.n) as n_ends, coalesce(bool_or(s.line_no > e.line_no), false) as crossed from starts s full join ends e using (doc_id, n) group by doc_id
), annotations as (
    select doc_id, 1 as kind, 0 as line_no, case when n_starts <> n_ends then 'Mismatched ::AppAnnotation blocks' else 'Incorrect ::AppAnnotation block ordering' end as message from balance where n_starts <> n_ends or crossed
)"""


_MADE_WARNED = _WARNED.replace(_LINES, _lines_of(_MADE))


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("path", r"/(\d+)\.[^/]*\z", 1)
    return _table(spark, d, "documents").withColumn("chapter", F.coalesce(F.when(number != "", number.cast("int")), F.lit(1)))


def _made(spark: SparkSession, d: str) -> DataFrame:
    """The documents, with lines at their ends that break rules."""
    tail = F.get(F.array(*(F.lit(f"\n{t}") for t in _TAILS)), F.length("text") % len(_TAILS))
    return _documents(spark, d).filter("text is not null").withColumn("text", F.concat("text", tail))


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "heading_structure").select("heading_id", "docx_id", "pos", "style", "level", "number", "title").distinct()


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with a page; what the pages say is made distinct after an operator, so pages themselves aren't shuffled for it."""
    return _table(spark, d, "chapter").select("chapter_id", "docx_id", "chapter_no", "chapter_html").filter("chapter_html is not null")


def _exploded(df: DataFrame, key: str, messages) -> DataFrame:
    return df.select(key, F.posexplode(messages).alias("ord", "message"))


# Numbering and links of whole documents.


@_query(f"with {_NUMBERS} select doc_id, line_no, number from numbers")
def heading_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = _documents(spark, d).filter("text is not null")
    found = M.headings(T.lines(F.col("text")))
    pairs = F.arrays_zip(F.transform(found, lambda h: h["at"]).alias("at"), M.heading_numbers(found, F.col("chapter")).alias("number"))
    return df.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", F.col("x.at").cast("long").alias("line_no"), F.col("x.number").alias("number"))


@_query(f"with {_RENUMBERED} select doc_id, md5(markdown) as hash, length(markdown) as n_chars from renumbered")
def renumbered_documents(spark: SparkSession, d: str) -> DataFrame:
    df = _documents(spark, d).filter("text is not null and text <> ''").select("doc_id", M.renumbered(F.col("text"), F.col("chapter")).alias("m"))
    return df.select("doc_id", F.md5("m").alias("hash"), F.length("m").cast("long").alias("n_chars"))


_IMAGES = rf"regexp_replace(%s, '!\[(.*?)\]\((.*?)\)', '![\1](/images/developer/administrator/' || {_STEM} || '/\2)', 'g')"


@_query(f"select doc_id, md5({_IMAGES % 'text'}) as hash from documents where text is not null")
def image_paths(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "documents").filter("text is not null")
    return df.select("doc_id", F.md5(M.images_under(F.col("text"), T.stem(F.col("path")))).alias("hash"))


@_query(
    f"""with {_RENUMBERED}, counted as (select doc_id, count(*) as n from (select doc_id from numbers) group by doc_id), {_WARNED.removeprefix(_LINES + ', ')},
    warned as (select doc_id, count(*) as n from (select doc_id from annotations union all select doc_id from captions union all select doc_id from lists) group by doc_id)
    select d.doc_id, md5({_IMAGES % 'r.markdown'}) as hash, coalesce(c.n, 0) as n_headings, coalesce(w.n, 0) as n_warnings, '/' || {_STEM} as link
    from documents d join renumbered r using (doc_id) left join counted c using (doc_id) left join warned w using (doc_id)"""
)
def chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every document numbered, its images moved, its warnings counted, its link; one narrow projection."""
    df = _documents(spark, d).filter("text is not null and text <> ''")
    page = df.select("doc_id", "path", M.page(F.col("text"), F.col("chapter")).alias("p"))
    done = M.images_under(F.col("p.markdown"), T.stem(F.col("path")))
    return page.select("doc_id", F.md5(done).alias("hash"), F.col("p.n_headings").cast("long").alias("n_headings"), F.col("p.n_warnings").cast("long").alias("n_warnings"), N.link_target(F.col("path")).alias("link"))


@_query(f"select doc_id, '/' || {_STEM} as link from documents")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", N.link_target(F.col("path")).alias("link"))


# Validators and rules.


@_query(f"with {_MADE_WARNED} select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as ord, message from captions")
def caption_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_made(spark, d), "doc_id", M.caption_warnings(F.col("text"))).withColumn("ord", F.col("ord").cast("long"))


@_query(f"with {_MADE_WARNED} select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as ord, message from lists")
def list_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_made(spark, d), "doc_id", M.list_warnings(F.col("text"))).withColumn("ord", F.col("ord").cast("long"))


@_query(f"with {_MADE_WARNED} select doc_id, message from annotations")
def annotation_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_made(spark, d), "doc_id", M.annotation_warnings(F.col("text"))).drop("ord")


@_query(f"with {_MADE_WARNED}, everything as (select * from annotations union all select * from captions union all select * from lists) select doc_id, row_number() over (partition by doc_id order by kind, line_no) - 1 as ord, message from everything")
def all_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_made(spark, d), "doc_id", M.warnings(F.col("text"))).withColumn("ord", F.col("ord").cast("long"))


@_query(f"with {_MADE_WARNED}, everything as (select * from annotations union all select * from captions union all select * from lists) select l.source, e.kind, count(*) as n from everything e join (select distinct doc_id, source from documents) l using (doc_id) group by 1, 2")
def warnings_by_source(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    sizes = F.map_from_arrays(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.size(M.annotation_warnings(text)), F.size(M.caption_warnings(text)), F.size(M.list_warnings(text))))
    df = _made(spark, d).select("source", F.explode(sizes).alias("kind", "n")).filter("n > 0")
    return df.groupBy("source", "kind").agg(F.sum("n").alias("n"))


@_query(f"with {_LINES}, h1 as (select doc_id, count(*) as n, min_by({_STRIP % 'substr(line, 3)'}, line_no) as title from lines where regexp_matches(line, '^# .') group by doc_id) select doc_id, coalesce(n, 0) as n, title from (select doc_id from documents where text is not null) left join h1 using (doc_id)")
def h1_rule(spark: SparkSession, d: str) -> DataFrame:
    titles = M.h1_titles(F.col("text"))
    return _table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(titles).cast("long").alias("n"), F.get(titles, F.lit(0)).alias("title"))


@_query(f"with {_lines_of(_MADE)} select doc_id, line, count(*) as n from lines where regexp_matches(line, '^#{{1,6}} .') group by all having count(*) > 1")
def repeated_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = T.lines(F.col("text"))
    df = _made(spark, d).select("doc_id", lines.alias("a"), F.explode(M.repeated_headings(F.col("text"))).alias("line"))
    return df.select("doc_id", "line", F.size(F.filter("a", lambda x: x == F.col("line"))).cast("long").alias("n"))


@_query(
    r"""with p as (select doc_id, string_split_regex(text, '\n[ \t]*\n+') as a from documents where text is not null), e as (select doc_id, a[i] as x, min(i) as i from p, unnest(range(1, len(a) + 1)) as t(i) group by doc_id, a[i])
    select doc_id, md5(string_agg(x, chr(10) || chr(10) order by i)) as hash from e group by doc_id"""
)
def unrepeated_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(M.without_repeated_paragraphs(F.col("text"))).alias("hash"))


_BAD_CAPTIONS = r"regexp_replace(text, '\n+> ([^\n ]+ \d+) – ', chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || '> \1 ' || case when length(text) % 2 = 0 then '–' else '-' end || ' ', 'g')"


@_query(
    rf"""with {_lines_of(_BAD_CAPTIONS)}, a as (select doc_id, list(line order by line_no) as a from lines group by doc_id), t as (select doc_id, line_no from lines where starts_with(line, '|') and not coalesce(starts_with(following, '|'), false))
    select doc_id, line_no from t join a using (doc_id) where not coalesce(regexp_matches(list_filter(a[line_no + 2:], lambda x: {_STRIP % 'x'} <> '')[1], '^> [0-9A-Za-z_]+ \d+ – |^> \p{{L}}+ \d+ – '), false)"""
)
def uncaptioned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose captions were moved further off, and in every second one spoilt."""
    dash = F.when(F.length("text") % 2 == 0, "–").otherwise("-")
    spoilt = F.regexp_replace(F.col("text"), F.lit(r"\n+> ([^\n ]+ \d+) – "), F.concat(F.lit("\n\n\n\n\n> $1 "), dash, F.lit(" ")))
    return _table(spark, d, "documents").withColumn("text", spoilt).select("doc_id", F.explode(M.tables_without_caption(F.col("text"))).alias("line_no")).withColumn("line_no", F.col("line_no").cast("long"))


@_query(rf"with n as (select doc_id, unnest(regexp_extract_all({_MADE}, '(?m)^> (?:Рисунок|Figure|Abbildung|Figura|Imagem) (\d+) –', 1)) as number from documents) select doc_id, number from n group by all having count(*) > 1")
def repeated_pictures(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("doc_id", F.explode(M.picture_numbers_repeated(F.col("text"))).alias("number"))


# Order of files.


_PLACED = "select doc_id, source, path, row_number() over w as ord, lag(doc_id) over w as prev_doc_id, lead(doc_id) over w as next_doc_id, lag(path) over w as prev_path, lead(path) over w as next_path from documents window w as (partition by source order by path, doc_id)"


@_query(_PLACED)
def prev_next(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbours(_table(spark, d, "documents").select("doc_id", "source", "path"), "source", ["path", "doc_id"], ["doc_id", "path"])


_FIRST_H1 = _STRIP % r"regexp_extract(text, '(?:^|\n)# ([^\n\r]+)', 1)"


@_query(
    rf"""with t as (select source, regexp_extract(path, '([^/]*)$', 1) as name, coalesce({_FIRST_H1}, '') as title from documents)
    select source, row_number() over (partition by source order by name, title) as ord, title, '/' || regexp_replace(name, '\.[^.]*$', '') as "to" from t"""
)
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    title = T.strip(F.regexp_extract("text", r"(?:\A|\n)# ([^\n\r]+)", 1))
    df = _table(spark, d, "documents").select("source", T.file_name(F.col("path")).alias("name"), F.coalesce(title, F.lit("")).alias("title"))
    return N.contents_entries(df, "source", "name", "title")


@_query(r"with s as (select source, path, doc_id, row_number() over (partition by source order by md5(path || '#42'), path, doc_id) as n from documents) select source, path, doc_id from s where n <= 2")
def sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    return A.example_sample(_table(spark, d, "documents").select("source", "path", "doc_id"), "path", 2, group="source", ties=["doc_id"])


# Tables of contents.

_H = "h as (select distinct heading_id, docx_id, pos, style, level, number, title from heading_structure)"
_ENTRY_TEXT = _STRIP % "number || ' ' || title || chr(9) || pos"
_ENTRY = rf"^(\d+(?:\.\d+)*)[{_SPACE}]+([^\t]+)(?:\t\d+)?$"


@_query(
    rf"""with {_H}, t as (select heading_id, style, {_ENTRY_TEXT} as text from h where title is not null)
    select heading_id, cast(regexp_extract(style, 'toc (\d+)', 1) as int) as level, regexp_extract(text, '{_ENTRY}', 1) as number, {_STRIP % f"regexp_extract(text, '{_ENTRY}', 2)"} as title
    from t where starts_with(style, 'toc') and regexp_matches(style, 'toc \d+') and regexp_matches(text, '{_ENTRY}')"""
)
def toc_parse(spark: SparkSession, d: str) -> DataFrame:
    df = _headings(spark, d).select("heading_id", "style", F.concat("number", F.lit(" "), "title", F.lit("\t"), F.col("pos").cast("string")).alias("text"))
    return C.parsed_contents(df).select("heading_id", "level", "number", "title")


@_query(f"with {_H} select docx_id, title, arg_max(number, pos) as number, min(pos) as first_pos from h where title is not null group by docx_id, title")
def numbering_map(spark: SparkSession, d: str) -> DataFrame:
    return C.numbering_map(_headings(spark, d), "docx_id")


@_query(f"with {_H}, m as (select docx_id, title, arg_max(number, pos) as toc_number from h where title is not null group by docx_id, title) select h.heading_id, h.title, m.toc_number from h left join m on h.docx_id = m.docx_id and h.title = m.title")
def exact_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = _headings(spark, d)
    return J.exact_numbers(df.select("heading_id", "docx_id", "title"), C.numbering_map(df, "docx_id"), ["docx_id", "title"]).select("heading_id", "title", "toc_number")


@_query(rf"with {_H} select style, level, len(string_split(number, '.')) as depth, count(*) as n from h group by all")
def heading_depths(spark: SparkSession, d: str) -> DataFrame:
    return C.heading_levels(_headings(spark, d)).withColumn("depth", F.col("depth").cast("long")).groupBy("style", "level", "depth").agg(F.count(F.lit(1)).alias("n"))


_CASE = "case when regexp_matches(text, '^\\d+\\.\\d+\\.\\d+\\.\\d+[{s}]+[А-Я]') then 4 when regexp_matches(text, '^\\d+\\.\\d+\\.\\d+[{s}]+[А-Я]') then 3 when regexp_matches(text, '^\\d+\\.\\d+[{s}]+[А-Я]') then 2 when regexp_matches(text, '^\\d+[{s}]+[А-Я][а-я]') then 1 end".replace("{s}", _SPACE)
_TEXTS = f"{_H}, texts as (select heading_id, docx_id, pos, style, level, number, {_STRIP % ('number || chr(32) || title')} as text from h where title is not null)"


def _heading_texts(spark: SparkSession, d: str) -> DataFrame:
    return C.paragraphs(_headings(spark, d).select("heading_id", "docx_id", "pos", "style", "level", "number", F.concat("number", F.lit(" "), "title").alias("text")))


@_query(rf"with {_TEXTS} select heading_id, {_CASE} as depth, regexp_extract(text, '^(\d+(?:\.\d+)*)[{_SPACE}]', 1) as number from texts where {_CASE} is not null")
def numbered_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _heading_texts(spark, d).select("heading_id", C.numbered_depth(text).alias("depth"), T.leading_number(text).alias("number")).filter("depth is not null")


@_query(rf"with {_TEXTS}, first as (select docx_id, min(pos) as p from texts where starts_with(text, '1 Общие сведения') or regexp_matches(text, '^\d+[{_SPACE}]+[А-Я]') group by docx_id), c as (select t.*, row_number() over (partition by t.docx_id order by pos) as n from texts t join first f on t.docx_id = f.docx_id and t.pos >= f.p where regexp_matches(text, '^\d+(?:\.\d+)*[{_SPACE}]+[А-Я]')) select docx_id, heading_id, pos from c where n <= 16")
def headings_after_contents(spark: SparkSession, d: str) -> DataFrame:
    """From the first content heading on, of each document the numbered ones up to the break after fifteen."""
    df = _heading_texts(spark, d)
    latched = C.from_first(df, "docx_id", "pos", C.begins_content(F.col("text"))).filter(C.numbered_russian(F.col("text")))
    return C.first_rows(latched, "docx_id", "pos", 16).select("docx_id", "heading_id", "pos")


@_query(rf"with {_TEXTS} select heading_id, left(text, 80) || case when length(text) > 80 then '...' else '' end as preview from texts where pos >= 250 and regexp_matches(text, '^\d+(?:\.\d+)*[{_SPACE}]+[А-Я]') and (contains(number, '4.1.2') or contains(text, 'Подготовка') or len(string_split(number, '.')) >= 3)")
def late_headings(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    wanted = F.col("number").contains("4.1.2") | text.contains("Подготовка") | (T.number_level(F.col("number")) >= 3)
    return _heading_texts(spark, d).filter((F.col("pos") >= 250) & C.numbered_russian(text) & wanted).select("heading_id", T.preview(text).alias("preview"))


@_query(rf"with {_TEXTS}, first as (select * from texts where starts_with(style, 'Heading') or starts_with(style, 'Заголовок')), rest as (select * from texts where contains(text, '4.1.2.1') or contains(text, '4.1.2') or contains(text, 'Подготовка')) select heading_id, text from first union all select heading_id, text from rest where not exists (select 1 from first)")
def styled_or_searched(spark: SparkSession, d: str) -> DataFrame:
    text, style = F.col("text"), F.col("style")
    found = J.primary_or_fallback(_heading_texts(spark, d), style.startswith("Heading") | style.startswith("Заголовок"), text.contains("4.1.2.1") | text.contains("4.1.2") | text.contains("Подготовка"))
    return found.select("heading_id", "text")


# Matching and search.

_MATCH = """with a as (select distinct title as l, list_distinct({lw}) as lw from heading_structure where title is not null), b as (select title_id as r, title as t, list_distinct({rw}) as rw from toc_titles),
p as (select l, r, {score} as score from a, b where len(list_intersect(lw, rw)) > 0), m as (select l, r, score, row_number() over (partition by l order by score desc, r) as n from p where {keep})
select l as title, r as title_id, score from m where n = 1"""
_LW, _RW = _WORDS % "lower(title)", _WORDS % "lower(title)"
_JACCARD = "len(list_intersect(lw, rw))::double / (len(lw) + len(rw) - len(list_intersect(lw, rw)))"


@_query(_MATCH.format(lw=_LW, rw=_RW, score=f"case when l = t then 2.0 else {_JACCARD} end", keep="score > 0.5"))
def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    return J.best_matches(_table(spark, d, "heading_structure"), "title", _table(spark, d, "toc_titles"), "title", "title_id").withColumn("score", F.col("score").cast("double"))


_START = f"({_WORDS % 'lower(%s)'})[1:3]"


@_query(_MATCH.format(lw=_LW, rw=_RW, score=f"case when lower(l) = lower(t) then 2.0 else {_JACCARD} + case when {_START % 'l'} = {_START % 't'} then 0.3 else 0 end end", keep="score > 0.6"))
def boosted_titles(spark: SparkSession, d: str) -> DataFrame:
    return J.best_matches(_table(spark, d, "heading_structure"), "title", _table(spark, d, "toc_titles"), "title", "title_id", above=0.6, boost=0.3, candidate_above=0.3)


_TERMS = ("Подготовка", "certificate", "configuración", "Docker", "журнал событий")


@_query(f"with t as (select unnest([{', '.join(repr(t) for t in _TERMS)}]) as term) select term, doc_id, strpos(lower(text), lower(term)) as at, left(text, 80) || case when length(text) > 80 then '...' else '' end as preview from documents, t where contains(lower(text), lower(term))")
def text_hits(spark: SparkSession, d: str) -> DataFrame:
    return J.text_hits(_table(spark, d, "documents"), "doc_id", "text", list(_TERMS)).withColumn("at", F.col("at").cast("long"))


@_query(f"with t as (select unnest([{', '.join(repr(t) for t in _TERMS)}]) as term), h as (select term, doc_id, row_number() over (partition by term order by doc_id) as n from documents, t where contains(lower(text), lower(term))) select term, doc_id from h where n <= 5")
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    return J.first_hits(J.text_hits(_table(spark, d, "documents"), "doc_id", "text", list(_TERMS)), 5, "doc_id").select("term", "doc_id")


# The letters once more, in the order of the alphabet, so that the SQL stands on its own.
_LETTERS = "а=a б=b в=v г=g д=d е=e ё=e ж=zh з=z и=i й=i к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=kh ц=ts ч=ch ш=sh щ=shch ъ= ы=y ь= э=e ю=iu я=ia є=ie і=i ї=i ґ=g ß=ss"
_SLUG_SQL = f"""with l as (select map_from_entries(list_transform(string_split('{_LETTERS}', ' '), lambda x: {{'k': string_split(x, '=')[1], 'v': string_split(x, '=')[2]}})) as m),
t as (select title_id, array_to_string(list_transform(string_split(lower(title), ''), lambda c: coalesce(m[c], c)), '') as t from toc_titles, l)
select title_id, regexp_replace(regexp_replace(strip_accents(t), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from t"""


@_query(_SLUG_SQL)
def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "toc_titles").select("title_id", slugs.slugify(F.col("title")).alias("slug"))


# Pages.

_BARE = r"regexp_replace(%s, '\s+', '', 'g')"


def _bare(c):
    return F.regexp_replace(c, r"\s+", "")


_MORE = "<section><h1>In</h1><p>x</p></section><h1>Last</h1>"
_PARTS = f"""p as (select distinct chapter_id, regexp_extract(chapter_html, '(?is)<h1.*$') as own from chapter where chapter_html is not null),
parts as (select chapter_id, 1 as n, own || '<section><h1>In</h1><p>x</p></section>' as html from p where own <> '' union all select chapter_id, (own <> '')::int + 1, '<h1>In</h1><p>x</p>' from p union all select chapter_id, (own <> '')::int + 2, '<h1>Last</h1>' from p)"""


@_query(f"with {_PARTS} select chapter_id, n as chapter_no, md5({_BARE % 'html'}) as hash from parts")
def h1_split(spark: SparkSession, d: str) -> DataFrame:
    """Every page with two more h1 after it, one of them inside a section."""
    df = _chapters(spark, d).withColumn("chapter_html", F.concat("chapter_html", F.lit(_MORE)))
    found = P.chapters(df, "chapter_id", "chapter_html")
    return found.select("chapter_id", "chapter_no", F.md5(_bare("html")).alias("hash")).distinct()


@_query(f"with {_PARTS} select chapter_id, n + 2 as chapter_no, md5({_BARE % 'html'}) as hash from parts where n = 2")
def fourth_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """The fourth chapter alone, of every page with two h1 before and two after it."""
    df = _chapters(spark, d).withColumn("chapter_html", F.concat(F.lit("<h1>1</h1><h1>2</h1>"), "chapter_html", F.lit(_MORE)))
    found = P.chapters(df.withColumn("chapter_html", F.regexp_replace("chapter_html", r"(?is)\A<h1>1</h1><h1>2</h1>.*?(?=<h1\b)", "<h1>1</h1><h1>2</h1>")), "chapter_id", "chapter_html", only=4)
    return found.select("chapter_id", "chapter_no", F.md5(_bare("html")).alias("hash")).distinct()


@_query(rf"with c as (select distinct chapter_id, chapter_html from chapter where chapter_html is not null) select chapter_id, md5({_BARE % ('chr(60) || ' + chr(39) + 'html><body>' + chr(39) + ' || chapter_html || ' + chr(39) + '</body></html>' + chr(39))}) as hash from c")
def contents_removed(spark: SparkSession, d: str) -> DataFrame:
    """A table of contents put before every page and entries that link put after it, all removed again."""
    toc = '<p>СОДЕРЖАНИЕ <a href="#__RefHeading___1">1 Раз</a></p><p><a href="#__RefHeading___2">2 Два</a> 7</p>'
    more = '<p>a <a href="#__RefHeading___3">b</a>, <a href="#__RefHeading___4">c</a></p><p>1.2 <a href="#__RefHeading___5">Три</a> 9</p>'
    df = _chapters(spark, d).select("chapter_id", F.concat(F.lit(toc), "chapter_html", F.lit(more)).alias("chapter_html"))
    return P.without_contents(df, "chapter_id", "chapter_html").select("chapter_id", F.md5(_bare("chapter_html")).alias("hash")).distinct()


_H2 = r"<h2>([^<]*)</h2>"


@_query(
    rf"""with c as (select distinct chapter_id, chapter_html, regexp_extract_all(chapter_html, '{_H2}', 1) as t from chapter where regexp_matches(chapter_html, '{_H2}')),
    e as (select chapter_id, unnest(range(1, len(t) + 1)) as i, t from c), s as (select chapter_id, i, '<h2>1.' || i || ' ' || t[i] || '</h2>' as x from e)
    select chapter_id, string_agg(x, '' order by i) as headings from s group by chapter_id"""
)
def anchor_fold(spark: SparkSession, d: str) -> DataFrame:
    """Headings of every page turned into anchors and folded back with numbers."""
    df = _chapters(spark, d).filter(F.col("chapter_html").rlike(_H2))
    titles = F.regexp_extract_all("chapter_html", F.lit(_H2), F.lit(1))
    toc = F.transform(titles, lambda t, i: F.struct(F.lit(2).alias("level"), F.concat(F.lit("1."), (i + 1).cast("string")).alias("number"), t.alias("title")))
    anchored = F.regexp_replace("chapter_html", _H2, '<a id="__RefHeading___1"></a><b>$1</b>')
    folded = df.select("chapter_id", C.folded(anchored, toc).alias("html"))
    headings = F.array_join(F.regexp_extract_all("html", F.lit(r"<h2>[^<]*</h2>"), F.lit(0)), "")
    return folded.select("chapter_id", headings.alias("headings")).distinct()


_HEAD, _HEAD_PARTS = r"<h[1-6]>[^<]*</h[1-6]>", r"<h([1-6])>([^<]*)</h[1-6]>"


@_query(
    rf"""with c as (select distinct chapter_id, chapter_html from chapter where chapter_html is not null),
    p as (select chapter_id, string_split_regex(chapter_html, '{_HEAD}') as a, regexp_extract_all(chapter_html, '{_HEAD_PARTS}', 1) as l, regexp_extract_all(chapter_html, '{_HEAD_PARTS}', 2) as t from c),
    e as (select chapter_id, i, a[i] || case when i <= len(t) then '<h' || l[i] || '>1.' || i || ' ' || t[i] || '</h' || l[i] || '></b>' else '' end as x from p, unnest(range(1, len(a) + 1)) as u(i))
    select chapter_id, md5(string_agg(x, '' order by i)) as hash from e group by chapter_id"""
)
def page_fold(spark: SparkSession, d: str) -> DataFrame:
    """Every page whole, its headings of all levels turned into anchors and folded back with their own levels."""
    df = _chapters(spark, d)
    part = lambda n: F.regexp_extract_all("chapter_html", F.lit(_HEAD_PARTS), F.lit(n))
    toc = F.transform(F.arrays_zip(part(1).alias("l"), part(2).alias("t")), lambda h, i: F.struct(h["l"].cast("int").alias("level"), F.concat(F.lit("1."), (i + 1).cast("string")).alias("number"), h["t"].alias("title")))
    anchored = F.regexp_replace("chapter_html", _HEAD_PARTS, '<a id="__RefHeading___1"></a><b>$2</b>')
    return df.select("chapter_id", F.md5(C.folded(anchored, toc)).alias("hash")).distinct()


_PLAIN = "replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<!--.*?-->|<[^<>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
_TEXTS_OF = rf"list_transform(regexp_extract_all(chapter_html, '(?is)<%s\b[^>]*>(.*?)</%s\s*>', 1), lambda x: {_STRIP % _PLAIN})"


@_query(
    f"""with r as (select distinct response_id, chapter_id, markdown from llm_response where status = 200 and markdown is not null), c as (select distinct chapter_id, chapter_html from chapter where chapter_html is not null),
    j as (select response_id, markdown, {_TEXTS_OF % ('h[1-6]', 'h[1-6]')} as h, list_concat({_TEXTS_OF % ('pre', 'pre')}, {_TEXTS_OF % ('code', 'code')}) as k from r join c using (chapter_id)),
    n as (select response_id, len(h) as n_headers, len(list_filter(h, lambda x: x <> '' and not contains(markdown, x))) as lost_headers, len(k) as n_code, len(list_filter(k, lambda x: length(x) > 10 and not contains(markdown, x))) as lost_code from j)
    select *, lost_headers / greatest(n_headers, 1) > 0.2 or lost_code / greatest(n_code, 1) > 0.3 as incomplete from n"""
)
def completeness(spark: SparkSession, d: str) -> DataFrame:
    responses = _table(spark, d, "llm_response").filter("status = 200 and markdown is not null").select("response_id", "chapter_id", "markdown")
    pages = _chapters(spark, d).select(F.col("chapter_id").alias("page_id"), "chapter_html")
    joined = split_join(responses, pages, "chapter_id", "page_id", "response_id")
    c = P.completeness(F.col("chapter_html"), F.col("markdown"))
    counted = joined.select("response_id", c.alias("c")).select("response_id", *(F.col(f"c.{n}").cast("long").alias(n) for n in ("n_headers", "lost_headers", "n_code", "lost_code")), F.col("c.incomplete").alias("incomplete"))
    return counted.distinct()


@_query("select distinct docx_id, chapter_no, docx_id || '/html/chapter_' || chapter_no || '.html' as path, length(chapter_html) as n_chars from chapter where chapter_html is not null")
def dry_run_files(spark: SparkSession, d: str) -> DataFrame:
    """Names and sizes of the files a dry run writes."""
    df = _chapters(spark, d).select("docx_id", "chapter_no", F.concat(F.col("docx_id").cast("string"), F.lit("/html/chapter_"), F.col("chapter_no").cast("string"), F.lit(".html")).alias("path"), F.length("chapter_html").cast("long").alias("n_chars"))
    return df.distinct()


@_query("select distinct docx_id, chapter_id from chapter where chapter_no = 4")
def fourth_chapters(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "chapter").filter("chapter_no = 4").select("docx_id", "chapter_id").distinct()


# Prompts, answers, manifests.


@_query(
    """select distinct chapter_id, md5('Answer with one JSON object of "manifest" and "markdown".' || chr(10) || chr(10) || 'CHAPTER HTML:' || chr(10) || '```html' || chr(10) || chapter_html || chr(10) || '```') as hash, 2 as n_messages from chapter where chapter_html is not null"""
)
def prompts(spark: SparkSession, d: str) -> DataFrame:
    sent = A.messages(F.col("chapter_html"), "rules", "examples")
    return _chapters(spark, d).select("chapter_id", F.md5(sent[1]["content"]).alias("hash"), F.size(sent).alias("n_messages")).distinct()


_R = "r as (select distinct response_id, markdown from llm_response where markdown is not null)"


@_query(
    rf"""with {_R}, c as (select response_id, markdown, '```json' || chr(10) || '{{"title": "x"}}' || chr(10) || '```' || chr(10) || '```markdown' || chr(10) || markdown || chr(10) || '```' as content from r),
    p as (select response_id, case when response_id % 2 = 0 then markdown else regexp_extract(content, '(?s)```markdown\s*(.*?)\s*```', 1) end as m, response_id % 2 = 0 as as_json, markdown from c)
    select response_id, case when as_json and markdown = '' then null when as_json then 'json' else 'fences' end as way, md5(case when as_json and markdown = '' then null else m end) as hash from p"""
)
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every response sent as JSON (even ids) or in fenced blocks (odd ids) and parsed again."""
    md = F.col("markdown")
    as_json = F.to_json(F.struct(F.struct(F.lit("x").alias("title")).alias("manifest"), md.alias("markdown")))
    fenced = F.concat(F.lit('```json\n{"title": "x"}\n```\n```markdown\n'), md, F.lit("\n```"))
    df = _table(spark, d, "llm_response").filter("markdown is not null").select("response_id", F.when(F.col("response_id") % 2 == 0, as_json).otherwise(fenced).alias("content"))
    a = df.select("response_id", A.parsed_answer(F.col("content")).alias("a"))
    return a.select("response_id", F.col("a.way").alias("way"), F.md5("a.markdown").alias("hash")).distinct()


@_query(
    rf"""with {_R}, c as (select response_id, markdown, sent, chr(10) || '```markdown' || chr(10) || markdown || chr(10) || '```' as content from r, (values ('json'), ('fences')) as s(sent)),
    p as (select response_id, sent, case when sent = 'fences' then regexp_extract(content, '(?s)```markdown\s*(.*?)\s*```', 1) when markdown <> '' then markdown end as m from c)
    select response_id, sent, case when m is not null then sent end as way, md5(m) as hash from p"""
)
def parsed_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Every response sent as JSON and in fenced blocks, and parsed again."""
    md = F.col("markdown")
    as_json = F.to_json(F.struct(F.struct(F.lit("x").alias("title")).alias("manifest"), md.alias("markdown")))
    fenced = F.concat(F.lit('```json\n{"title": "x"}\n```\n```markdown\n'), md, F.lit("\n```"))
    both = F.map_from_arrays(F.array(F.lit("json"), F.lit("fences")), F.array(as_json, fenced))
    df = _table(spark, d, "llm_response").filter("markdown is not null").select("response_id", F.explode(both).alias("sent", "content"))
    a = df.select("response_id", "sent", A.parsed_answer(F.col("content")).alias("a"))
    return a.select("response_id", "sent", F.col("a.way").alias("way"), F.md5("a.markdown").alias("hash")).distinct()


@_query(
    """with m as (select distinct manifest_id, chapter_number, title, filename, slug, read_prev, read_next, description, keywords from chapter_manifest),
    v as (select manifest_id, list_filter([
        case when chapter_number is null then 'chapter_number: required' end, case when title is null then 'title: required' end, case when filename is null then 'filename: required' end, case when slug is null then 'slug: required' end,
        case when chapter_number < 1 then 'chapter_number: below 1' end, case when title = '' then 'title: empty' end, case when filename = '' then 'filename: empty' end, case when slug = '' then 'slug: empty' end,
        case when read_prev is not null and read_prev."to" is null then 'readPrev.to: required' when read_prev."to" = '' then 'readPrev.to: empty' end, case when read_prev is not null and read_prev.label is null then 'readPrev.label: required' when read_prev.label = '' then 'readPrev.label: empty' end,
        case when read_next is not null and read_next."to" is null then 'readNext.to: required' when read_next."to" = '' then 'readNext.to: empty' end, case when read_next is not null and read_next.label is null then 'readNext.label: required' when read_next.label = '' then 'readNext.label: empty' end,
        case when list_contains(keywords, '') then 'keywords: empty word' end], lambda x: x is not null) as v from m)
    select manifest_id, array_to_string(v, '; ') as violations from v where len(v) > 0"""
)
def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "chapter_manifest")
    json = F.to_json(F.struct("chapter_number", "title", "filename", "slug", F.col("read_prev").alias("readPrev"), F.col("read_next").alias("readNext"), "description", "keywords"))
    v = df.select("manifest_id", A.manifest_violations(json).alias("v")).filter(F.size("v") > 0)
    return v.select("manifest_id", F.array_join("v", "; ").alias("violations")).distinct()


@_query(
    rf"""with {_R}, f as (select response_id, markdown, regexp_extract(markdown, '(?s)^---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|$)', 1) as f from r where starts_with(markdown, '---'))
    select response_id, regexp_replace(regexp_extract(f, '(?m)^title:[ \t]*([^\r\n]*?)[ \t]*\r?$', 1), '^([''"])(.*)[''"]$', '\2') as title from f where f <> ''"""
)
def front_titles(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "llm_response").filter(F.col("markdown").startswith("---"))
    return df.filter(F.coalesce(M.front_matter(F.col("markdown")), F.lit("")) != "").select("response_id", M.title(F.col("markdown")).alias("title")).distinct()


@_query(
    r"""with r as (select distinct response_id, markdown from llm_response where markdown is not null) select response_id, length(regexp_replace(markdown, '(?s)^---[ \t]*\r?\n(?:.*?\n)??---[ \t]*(?:\r?\n|$)', '')) as n_chars from r"""
)
def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Size of each answer without its front matter."""
    return _table(spark, d, "llm_response").filter("markdown is not null").select("response_id", F.length(M.body(F.col("markdown"))).cast("long").alias("n_chars")).distinct()


# DOCX files: every heading table written as files of up to a hundred places and read again.


def _docx_files(spark: SparkSession, d: str) -> DataFrame:
    """Binary rows (path, content): a file for each hundred places of a document, so that no file grows with a hot document."""
    text = F.concat_ws("", F.col("number"), F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\t"), F.col("pos").cast("string"))
    path = F.concat_ws("/", F.col("docx_id").cast("string"), (F.col("pos") / 100).cast("int").cast("string"))
    rows = _headings(spark, d).select(path.alias("path"), F.struct("pos", "style", text.alias("text")).alias("p"))
    packed = rows.groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def write(parts):
        for part in parts:
            part["content"] = [docx_writer.written([(p["style"], p["text"]) for p in ps], {"a.png": b"png"}) for ps in part["ps"]]
            yield part[["path", "content"]]

    return packed.mapInPandas(write, "path string, content binary")


@_query(
    rf"""with {_H}, t as (select docx_id || '/' || (pos // 100) as path, heading_id, pos, style, number || ' ' || coalesce(title, '') || chr(9) || pos as text from h)
    select path, row_number() over (partition by path order by pos) - 1 as pos, style, text from t"""
)
def docx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return docx.paragraphs(_docx_files(spark, d)).filter("error is null").select("path", F.col("pos").cast("long").alias("pos"), "style", "text")


@_query(f"with {_H} select docx_id || '/' || (pos // 100) as path, count(*) as n_paragraphs from h group by 1")
def docx_pages(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs in the HTML of each file."""
    return docx.pages(_docx_files(spark, d)).select("path", F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


@_query(f"with {_H} select distinct docx_id || '/' || (pos // 100) as path, 'a.png' as name, 3 as n_bytes from h")
def docx_media(spark: SparkSession, d: str) -> DataFrame:
    return docx.media(_docx_files(spark, d)).select("path", "name", F.octet_length("data").alias("n_bytes"))


# Models, look-ups, navigation.


_SENT = "'Answer with one JSON object of \"manifest\" and \"markdown\".' || chr(10) || chr(10) || 'CHAPTER HTML:' || chr(10) || '```html' || chr(10) || chapter_html || chr(10) || '```'"


@_query(f"select distinct chapter_id, 200 as status, 1 as attempts, 'n=' || length({_SENT}) as content from chapter where chapter_html is not null")
def offline_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter sent to a stand-in for a model that says how long the message is."""
    asked = _chapters(spark, d).select("chapter_id", A.payload(A.messages(F.col("chapter_html"), "rules", "examples"), "m", "mistral").alias("payload"))
    got = E.enriched(asked, "chapter_id", "payload", Settings(api_key="none"), E.offline(lambda user: f"n={len(user)}"))
    return got.select("chapter_id", "status", "attempts", "content").distinct()


@_query(
    rf"""with {_H} select heading_id, case when regexp_full_match(title, '[А-ЯЁA-Z][а-яёa-z \t\n\r\f\x{{b}}]+') and not regexp_matches(title, '[ \t\n\r\f\x{{b}}]{{2}}') then '<h' || level || '>' || number || ' ' || title || '</h' || level || '>.' else '<a id="__RefHeading___1"></a>' || title || '.' end as html
    from h where title is not null"""
)
def anchor_lookup(spark: SparkSession, d: str) -> DataFrame:
    df = _headings(spark, d).filter(F.col("title").isNotNull())
    page = F.concat(F.lit('<a id="__RefHeading___1"></a>'), "title", F.lit("."))
    toc = F.array(F.struct("level", "number", "title"))
    return df.select("heading_id", J.headings_from_anchors(page, toc).alias("html"))


_LINK = "case when {c}_path is null then '' else '{key}:' || chr(10) || '  to: ''/' || {stem} || '''' || chr(10) || '  label: ''' || {c}_doc_id || '''' || chr(10) end"
_LINK_SQL = " || ".join(_LINK.format(c=c, key=key, stem=_STEM.replace("path", f"{c}_path")) for c, key in (("prev", "readPrev"), ("next", "readNext")))


@_query(f"with p as ({_PLACED}) select doc_id, md5('---' || chr(10) || {_LINK_SQL} || '---' || chr(10) || '# x') as hash from p")
def navigation_blocks(spark: SparkSession, d: str) -> DataFrame:
    placed = N.neighbours(_table(spark, d, "documents").select("doc_id", "source", "path"), "source", ["path", "doc_id"], ["doc_id", "path"])
    label = lambda c: F.col(c).cast("string")
    return placed.select("doc_id", F.md5(M.with_navigation(F.lit("# x"), N.link_target(F.col("prev_path")), label("prev_doc_id"), N.link_target(F.col("next_path")), label("next_doc_id"))).alias("hash"))


@_query(r"select doc_id, len(regexp_extract_all(text, '::AppAnnotation')) as n_marks, len(regexp_extract_all(text, '(?m)^[ \t]*(?:```|~~~)')) as n_fences from documents where text is not null")
def mark_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_count(text, F.lit("::AppAnnotation")).cast("long").alias("n_marks"), F.regexp_count(text, F.lit(r"(?md)^[ \t]*(?:```|~~~)")).cast("long").alias("n_fences"))


@_query()
def annotation_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts of annotations, neighbours merged; told by look-ahead, which the SQL engine's patterns lack."""
    return _table(spark, d, "documents").select("doc_id", F.posexplode(M.annotation_texts(F.col("text"))).alias("ord", "text"))


def queries() -> dict[str, Query]:
    from . import catalog_files, catalog_rules  # noqa: F401  each registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
