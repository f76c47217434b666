"""Queries on rules of style, numbers and look-ups, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contents as C
from ..operators import markdown as M
from ..operators import matching as J
from ..operators import pages as P
from ..operators import rules as R
from .catalog import _CHAPTER, _H, _LINES, _SPACE, _STRIP, _TEXTS_OF, _chapters, _documents, _headings, _lines_of, _query, _table
from .skew import split_join

_CH = "c as (select distinct chapter_id, chapter_html from chapter where chapter_html is not null)"
_PLAIN = "replace(replace(replace(replace(replace(replace(regexp_replace(%s, '(?s)<!--.*?-->|<[^<>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
_RST = rf"regexp_replace(%s, '[{_SPACE}]+$', '')"


def _listed(name: str, pattern: str, shown: str, groups: int = 1) -> str:
    """SQL of one row for each match in a page: its number from 0 and what is shown of its groups g1, g2 …"""
    columns = ", ".join(f"regexp_extract_all(chapter_html, '{pattern}', {i}) as a{i}" for i in range(1, groups + 1))
    named = ", ".join(f"a{i}[i] as g{i}" for i in range(1, groups + 1))
    return f"with {_CH}, m as (select chapter_id, {columns} from c), e as (select chapter_id, i - 1 as ord, {named} from m, unnest(range(1, len(a1) + 1)) as t(i)) select chapter_id, ord, md5({shown}) as {name} from e"


def _exploded(df: DataFrame, key: str, values, name: str) -> DataFrame:
    return df.select(key, F.posexplode(values).alias("ord", name)).select(key, F.col("ord").cast("long").alias("ord"), F.md5(name).alias(name)).distinct()


_FILE = "case when coalesce(g2, '') = '' then '' else ' ' || g2 || case g1 when 'yaml' then '.yaml' when 'conf' then '.conf' when 'json' then '.json' when 'bash' then '.sh' else '' end end"


@_query(_listed("fence", r'(?s)<pre[^<>]*><code class="language-(\w+)(?: filename-([^"\s]+))?"[^<>]*>(.*?)</code></pre>', f"'```' || case g1 when 'terminal' then 'bash Terminal' else g1 end || {_FILE} || chr(10) || {_RST % (_PLAIN % 'g3')} || chr(10) || '```'", 3))
def code_fences(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_chapters(spark, d), "chapter_id", R.code_fences(F.col("chapter_html")), "fence")


#: The same samples with a file's name and as terminal commands: bash becomes terminal, others get a name.
_NAMED = ("language-bash\"", "language-terminal\"", 'class="language-(yaml|conf)"', 'class="language-$1 filename-main"')


@_query(_listed("fence", r'(?s)<pre[^<>]*><code class="language-(\w+)"[^<>]*>(.*?)</code></pre>', f"'```' || case g1 when 'bash' then 'bash Terminal' when 'terminal' then 'bash Terminal' when 'yaml' then 'yaml main.yaml' when 'conf' then 'conf main.conf' else g1 end || chr(10) || {_RST % (_PLAIN % 'g2')} || chr(10) || '```'", 2))
def named_code_fences(spark: SparkSession, d: str) -> DataFrame:
    """Code samples after their classes were given file names and a terminal."""
    html = F.regexp_replace(F.replace("chapter_html", F.lit(_NAMED[0]), F.lit(_NAMED[1])), _NAMED[2], _NAMED[3])
    return _exploded(_chapters(spark, d), "chapter_id", R.code_fences(html), "fence")


@_query(_listed("block", '(?s)<div class="app-annotation">(.*?)</div>', f"'::AppAnnotation' || chr(10) || {_STRIP % (_PLAIN % 'g1')} || chr(10) || '::'"))
def page_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_chapters(spark, d), "chapter_id", R.annotations(F.col("chapter_html")), "block")


@_query(_listed("caption", '(?s)<div class="image-caption">(.*?)</div>', _STRIP % (_PLAIN % "g1")))
def page_captions(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_chapters(spark, d), "chapter_id", R.captions(F.col("chapter_html")), "caption")


@_query(
    rf"""with {_CH}, u as (select chapter_id, array_to_string(regexp_extract_all(chapter_html, '(?s)<ul>(.*?)</ul>', 1), '') as x from c), m as (select chapter_id, regexp_extract_all(x, '(?s)<li[^<>]*>(.*?)</li>', 1) as a from u)
    select chapter_id, i - 1 as ord, md5('- ' || regexp_replace({_STRIP % (_PLAIN % 'a[i]')}, '[;.]$', '') || ';') as item from m, unnest(range(1, len(a) + 1)) as t(i)"""
)
def component_lists(spark: SparkSession, d: str) -> DataFrame:
    """Items of plain lists, taken as lists of components."""
    return _exploded(_chapters(spark, d), "chapter_id", R.component_lists(F.replace("chapter_html", F.lit("<ul>"), F.lit('<ul class="component-list">'))), "item")


_QUOTED = "'''' || replace(coalesce(%s, ''), '''', '''''') || ''''"
_READ = " || ".join(f"""case when {c} is null then '' else '{key}:' || chr(10) || '  to: ' || {_QUOTED % f'{c}."to"'} || chr(10) || '  label: ' || {_QUOTED % f'{c}.label'} || chr(10) end""" for key, c in (("readPrev", "read_prev"), ("readNext", "read_next")))


@_query(f"select distinct manifest_id, md5('---' || chr(10) || 'title: ' || {_QUOTED % 'title'} || chr(10) || {_READ} || '---' || chr(10)) as hash from chapter_manifest")
def manifest_front_matter(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "chapter_manifest")
    return df.select("manifest_id", F.md5(R.front_matter(F.col("title"), readPrev=F.col("read_prev"), readNext=F.col("read_next"))).alias("hash")).distinct()


# Numbers are put before every second heading line, by the length of the text.
_SOME = rf"case when length(line) % 2 = 0 and regexp_matches(line, '^#{{1,3}} .') then regexp_replace(line, '^(#+) ', '\1 ' || {_CHAPTER} || '.2 ') else line end"


@_query(
    rf"""with {_LINES}, n as (select doc_id, line_no, {_SOME} as line from lines)
    select doc_id, line_no, line from n where regexp_matches(line, '^#{{2,4}} .') and not regexp_matches(line, '^(?:## \d+\.\d+ |### \d+\.\d+\.\d+ |#### \d+\.\d+\.\d+\.\d+ )[^ ]') or regexp_matches(line, '^# \d+(?:\.\d+)* ')"""
)
def misnumbered_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings with wrong numbers, after some were given numbers of two parts."""
    put = lambda x: F.when((F.length(x) % 2 == 0) & x.rlike(r"\A#{1,3} ."), F.regexp_replace(x, F.lit(r"\A(#+) "), F.concat(F.lit("$1 "), F.col("chapter").cast("string"), F.lit(".2 ")))).otherwise(x)
    numbered = F.array_join(F.transform(T.lines(F.col("text")), put), "\n")
    df = _documents(spark, d).select("doc_id", F.explode(R.misnumbered_headings(numbered)).alias("x"))
    return df.select("doc_id", F.col("x.line_no").cast("long").alias("line_no"), F.col("x.line").alias("line"))


@_query(
    rf"""with p as (select doc_id, string_split_regex(replace(text, chr(10) || '- ', chr(10) || chr(10)), '\n[ \t]*\n+') as a from documents where text is not null),
    e as (select doc_id, i, a[i] as x, not regexp_matches(a[i], '^(?:[-#|>!:`<]|\d+[.)] )') and not contains(a[i], chr(10)) as plain from p, unnest(range(1, len(a) + 1)) as t(i)),
    o as (select *, plain and ends_with({_RST % 'x'}, ';') as opens from e), b as (select *, coalesce(lag(opens) over (partition by doc_id order by i), false) as before from o),
    m as (select doc_id, i, case when i = 1 then '' when (opens or before and plain) and before then chr(10) else chr(10) || chr(10) end || case when opens or before and plain then '- ' || x else x end as x, opens or before and plain as item from b)
    select doc_id, md5(string_agg(x, '' order by i)) as hash, sum(item::int) as n_items from m group by doc_id"""
)
def listed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lists whose items were made paragraphs become lists again."""
    text = F.replace("text", F.lit("\n- "), F.lit("\n\n"))
    done = _table(spark, d, "documents").filter("text is not null").select("doc_id", text.alias("t"), R.listed_paragraphs(text).alias("m"))
    marks = lambda c: F.regexp_count(c, F.lit(r"(?:\A|(?<=\n))- "))
    return done.select("doc_id", F.md5("m").alias("hash"), (marks(F.col("m")) - marks(F.col("t"))).cast("long").alias("n_items"))


_ITEMS = r"regexp_replace(text, '(?m)^- ([^\s`]+) ', '- `\1` — ', 'g')"


@_query(
    rf"""with {_LINES.replace("'(?:", "'(?:").replace("regexp_replace(text,", f"regexp_replace({_ITEMS},")}
    select doc_id, line_no, regexp_matches(line, '^- `[^`]+` — (?:.|\n)*[^\s;.][;.]\s*$') as "right" from lines where starts_with(line, '- `')"""
)
def component_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of lists whose first word was made the name of a component."""
    made = F.regexp_replace("text", r"(?md)^- ([^\s`]+) ", "- `$1` — ")
    df = _table(spark, d, "documents").select("doc_id", F.explode(R.component_items(made)).alias("x"))
    return df.select("doc_id", F.col("x.line_no").cast("long").alias("line_no"), F.col("x.right").alias("right"))


_BROKEN = r"regexp_replace(text, '(?m)^\| ([^|\n-]+) \|', '| \1<br>x<br/>y |', 'g')"


@_query(
    rf"""with {_lines_of(_BROKEN)}, s as (select doc_id, line_no, following, list_transform(string_split(regexp_replace(line, '^\||\|\s*$', '', 'g'), '|'), lambda x: trim(x)) as a from lines where regexp_matches(line, '^\|(?:\s*:?-+:?\s*\|)+\s*$'))
    select doc_id, line_no, array_to_string(list_transform(a, lambda x: case when starts_with(x, ':') and ends_with(x, ':') then 'c' when starts_with(x, ':') then 'l' when ends_with(x, ':') then 'r' else '-' end), '') as columns,
    coalesce(len(regexp_extract_all(following, '(?i)<br\s*/?>')), 0) as breaks from s"""
)
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose first cells were given line breaks."""
    broken = F.regexp_replace("text", r"(?md)^\| ([^|\n-]+) \|", "| $1<br>x<br/>y |")
    df = _table(spark, d, "documents").select("doc_id", F.explode(R.table_columns(broken)).alias("x"))
    return df.select("doc_id", F.col("x.line_no").cast("long").alias("line_no"), F.col("x.columns").alias("columns"), F.col("x.breaks").cast("long").alias("breaks"))


_NOTES = "Примечание|Примітка|Note|Hinweis|Nota"


@_query(rf"with {_LINES} select doc_id, line_no, line from lines where regexp_matches(line, '^(?:> ?)?[_*]*(?:{_NOTES})[_*]*(?:[:.]| ?[–—-] )') and not regexp_matches(line, '^> _(?:{_NOTES})_ – [^ ]')")
def bare_notes(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "documents").select("doc_id", F.explode(R.bare_notes(F.col("text"))).alias("x"))
    return df.select("doc_id", F.col("x.line_no").cast("long").alias("line_no"), F.col("x.line").alias("line"))


@_query(
    r"""with n as (select doc_id, replace(text, '![', case when length(text) % 2 = 0 then '![Рисунок 7 – ' else '![' end) as text from documents where text is not null),
    m as (select doc_id, regexp_extract_all(text, '(?m)^!\[([^\]\n]*)\]\(([^)\s]+)\)[ \t]*$', 1) as s, regexp_extract_all(text, '(?m)^!\[([^\]\n]*)\]\(([^)\s]+)\)[ \t]*$', 2) as p from n)
    select doc_id, i - 1 as ord, p[i] as src, s[i] as sign, nullif(regexp_extract(s[i], '^(?:Рисунок|Figure|Abbildung|Figura|Imagem) (\d+) – ', 1), '') as number from m, unnest(range(1, len(s) + 1)) as t(i)"""
)
def sign_images(spark: SparkSession, d: str) -> DataFrame:
    """Images, some numbered in their signs, put into blocks, which are read again."""
    numbered = F.replace("text", F.lit("!["), F.when(F.length("text") % 2 == 0, "![Рисунок 7 – ").otherwise("!["))
    df = _table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(R.sign_images(R.image_blocks(F.regexp_replace(numbered, r"\r\n?", "\n")))).alias("ord", "x"))
    return df.select("doc_id", F.col("ord").cast("long").alias("ord"), "x.src", "x.sign", "x.number")


@_query(
    rf"""with {_CH}, t as (select chapter_id, regexp_replace(chapter_html, '(?s)(<table\b.*?</table>)', '<div class="joplin-table-wrapper">' || chr(10) || '\1' || chr(10) || '</div>', 'g') as once, len(regexp_extract_all(chapter_html, '<table\b')) as n from c)
    select chapter_id, md5(once) as once, md5(once) as twice, n from t where n > 0"""
)
def wrapped_tables(spark: SparkSession, d: str) -> DataFrame:
    """HTML tables of pages in their wrappers; a second time changes nothing."""
    once = R.wrapped_tables(F.col("chapter_html"))
    df = _chapters(spark, d).select("chapter_id", once.alias("once"), F.regexp_count("chapter_html", F.lit(r"<table\b")).cast("long").alias("n")).filter("n > 0")
    return df.select("chapter_id", F.md5("once").alias("once"), F.md5(R.wrapped_tables(F.col("once"))).alias("twice"), "n").distinct()


@_query(r"with a as (select doc_id, regexp_extract_all(replace(text, '![', '['), '(?:^|[^!])\[[^\]\n]*\]\(([^)\s]+)', 1) as a from documents where text is not null) select doc_id, i - 1 as ord, a[i] as target from a, unnest(range(1, len(a) + 1)) as t(i)")
def link_list(spark: SparkSession, d: str) -> DataFrame:
    """Targets of links, images being made links."""
    df = _table(spark, d, "documents").select("doc_id", F.posexplode(M.links(F.replace("text", F.lit("!["), F.lit("[")))).alias("ord", "target"))
    return df.withColumn("ord", F.col("ord").cast("long"))


@_query(rf"with {_LINES} select doc_id, line_no, regexp_replace(regexp_replace(lower({_STRIP % r'''regexp_replace(line, '^#+ ', '')'''}), '[^\p{{L}}\p{{N}}\s_-]', '', 'g'), '\s', '-', 'g') as anchor from lines where regexp_matches(line, '^#{{1,6}} .')")
def heading_anchors(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    at = F.filter(F.transform(T.lines(text), lambda x, i: F.when(x.rlike(r"\A#{1,6} ."), i)), lambda i: i.isNotNull())
    df = _table(spark, d, "documents").select("doc_id", F.explode(F.arrays_zip(at.alias("at"), M.anchors_of_headings(text).alias("anchor"))).alias("x"))
    return df.select("doc_id", F.col("x.at").cast("long").alias("line_no"), F.col("x.anchor").alias("anchor"))


# Annotations, neighbours merged: a second block is put right after each.
_DOUBLE = r"regexp_replace(text, '(?m)^(::AppAnnotation[^\n]*\n)([^\n]+)\n::[ \t]*$', '\1\2' || chr(10) || '::' || chr(10) || chr(10) || '::AppAnnotation' || chr(10) || 'And \2' || chr(10) || '::', 'g')"


@_query(
    rf"""with j as (select doc_id, regexp_replace({_DOUBLE}, '\n::[ \t]*\n+::AppAnnotation[^\n]*\n', chr(10), 'g') as t from documents where text is not null), a as (select doc_id, regexp_extract_all(t, '(?s)::AppAnnotation[^\n]*\n(.*?)\n::[ \t]*(?:\n|$)', 1) as a from j)
    select doc_id, i - 1 as ord, md5({_STRIP % 'a[i]'}) as text from a, unnest(range(1, len(a) + 1)) as t(i)"""
)
def merged_annotations(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.regexp_replace("text", r"(?md)^(::AppAnnotation[^\n]*\n)([^\n]+)\n::[ \t]*$", "$1$2\n::\n\n::AppAnnotation\nAnd $2\n::")
    return _exploded(_table(spark, d, "documents").filter("text is not null"), "doc_id", M.annotation_texts(doubled), "text")


# Numbers.


@_query(f"with {_H}, n as (select docx_id, heading_id, number, row_number() over (partition by docx_id order by number, pos) as place from h) select docx_id, heading_id, number, place from n where place <= 20")
def numbers_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty headings of each document by their numbers as text, so 10 comes before 2."""
    return C.first_in_order(_headings(spark, d).select("docx_id", "heading_id", "number", "pos"), "docx_id", ["number", "pos"], 20, "place").select("docx_id", "heading_id", "number", F.col("place").cast("long").alias("place"))


_MAP = "m as (select docx_id, title, arg_max(number, pos) as number, min(pos) as pos from h where title is not null group by docx_id, title)"
_W = rf"list_distinct(list_filter(string_split_regex(lower(%s), '[{_SPACE}]+'), lambda x: x <> ''))"


@_query(
    rf"""with {_H}, {_MAP}, q as (select distinct docx_id, case when pos % 2 = 0 then title else regexp_replace(title, '[{_SPACE}][^{_SPACE}]+$', '') end as text from h where title is not null),
    l as (select *, {_W % 'text'} as lw from q), r as (select *, {_W % 'title'} as rw from m),
    p as (select l.docx_id, text, number, pos, case when text = title then 2.0 else len(list_intersect(lw, rw))::double / greatest(1, len(lw) + len(rw) - len(list_intersect(lw, rw))) end as score from l join r using (docx_id)),
    b as (select *, row_number() over (partition by docx_id, text order by score desc, pos) as n from p where score > 0.5)
    select docx_id, text, number, score from b where n = 1"""
)
def numbers_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's titles, every second one without its last word, looked up in its own contents."""
    df = _headings(spark, d).filter("title is not null")
    text = F.when(F.col("pos") % 2 == 0, F.col("title")).otherwise(F.regexp_replace("title", rf"[{T.SPACE}][^{T.SPACE}]+\z", ""))
    return J.numbers_of_texts(df.select("docx_id", text.alias("text")), C.numbering_map(df, "docx_id"), "docx_id", "text")


@_query(rf"with {_H}, t as (select heading_id, {_STRIP % ('number || chr(32) || title')} as text from h where title is not null) select heading_id, text from t where regexp_matches(text, '^\d+(?:\.\d+)*[{_SPACE}]+[\p{{L}}\p{{N}}_\x{{200c}}\x{{200d}}]')")
def numbered_texts(spark: SparkSession, d: str) -> DataFrame:
    df = C.paragraphs(_headings(spark, d).select("heading_id", F.concat("number", F.lit(" "), "title").alias("text")))
    return df.filter(C.numbered(F.col("text"))).select("heading_id", "text")


@_query(rf"with {_H} select heading_id, 'X<h2>' || number || ' ' || title || '</h2></b> t' || title as html from h where title is not null and {_STRIP % 'title'} <> ''")
def fold_misses(spark: SparkSession, d: str) -> DataFrame:
    """A fold in which the first entry is missing, so the first anchor goes, the second matches in other letter case behind a tag, and a third anchor is left over."""
    df = _headings(spark, d).filter(F.col("title").isNotNull() & (T.strip(F.col("title")) != ""))
    anchor = lambda n: F.lit(f'<a id="__RefHeading___{n}"></a>')
    page = F.concat(anchor(1), F.lit("X"), anchor(2), F.lit("<b>"), F.lower("title"), F.lit("</b> t"), anchor(3), "title")
    entry = lambda level, number, title: F.struct(F.lit(level).alias("level"), number.alias("number"), title.alias("title"))
    toc = F.array(entry(1, F.lit("9"), F.lit("☃ none")), entry(2, F.col("number"), F.col("title")))
    return df.select("heading_id", C.folded(page, toc).alias("html"))


@_query(
    f"""with r as (select distinct response_id, chapter_id, markdown from llm_response where status = 200 and markdown is not null), {_CH},
    l as (select response_id, list_filter({_TEXTS_OF % ('h[1-6]', 'h[1-6]')}, lambda x: x <> '' and not contains(markdown, x)) as a from r join c using (chapter_id))
    select response_id, array_to_string(a, '|') as lost from l where len(a) > 0"""
)
def lost_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of chapters that don't stand in their answers."""
    responses = _table(spark, d, "llm_response").filter("status = 200 and markdown is not null").select("response_id", "chapter_id", "markdown")
    joined = split_join(responses, _chapters(spark, d).select(F.col("chapter_id").alias("page_id"), "chapter_html"), "chapter_id", "page_id", "response_id")
    lost = J.missing_texts(P.heading_texts(F.col("chapter_html")), F.col("markdown"))
    return joined.select("response_id", lost.alias("a")).filter(F.size("a") > 0).select("response_id", F.array_join("a", "|").alias("lost")).distinct()


_FRONT = "---\ntitle: >\n  Doc {id}\n  in two lines\nnote: |\n  a\n  b\nsay: 'it''s {id}'\nplain: x: y\ntags:\n  - one\n  - two\nreadNext:\n  to: /n\n  label: N\n---\n# x"


@_query(
    """select doc_id, k as key, replace(v, '{id}', doc_id::varchar) as value from documents, (values ('title', 'Doc {id} in two lines'), ('note', 'a' || chr(10) || 'b'), ('say', 'it''s {id}'), ('plain', 'x: y'), ('tags', '  - one' || chr(10) || '  - two'), ('readNext', '  to: /n' || chr(10) || '  label: N')) as t(k, v)"""
)
def front_fields(spark: SparkSession, d: str) -> DataFrame:
    """Keys of front matter with values over several lines, quotes, lists and nested keys."""
    text = F.replace(F.lit(_FRONT), F.lit("{id}"), F.col("doc_id").cast("string"))
    return _table(spark, d, "documents").select("doc_id", F.explode(M.front_map(text)).alias("key", "value"))
