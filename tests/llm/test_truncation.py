import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chaptermill.llm import answers as A
from chaptermill.llm import truncation as T


def test_censoring_finds_the_limit():
    rng = np.random.default_rng(1)
    lengths = np.exp(rng.normal(7.2, 0.6, 5000)).astype(int)
    limit = 1733
    cut = (lengths > limit) & (rng.random(5000) < 0.5)
    seen = np.where(cut, limit, lengths)
    logs = np.log(seen)
    p = T.censoring(len(seen), logs.sum(), (logs**2).sum(), np.log([1000, limit]), np.array([(seen == 1000).sum(), (seen == limit).sum()]))
    assert p[1] > 0.95 and p[0] < 0.7
    assert len(T.censoring(0, 0, 0, np.zeros(0), np.zeros(0))) == 0


def test_limits_are_found_in_the_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(n)) for s, limits in (("a", (750,)), (None, (12_000, 30_000))) for n in np.exp(rng.normal(8, 1.2, 4000)) for n in [min([n, *(x for x in limits if n > x and rng.random() < 0.3)])]]
    df = spark.createDataFrame([(s, n, n, n, k) for k, (s, n) in enumerate(rows)], "src string, n_kept long, n_whole long, n_bytes long, digest long").withColumn("s", T.source_key(F.col("src")))
    found = {(r.s, r.unit, r.length) for r in T.candidate_limits(T.lengths(df)).collect()}
    assert found == {("=a", "kept", 750), ("null", "kept", 12_000), ("null", "kept", 30_000)}
    posteriors = {r.s: r.limits for r in T.limit_posteriors(T.lengths(df)).collect()}
    assert posteriors["=a"]["kept 750"] > 0.9 and min(posteriors["null"].values()) > 0.9
    assert T.candidate_limits(T.lengths(df.withColumn("digest", F.lit(1)))).count() == 0  # one text again and again is no limit


def test_posterior_decides_where_the_ending_leaves_it_open(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "omega"]

    def text(n):
        out = "# T\n"
        while len(out) < n:
            out += f"\n- {' '.join(rng.choice(words, 4))} {len(out)} {rng.choice(words)}"
        return out

    def cut(n):  # at a word that ends items and goes on
        while True:
            t = text(n)[:n]
            if t.rpartition(" ")[2] in words and t.rpartition("\n")[2].count(" ") >= 2:
                return t

    rows = [(k, text(int(np.exp(rng.normal(6.8, 0.5))))) for k in range(1500)] + [(k, cut(700)) for k in range(1500, 1560)]
    df = spark.createDataFrame([(k, "a", t, None) for k, t in rows], "id long, src string, md string, c long")
    none = spark.createDataFrame([], "c long, h string")
    found = {use: {r.id for r in T.truncated(df, "id", "src", "md", "c", none, "c", "h", use).filter("is_cut").collect()} for use in (True, False)}
    assert len(found[True] & set(range(1500, 1560))) >= 58 and len(found[True] - set(range(1500, 1560))) <= 10
    assert len(found[False] & set(range(1500, 1560))) <= 10


@pytest.mark.parametrize(
    ("text", "kind", "mark"),
    [
        ("# T\n\nA whole sentence.", "stop", ""), ("# T\n\nA sente", "bare", ""), ("A sente…\n\n", "bare", "ellipsis"), ("A sente...", "bare", "dots"), ("слов�", "bare", "bytes"), ("| a | b |", "stop", ""), ("| a | b", "open", ""), ("```\ncode\n```", "stop", ""),
        ("```\ncod", "open", ""), ("![alt](/x.png)", "stop", ""), ("![alt](/x", "open", ""), ("see `/opt/x`", "stop", ""), ("see `/opt", "open", ""), ("run (code", "open", ""), ("::AppAnnotation\nx.\n::", "stop", ""), ("```markdown\n# A\nText.\n```", "stop", ""), ("```markdown\n# A\nTex", "bare", ""),
    ],
)
def test_endings(text, kind, mark):
    e = A.ending(text)
    assert (e.kind, e.mark) == (kind, mark)


def test_place():
    page = "<h1>Title</h1><p>First sentence of the chapter.</p><p>The last sentence of all.</p>"
    where = lambda t: A.place_in_source(A.ending(t).tail, page)
    assert where("# Title\n\nFirst sentence of the chapter.\n\nThe last sentence of all…") == "end"
    assert where("# Title\n\nFirst sentence of the chap") == "inside"
    assert where("Something that is quite different") == "elsewhere" and A.place_in_source("x", page) == "unknown"


def test_empty_and_copies():
    for t in (None, "", " ​\n", "---\n---\n", "---\ntitle: x\n---", "- \n- \n", "<p></p>", "<!-- a -->", "```markdown\n```", "::AppAnnotation\n::", "\xa0\n﻿"):
        assert A.is_empty(t), t
    for t in ("x", "# a", "```\n1\n```", "text here.", "---\nno front"):
        assert not A.is_empty(t), t
    assert A.markup_share("<h1>a</h1><p>b</p>") > T.COPY_MARKUP and A.markup_share("# a\n\n```html\n<p>x</p><p>y</p>\n```\n" + "text " * 20) < T.COPY_MARKUP


def test_words_count_everything_but_the_last():
    words = T.Words()
    words.add(["a b c.\na b", None, "", "a b. a b c 7"])
    words.add(["b"])
    batch = words.batch(pa.schema([("word", pa.int64()), ("ends", pa.int64()), ("goes_on", pa.int64()), ("k", pa.string())]))
    got = {w: (e, o) for w, e, o, _ in zip(*(c.to_pylist() for c in batch.columns))}
    assert got == {T.word_key("A"): (0, 4), T.word_key("b"): (1, 2), T.word_key("c"): (1, 1)} and not words.all


def test_windows_at_the_end_give_what_the_whole_text_gives():
    body = '# T\n\nThe picture ends here <img src="' + "a" * 700 + '">\n\nshort end'
    assert A.ending(body).tail == "epictureendshereshortend"[-A.TAIL :] == A.letters(A._NOT_IN_SOURCE.sub(" ", body))[-A.TAIL :]
    for text in ("word" + " ." * 400 + "...", "word" + "…" * 300, "word [" + "text was truncated" + "]" + " " * 500, "word\n" * 100 + "[cut]…", "a" * 500, "…" * 900, ""):
        m = A._MARK.search(text.rstrip(A.UNSEEN))
        assert A.kept_part(text) == (text[: m.start()].rstrip(A.UNSEEN) if m else text.rstrip(A.UNSEEN))


def test_found(spark):
    page = "<h1>T</h1><p>" + "The deployment script restores the image. " * 8 + "The standby node checks the certificate.</p>"
    whole = "# T\n\n" + "The deployment script restores the image. " * 8 + "The standby node checks the certificate."
    rows = [(1, "a", whole, 5), (2, "a", whole[:200], 5), (2, "a", whole[:200], 5), (3, "a", None, 5), (4, None, whole[:-8] + "…", None), (5, "a", page, 5), (6, "b", whole[:-1] + "…", 5), (7, "b", "", None), (8, "b", whole, 77)]
    df = spark.createDataFrame(rows, "response_id long, source string, markdown string, chapter_id long")
    chapters = spark.createDataFrame([(5, page), (5, page), (6, None)], "chapter_id long, chapter_html string")
    judged = T.truncated(df, "response_id", "source", "markdown", "chapter_id", chapters, "chapter_id", "chapter_html")
    got = {r.response_id: r.is_cut for r in judged.collect()}
    assert got == {1: False, 2: True, 4: True, 5: False, 6: False, 7: False, 8: False} and judged.count() == 7
    shares = {r.source: (r.n, r.n_cut) for r in T.cut_shares(judged, "source").collect()}
    assert shares == {"a": (3, 1), "b": (3, 0), None: (1, 1)}
    assert T.truncated(df.filter(F.lit(False)), "response_id", "source", "markdown", "chapter_id", chapters, "chapter_id", "chapter_html").count() == 0
