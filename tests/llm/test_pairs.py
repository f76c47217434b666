import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from chaptermill.llm import pairs as Q
from chaptermill.llm.language import Profiles


@pytest.fixture(scope="module")
def samples(spark, data):
    return sorted((r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect())


@pytest.fixture(scope="module")
def model(samples):
    profiles = Profiles(samples, marker=Q.word_classes)
    return profiles, Q.fitted(samples, profiles)


EN = ["The storage subsystem restores the event log as soon as resources become free.", "The sign-in service saves the report on finished jobs at least once a day."]
DE = ["Der Lastverteiler löscht die Konfigurationsdatei innerhalb weniger Minuten.", "Der Systemverwalter ersetzt die Konfigurationsdatei vor Beginn des nächsten Durchlaufs."]
PAGE = "<h1>Log</h1>" + "".join(f"<p>{s}</p>" for s in EN)
GOOD = "# Log\n\n" + "\n\n".join(EN)


def test_defects(model):
    cases = {
        None: [GOOD, "```markdown\n" + GOOD + "\n```", "Here is the text:\n\n" + GOOD, GOOD[:-1] + "…", GOOD.replace(EN[0], "> Note: «I'm sorry, but I cannot do that». " + EN[0])],
        "empty": [None, "", "---\n---\n", " ​"],
        "refusal": ["I'm sorry, but I can't convert this chapter without more context. Is there anything else I can do?", "# Log\n\nLeider kann ich dieses Kapitel nicht umwandeln.", "**К сожалению, я не могу выполнить данное задание.**"],
        "copy": [PAGE, "```html\n" + PAGE + "\n```", html.escape(PAGE), "HTML:\n" + PAGE.replace("</p>", "</p>\n   ")],
        "other_language": ["# Log\n\n" + "\n\n".join(DE), "# Protokoll\n\n" + "\n\n".join(DE)],
        "truncated": [GOOD[:-20], GOOD[:-20] + "…", GOOD[:60] + "\n\n"],
    }
    for want, answers in cases.items():
        assert Q.defects(answers, [PAGE] * len(answers), *model) == [want] * len(answers), want


def test_html_sample_is_no_copy(model):
    page = PAGE + "<pre><code>&lt;p&gt;1&lt;/p&gt;</code></pre>"
    answer = GOOD + "\n\n```html\n<p>1</p>\n```"
    table = GOOD + "\n\n<table><tr><td>1</td></tr></table>\n\nThe end of it."
    assert Q.defects([answer, table], [page, PAGE + "<table><tr><td>1</td></tr></table><p>The end of it.</p>"], *model) == [None, None]


def test_no_source_text(model):
    assert Q.defects([GOOD, "\n\n".join(DE)], ["", None], *model) == [None, None]


def test_refusals_in_words_that_training_lacks(model):
    """None of these stands among the parts that the field learns from; one chapter in each language."""
    held_out = [
        "I cant help with this chapter.", "I refuse to do this.", "I won't convert this chapter, please ask someone else.", "My apologies, I could not complete what you asked.", "I must decline.", "We are unable to assist you with that.",
        "Прошу прощения, я отказываюсь это делать.", "Увы, мне нельзя преобразовывать такой текст.", "Я вынужден отказаться от этой задачи.",
        "Перепрошую, але я відмовляюся це робити.", "Я не буду перетворювати цей текст.", "Пробачте, мені не можна вам допомогти.",
        "Es tut mir leid, ich darf das nicht umwandeln.", "Ich weigere mich, das zu tun.", "Diese Aufgabe kann ich nicht übernehmen.",
        "Disculpe, me niego a convertir este texto.", "Perdone, yo no puedo hacer eso.", "Lo lamento, no estoy autorizado para ayudarle.",
        "Desculpe, eu recuso esta tarefa.", "Sinto muito, não estou autorizado a ajudar.", "Eu não vou converter este texto, peço desculpa.",
    ]
    learned = {clause.lower() for lang in Q._PARTS for n in range(60) for clause in Q.declining(lang, n)}
    assert not {t.lower() for t in held_out} & learned
    for page in (PAGE, PAGE.replace("<h1>Log</h1>", "<h1>Protokoll</h1>").replace(EN[0], DE[0]).replace(EN[1], DE[1])):
        got = Q.defects(held_out, [page] * len(held_out), *model)
        assert [t for t, d in zip(held_out, got) if d != "refusal"] == []
    texts = ["The script cannot restore the log if the disk is full.", "Der Knoten kann die Datei nicht löschen.", "You can update the list of users here.", "Note: the node refuses requests without a certificate."]
    for t in texts:
        page = PAGE + f"<p>{t}</p>"
        assert Q.defects([GOOD + f"\n\n{t}", t], [page, f"<p>{t}</p>"], *model) == [None, None], t


def test_field_against_brute_force():
    rng = np.random.default_rng(2)
    k = len(Q.TAGS)
    field = Q.Field(rng.normal(size=(len(Q.FEATURES), k)), rng.normal(size=(k, k)), rng.normal(size=k))
    sizes = [1, 4, 0, 3]
    x = rng.normal(size=(sum(sizes), len(Q.FEATURES)))
    rows = np.repeat(np.arange(4), sizes)
    tags = field.best(x, rows, 4)
    at = 0
    for size in sizes:
        emit = x[at : at + size] @ field.weights
        best, score = None, -1e9
        for code in range(k**size if size else 0):
            seq = [code // k**i % k for i in range(size)]
            s = field.first[seq[0]] + sum(emit[i, t] for i, t in enumerate(seq)) + sum(field.moves[a, b] for a, b in zip(seq, seq[1:]))
            if s > score:
                best, score = seq, s
        assert tags[at : at + size].tolist() == (best or [])
        at += size


def test_fit_is_deterministic(samples, model):
    again = Q.fitted(samples, model[0])
    assert np.allclose(again.weights, model[1].weights)


def test_long_answer(model):
    long = "\n\n".join(EN * 3000)
    page = "<p>" + "</p><p>".join(EN * 3000) + "</p>"
    assert Q.defects([long], [page], *model) == [None]


def test_found(spark, data):
    lang = spark.read.parquet(f"{data}/lang_samples.parquet")
    rows = [(1, GOOD, 5), (2, None, 5), (2, None, 5), (3, PAGE, 5), (4, None, 99), (5, None, None), (6, "", 6)]
    answers = spark.createDataFrame(rows, "response_id long, markdown string, chapter_id long")
    chapters = spark.createDataFrame([(5, PAGE, 0), (5, PAGE, 0), (6, None, 0)], "chapter_id long, chapter_html string, response_id int")
    find = lambda a: Q.broken_pairs(a, "response_id", "markdown", "chapter_id", chapters, "chapter_id", "chapter_html", lang)
    found = find(answers)
    assert {tuple(r) for r in found.collect()} == {(2, "empty"), (3, "copy"), (6, "empty")} and found.count() == 3
    assert find(answers.filter(F.lit(False))).count() == 0
