import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chaptermill.llm import language as L


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect()]


@pytest.fixture(scope="module")
def profiles(samples):
    return L.Profiles(samples)


def test_held_out_accuracy(samples):
    rng = random.Random(1)
    mixed = samples[:]
    rng.shuffle(mixed)
    own = L.Profiles(mixed[:150])
    right = total = 0
    for lang, text in mixed[150:]:
        s = own.sentences([text])
        for words, cosine in zip(s["words"], s["cosine"]):
            if words >= 3:
                total += 1
                right += own.languages[cosine.argmax()] == lang
    assert right / total > 0.96


def test_products_are_those_of_whole_bundles(profiles):
    text = "The sign-in service saves the report on finished jobs"
    words = L._TOKEN.findall(text)
    bundle = sum(profiles.vector(w.lower()).astype(float) for w in words)
    s = profiles.sentences([text])
    product = bundle @ profiles.apart.T
    assert np.allclose(s["cosine"][0] / np.abs(s["cosine"][0]).max(), product / np.abs(product).max(), atol=1e-3)
    assert abs(np.linalg.norm(bundle) / np.sqrt(sum(np.linalg.norm(profiles.vector(w.lower())) ** 2 for w in words)) - 1) < 0.3


EN = "The storage subsystem restores the event log as soon as resources become free. The sign-in service saves the report on finished jobs at least once a day. "
DE = "Der Lastverteiler löscht die Konfigurationsdatei innerhalb weniger Minuten, sobald eine neue Anfrage eintrifft. Der Systemverwalter ersetzt die Konfigurationsdatei vor Beginn des nächsten Durchlaufs. "
RU = "Планировщик заданий проверяет резервную копию базы данных, чтобы не потерять данные. "


def test_documents(spark, profiles):
    rows = [
        (1, EN, "en"), (2, EN, None), (3, EN, "de"), (4, EN + "\n\n" + DE, "en"), (5, EN + "\n\n> «Der Lastverteiler löscht die Konfigurationsdatei.»", "en_GB"), (6, None, None), (7, "", None), (8, " ​", None),
        (9, "# Настройка сервера приложений\n\n```bash\nls\n```", "und"), (10, EN, "English"), (11, EN * 3 + "`" + "x" * 100_000 + "`", "EN"), (12, RU, "uk"), (3, EN, "de"), (13, "123 456", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang): r.problem for r in L.document_languages(df, "doc_id", "text", "lang", profiles).collect()}
    assert got == {(1, "en"): None, (2, "en"): "missing", (3, "en"): "wrong", (4, "en"): "mixed", (4, "de"): "mixed", (5, "en"): None, (9, "ru"): "missing", (10, "en"): None, (11, "en"): None, (12, "ru"): "wrong"}
    segments = [(r.segment_no, r.lang) for r in L.language_segments(df.filter("doc_id = 4"), "doc_id", "text", profiles).orderBy("segment_no").collect()]
    assert segments == [(1, "en"), (2, "de")]
    assert L.document_languages(df.limit(0), "doc_id", "text", "lang", profiles).count() == 0
    assert all(0 < r.confidence <= 1 for r in L.language_segments(df, "doc_id", "text", profiles).collect())


def test_labels(spark):
    names = ["ru-RU", "RUS", " Russian ", "en_GB", None, "", "und", "N/A", "fr", "deutsch", "pt (Brazil)"]
    df = spark.createDataFrame([(n,) for n in names], "l string")
    assert [r[0] for r in df.select(L.label_language(F.col("l"))).collect()] == ["ru", "ru", "ru", "en", "", "", "", "", "fr", "de", "pt"]


def test_batches_agree(profiles):
    texts = [EN, None, DE + EN, "", RU, "x", DE]
    whole = profiles.segments(texts)
    for k, t in enumerate(texts):
        one = profiles.segments([t])
        assert one["lang"].tolist() == whole["lang"][whole["row"] == k].tolist() and one["words"].tolist() == whole["words"][whole["row"] == k].tolist()


def test_lengths_are_those_of_the_bundles():
    texts = ["The node restores the log of the node and the logs of the nodes.", "Der Knoten löscht den Verlauf der Knoten.", "a a a a a", "Вузол вузла вузлом"]
    profiles = L.Profiles([("en", texts[0]), ("de", texts[1])], dimensions=1 << 16)
    units = profiles.units(texts)
    got = profiles.lengths(units.place, units.starts, units.ends)
    for text, length, words in zip(texts, got, units.words):
        found = [w.lower() for w in L._TOKEN.findall(text) if w[0] not in L._ENDS]
        assert len(found) == words and abs(length / np.linalg.norm(sum(profiles.vector(w).astype(float) for w in found)) - 1) < 0.01
    sentences = profiles.sentences([texts[0]])
    whole = sum(profiles.vector(w.lower()).astype(float) for w in L._TOKEN.findall(texts[0]) if w[0] not in L._ENDS)
    assert np.allclose(sentences["cosine"][0], profiles.apart @ whole / np.linalg.norm(whole), atol=0.01)


def test_long_words_count_to_their_ends():
    profiles = L.Profiles([("en", "one two"), ("de", "eins zwei")])
    a, b = "x" * 45 + "abc", "x" * 45 + "xyz"
    assert (profiles.vector(a) != profiles.vector(b)).any()
