import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chaptermill.llm import lookalike as L


def forms(*texts):
    return L.forms(pa.array(texts, pa.string())).to_pylist()


def test_same_look():
    groups = [
        ["Перенос файлов", "Пepeнoc файлов", "Перенос файлов", "Пе\xadре​нос фай﻿лов", " Перенос файлов "],
        ["Prüfung", "Prüfung", "Ｐｒüｆｕｎｇ", "Рrüfung"],
        ["й", "й"], ["ё", "ё", "ë"], ["API-шлюз", "АΡІ－шлюз"], ["ế", "ế", "ế"], ["ệ", "ệ", "ệ"], ["한", "한"],
    ]
    for group in groups:
        assert len(set(forms(*group))) == 1, group


def test_visible_differences_stay():
    pairs = [("учетных", "учётных"), ("задании", "заданий"), ("API", "api"), ("a-b", "a b"), ("a–b", "a-b"), ("ab", "a b"), ("a  b", "a b"), ("x²", "x2"), ("l", "I"), ("0", "O"), ("а", "б")]
    for a, b in pairs:
        assert len(set(forms(a, b))) == 2, (a, b)


def test_nulls_and_nothing():
    assert forms(None, "", " ​", "a") == [None, "", "", "a"]
    assert L.forms(pa.array([], pa.string())).to_pylist() == []
    assert L.forms(pa.array(["x", None, "yy"], pa.string()).slice(1, 2)).to_pylist() == [None, "yy"]


def test_form_of_a_form_is_itself_and_words_have_one_script():
    texts = ["Назначение SSL-сертификата", "cop", "сор", "Über", "їжак ї", "Доcker х", "Ἀθήνα"]
    once = forms(*texts)
    assert forms(*once) == once and once[0] == texts[0] and once[1] == once[2]


def test_composition_against_unicodedata():
    rng = random.Random(4)
    marks = [c for c in range(0x300, 0x370) if unicodedata.combining(chr(c)) and c != 0x34F and unicodedata.normalize("NFD", chr(c)) == chr(c)]
    texts = ["".join(chr(rng.choice([rng.randrange(0x62, 0x7B), *rng.sample(marks, 3)])) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    assert forms(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_long_text():
    assert forms("é" * 300_000)[0] == "é" * 300_000


def test_found(spark):
    items = spark.createDataFrame([(1, "Пepeнос"), (1, "Пepeнос"), (2, "Перенос"), (3, None), (4, ""), (5, "перенос"), (6, "​перенос")], "heading_id long, title string")
    toc = spark.createDataFrame([(7, "Перенос", "x"), (8, "перенос", None)], "title_id int, title string, form string")
    got = {tuple(r) for r in L.same_looking(items, "heading_id", "title", toc, "title_id", "title").collect()}
    assert got == {(1, 7), (6, 8)}
    assert L.same_looking(items.limit(0), "heading_id", "title", toc, "title_id", "title").count() == 0
    kept = L.consistent_form(toc, "title")
    assert kept.columns == ["title_id", "title", "form"] and {r.form for r in kept.collect()} == {"Перенос", "перенос"}
    assert L.consistent_form(toc.withColumn("f", F.lit(1)), "title", "title").columns == ["title_id", "form", "f", "title"]


@pytest.mark.parametrize("n", [1, 50])
def test_slices_agree(n):
    rng = random.Random(n)
    texts = [rng.choice([None, "", "Ѕеіtе", "áb", "плoxo"]) for _ in range(n)]
    assert forms(*texts) == [forms(t)[0] for t in texts]
