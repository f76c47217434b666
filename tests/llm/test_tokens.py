import base64
import os
import random

import pytest

from chaptermill.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.isdir(K.TOKENIZERS), reason="no vocabulary files here")


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(os.path.join(K.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_another_encoder_and_round_trip():
    encoder, codec = reference(), K.Codec()
    rng = random.Random(2)
    pools = ["abc ABC 019 '", "абвгдёжзи", " \n\t\r\xa0  ", "²½№٣東京👩‍💻", "_-<|endoftext|>▁<unk>"]
    texts = ["", "It's we'll 12 ", "Настройка  сервера\r\n\r\n", *("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(80))) for _ in range(3000))]
    ids, starts = codec.encode(texts)
    for k, t in enumerate(texts):
        own = ids[starts[k] : starts[k + 1]].tolist()
        assert own == encoder.encode_ordinary(t), ascii(t)
        assert codec.decode(own) == t


def test_fast_pattern_agrees_with_the_exact_one():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        if not K._UNCOMMON.search(c):
            for t in (f"a{c}1", f" {c}{c} _", f"{c} {c}"):
                assert K._EXACT.findall(t) == K._COMMON.findall(t), ascii(c)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} слово{i}" for i in range(300)]
    whole = K.Codec().encode(texts)
    monkeypatch.setattr(K, "KEPT", 10)
    codec = K.Codec()
    for k, t in enumerate(texts):
        ids, _ = codec.encode([t])
        assert ids.tolist() == whole[0][whole[1][k] : whole[1][k + 1]].tolist()


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a" * 200_000), (1, "Hello world")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in K.encoded(df, "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2 and K.codec().decode(got[4]) == "a" * 200_000
    assert K.encoded(df, "doc_id", "text").count() == 5 and K.encoded(df.limit(0), "doc_id", "text").count() == 0
    assert "Exchange" not in K.encoded(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
