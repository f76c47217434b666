import random
import re

import numpy as np

from chaptermill.llm import leakage as K


def plainly(texts, items, n=12):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").casefold())
    grams = lambda t: {tuple(words(t)[k : k + n]) for k in range(len(words(t)) - n + 1)}
    inside = {i: grams(t) for i, t in items}
    return {(row, i) for row, t in enumerate(texts) for i, g in inside.items() if g & grams(t)}


def test_against_brute_force():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(rng.randrange(5, 60)))) for k in range(60)]
    texts = []
    for _ in range(300):
        words = make(rng.randrange(0, 120)) + ["other"] * rng.randrange(3)
        source = rng.choice(items)[1].split()
        if rng.random() < 0.7:
            a = rng.randrange(len(source))
            words[5:5] = source[a : a + rng.choice([10, 11, 12, 13, 40])]
        texts.append("".join(w.upper() + rng.choice([" ", ", ", "\n", "** ", "_"]) if rng.random() < 0.3 else w + " " for w in words))
    index = K.Index.of([i for i, _ in items], [t for _, t in items])
    assert {(r, index.ids[n]) for r, n in index.leaks(texts)} == plainly(texts, items)


def test_retrieval_is_all_above_the_threshold(monkeypatch):
    rng = random.Random(1)
    items = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(12, 200))) for _ in range(300)]
    for block_bytes, step in ((K.BLOCK_BYTES, K.STEP_PAIRS), (4096, 7)):
        monkeypatch.setattr(K, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(K, "STEP_PAIRS", step)
        index = K.Index.of(list(range(300)), items)
        words = np.array([rng.randrange(len(index.words)) for _ in range(400)] + index.flat[:500].tolist(), np.int32)
        terms, size = index.terms_of(words), index.stretch - len(index.grams)
        starts = [k for k in range(len(terms) - size + 1) if (terms[k : k + size] >= 0).all()]
        postings = {}
        for key, weight in zip(index.keys.tolist(), index.weights.tolist()):
            postings.setdefault(key // len(index.item), {})[key % len(index.item)] = weight
        want = set()
        for k in starts:
            query = set(terms[k : k + size].tolist())
            holding = set.intersection(*(set(postings[t]) for t in query))
            want |= {(k, p) for p in holding if sum(postings[t][p] for t in query) >= sum(index.idf[t] for t in query) * index.once[p] * (1 - 1e-5)}
            assert all((k, p) in want for p in holding)  # each part with all terms reaches the threshold
        got = list(zip(*(a.tolist() for a in index.retrieve(terms, np.array(starts), size))))
        assert len(got) == len(set(got)) and set(got) == want and len(want) >= 300


def test_many_items_against_brute_force():
    rng = random.Random(5)
    sentence = lambda: [f"a{rng.randrange(9)}", "the", f"b{rng.randrange(9)}", "of", f"c{rng.randrange(5)}", "x", f"d{rng.randrange(3)}"]
    text = lambda n: " ".join(w for _ in range(n) for w in sentence())
    items = [(k, text(rng.randrange(1, 40))) for k in range(300)]
    texts = [text(rng.randrange(30)) for _ in range(25)] + [items[5][1], "", None]
    index = K.Index.of([i for i, _ in items], [t for _, t in items])
    got = {(r, index.ids[n]) for r, n in index.leaks(texts)}
    assert got == plainly(texts, items) and len(got) > 20


def test_rows(spark):
    words = [f"слово{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(words[:12])), (1, " ".join(words[:12])), (2, None), (3, ""), (4, " ".join(words[:11])), (5, "x " * 50_000 + "; ".join(words).upper())], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "short"), (3, None)], "item_id int, text string")
    got = {tuple(r) for r in K.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 1), (5, 1)}
    assert K.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert K.leaked(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_parts_agree(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(20))) for k in range(25)]
    docs = [(k, " x ".join(rng.choice(items)[1] for _ in range(2))) for k in range(30)]
    run = lambda: {tuple(r) for r in K.leaked(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i int, t string"), "i", "t").collect()}
    whole = run()
    monkeypatch.setattr(K, "CHARS_AT_ONCE", 500)
    assert run() == whole and len(whole) >= 30
