"""The pipeline's passage stage against brute force over runs of 51 words."""

import random

import corpus_pipeline


def kept_words(texts, n=51):
    words, seen = [t.split() for t in texts], {}
    for w in words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    gone = [{k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)} for w in words]
    return [[x for k, x in enumerate(w) if k not in g] for w, g in zip(words, gone)]


def test_passages_of_short_words(spark, smallest):
    r = random.Random(3)
    make = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice(["", "", "e"]) for _ in range(n)]
    shared, texts = [make(n) for n in (49, 50, 51, 52, 60, 75)], []
    for i in range(60):
        own = shared[i % 6]
        texts.append(" ".join([*make(r.randrange(30)), *own, *make(r.randrange(30)), *(own[: r.randrange(40, 52)] if i % 7 == 0 else [])]))
    texts += [t.replace(" ", "  ") for t in texts[:6]] + [" ".join(shared[5])]
    assert all(len(" ".join(s)) < 250 for s in shared)
    want = {i: w for i, w in enumerate(kept_words(texts)) if w}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert {x.doc_id: x.text.split() for x in corpus_pipeline.passages(spark, docs, smallest).collect()} == want
