"""Quality rules, classifier and language model: counts against brute force, models against plain versions."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from llm import lm_scoring, quality_classifier, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


ODD = [None, "", " \n\t", "one", "a b c d e a b c d e f", "x\nx\n\nx y\nx y", "é🙂 # [*] | <b>", "w " * 3000, "\x0b\x0c\r", "A\x00B c"]


def test_base_counts(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.score_documents(docs, labels).collect()}
    for r in docs.collect():
        want, x = base(r.text), got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and x.kept == (not x.base_failed and x.score >= quality_rules.Parameters().min_score)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == {i for i, x in got.items() if x.kept}


def test_ratio_is_of_the_two_multinomials(spark):
    rows = [(1, "good good words"), (2, "bad stuff"), (3, "good bad")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0), (99, 1)], "doc_id long, quality int")
    ratio = quality_rules.fit(docs, labels)
    grams = {k: t.split() + list(zip(t.split(), t.split()[1:])) for k, t in rows}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    prior = quality_rules.Parameters().prior
    share = lambda g: (raw[g] + 1) / (sum(raw.values()) + quality_rules.BUCKETS)
    ratio_of = lambda g: (target[g] + prior * share(g)) / (sum(target.values()) + prior) / share(g)
    for r in quality_rules.score_documents(docs, labels).collect():
        own = grams[r.doc_id]
        assert r.score == pytest.approx(sum(math.log(ratio_of(g)) for g in own) / len(own))
    assert len(ratio) == quality_rules.BUCKETS and quality_rules.score_documents(docs.where("doc_id < 0"), labels).count() == 0
    assert {r.score for r in quality_rules.score_documents(docs, labels.where("quality > 1")).collect()} == {0.0}


def test_every_trusted_document_counts(spark):
    """More than any bound on labelled rows: all are counted, repeated rows too, whatever else has a column of that name."""
    docs = spark.range(45_000).selectExpr("id as doc_id", "concat('w', id % 50, ' common') as text", "'x' as bucket", "1 as trusted")
    docs = docs.unionByName(docs.where("doc_id < 100"))
    labels = docs.where("doc_id % 10 <> 3").selectExpr("doc_id", "cast(1 as int) as quality")
    labels = labels.unionByName(labels).unionByName(docs.selectExpr("doc_id", "cast(0 as int) as quality"))
    counts = Counter(r.text for r in docs.where("doc_id % 10 <> 3").select("text").collect())
    assert sum(counts.values()) > 40_000
    got = quality_rules.count_ngrams(docs.join(labels.where("quality = 1"), "doc_id", "left_semi").select("text")).agg({"n": "sum"}).first()[0]
    assert got == 3 * sum(counts.values())
    ratio = quality_rules.fit(docs, labels)
    p, n = quality_rules.Parameters(), 3 * sum(counts.values())
    target, raw = Counter(), Counter()
    for r in docs.select("doc_id", "text").collect():
        for g in (*r.text.split(), tuple(r.text.split())):
            raw[g] += 1
            target[g] += r.doc_id % 10 != 3
    share = lambda g: (raw[g] + 1) / (sum(raw.values()) + quality_rules.BUCKETS)
    want = {round(math.log((target[g] + p.prior * share(g)) / (n + p.prior) / share(g)), 9) for g in raw}
    assert want <= {round(x, 9) for x in ratio.tolist()}


def test_pairwise_identity():
    r = np.random.default_rng(0)
    m = quality_classifier.Machine(0.3, r.normal(size=quality_classifier.FEATURES), r.normal(size=(quality_classifier.FEATURES, 4)), np.zeros(16), np.ones(16))
    row, feature, value = np.array([0, 0, 0, 1]), np.array([5, 9, 11, 5]), np.array([0.5, -1.0, 2.0, 1.0])
    got = m.logits(row, feature, value, 2)[0]
    x = dict(zip(feature[:3], value[:3]))
    want = 0.3 + sum(m.weight[i] * v for i, v in x.items()) + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in x for j in x if i < j)
    assert got == pytest.approx([want, 0.3 + m.weight[5]])


def test_scores_by_the_definition(spark, smallest):
    """Scores of the fitted machine over plainly counted features, all pairs added up one by one."""
    docs, labels = (spark.read.parquet(f"{smallest}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score_documents(docs, labels).collect()}
    shift = 64 - quality_classifier.BITS
    for r in docs.orderBy("n_chars").limit(40).collect():
        data = (r.text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        counts = Counter(int(quality_classifier.SpanHash(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0]) >> shift for w in words)
        n, chars, symbols, dup, repeated = base(r.text)
        size, lines, some = max(len(data), 1), data.count(b"\n") + 1, max(n, 1)
        count = lambda chosen: sum(b in chosen for b in data) / size
        stats = [math.log1p(n), math.log1p(len(data)), chars / some, symbols / some, symbols / size, dup / lines, repeated / some, len(counts) / some, math.log1p(size / lines)]
        stats += [count(b"0123456789"), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"\n"), count(b".,;:!?"), count(b"|{}[]=_/\\@"), sum(b > 127 for b in data) / size, n < 10]
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        x = {b: math.log1p(c) / norm for b, c in counts.items()}
        x |= {(1 << quality_classifier.BITS) + i: min(4, max(-4, (s - m) / d)) / 4 for i, (s, m, d) in enumerate(zip(stats, machine.mean, machine.scale))}
        used = sorted(x)
        logit = machine.bias + sum(machine.weight[i] * x[i] for i in used)
        v = np.array([machine.factors[i] * x[i] for i in used])
        products = v @ v.T
        logit += np.triu(products, 1).sum()
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_training_is_bounded_by_features(spark, smallest):
    docs, labels = (spark.read.parquet(f"{smallest}/{t}.parquet") for t in ("documents", "labels"))
    few = quality_classifier.fit(docs, labels, quality_classifier.Parameters(train_features=2000, least_seen=100))
    all_ = quality_classifier.fit(docs, labels, quality_classifier.Parameters(least_seen=100))
    words = 1 << quality_classifier.BITS
    assert 0 < np.count_nonzero(few.weight[:words]) <= 2000 < np.count_nonzero(all_.weight[:words])


def test_odd_rows_are_scored(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(1, "", 0.1), (None, "no id", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))], "doc_id long, quality int")
    got = quality_classifier.score_documents(docs, labels).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    none = quality_classifier.score_documents(docs, labels.where("quality > 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.score_documents(docs.where("doc_id < 0"), labels).count() == 0


def scores(rows, p):
    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in rows}
    trained = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in trained for w in tokens[i])
    n, v = sum(c.values()), len(c)
    kept = {k: m for k, m in Counter((a, b) for i in trained for a, b in zip([None, *tokens[i]], tokens[i])).items()}
    takes = Counter()
    for (h, _), m in kept.items():
        takes[h] += m - p.discount
    share = lambda w: (max(c[w] - p.discount, 0) + p.discount * v / (v + 1)) / n

    def chance(h, w):
        left = max(1 - takes[h] / c[h], 1e-12) if c[h] else 1.0
        return left * share(w) + ((kept[h, w] - p.discount) / c[h] if (h, w) in kept else 0)

    for h in (None, next(iter(c))):  # what may follow a state adds up to 1, the unknown included
        assert sum(chance(h, w) for w in c) + chance(h, "\x00") == pytest.approx(1)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(chance(h, w)) for h, w in zip([None, *t], t))) for i, t in tokens.items()}


def test_language_model(spark, smallest):
    p = lm_scoring.Parameters(chunk_tokens=9_000)
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    want = scores([(r.doc_id, r.text) for r in docs.collect()], p)
    got = {r[0]: tuple(r)[1:] for r in lm_scoring.score_documents(docs, p).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:])
    whole = {r[0]: tuple(r)[1:] for r in lm_scoring.score_documents(docs).collect()}
    assert all(whole[i][:4] == w[:4] and whole[i][4:] == pytest.approx(w[4:]) for i, w in want.items())


def test_language_model_of_repeated_rows_and_its_sql(spark, smallest):
    """Repeated rows count and are scored each; the SQL of the query gives the same."""
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 6 = 0"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), round(r.score / r.n_tokens, 6)) for r in lm_scoring.score_documents(docs, lm_scoring.Parameters(chunk_tokens=500)).collect()))
    documents = pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})  # noqa: F841
    want = sorted(duckdb.sql(queries.oracle_sql()["op10_lm_scoring"]).fetchall())
    assert len(got) == len(rows) and all(g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=2e-6) for g, w in zip(got, want))


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(2, "a", "x")], "doc_id long, text string, chunk string")
    assert zlib.crc32(b"2") % 7 != 2 or lm_scoring.score_documents(docs).first().train_tokens == 0
    assert lm_scoring.score_documents(docs.where("doc_id < 0")).count() == 0
    twice = lm_scoring.score_documents(docs.unionByName(docs)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_every_word_is_a_history(spark, smallest):
    """More distinct words than any fixed number of states: the bigrams after the rarest count too."""
    docs = spark.createDataFrame([(i, " ".join(f"h{j} t{j}" for j in range(i % 5 * 2000, i % 5 * 2000 + 2000))) for i in range(15)], "doc_id long, text string")
    p = lm_scoring.Parameters()
    want = scores([(r.doc_id, r.text) for r in docs.collect()], p)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, p).collect()}
    assert got == {i: pytest.approx(w[5]) for i, w in want.items()}


@pytest.mark.parametrize("sampled", [1, 10**12])
def test_one_history_before_half_of_all_words(spark, sampled):
    """Its bigrams are dealt to all partitions, so that no task has more than its share; scores are those of the definition, and do not
    depend on which histories the sample shows to be frequent."""
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"the w{k}" for k in r.integers(0, 20_000, 300))) for i in range(60)] + [(99, None)], "doc_id long, text string").repartition(3)
    p = lm_scoring.Parameters(chunk_tokens=2_000, sampled=sampled)
    want = scores([(x.doc_id, x.text) for x in docs.collect()], p)
    got = {x.doc_id: (x.n_known, x.score) for x in lm_scoring.score_documents(docs, p).collect()}
    assert got == {i: (w[2], pytest.approx(w[5])) for i, w in want.items()}
    # what a task of 40 would be asked for
    n, names = 40, docs.selectExpr("doc_id as id", "xxhash64(text) as tie", "text")
    hot = lm_scoring.frequent_words(names, p, n)
    rows = pa.table({"text": [x.text for x in docs.collect()], "trained": [True] * 61, "copies": [1] * 61})
    asked = lm_scoring._ask(n, hot)((pa.scalar(0),), rows)
    pairs = np.zeros(n)
    np.add.at(pairs, asked.column("bucket").to_numpy(), [len(x) // 8 for x in asked.column("pairs").to_pylist()])
    share = pairs.max() / pairs.sum()
    assert (len(hot), share < 2 / n) == (1, True) if sampled == 1 else (len(hot), share > 0.4) == (0, True)


def test_steps_of_the_automaton_are_taken_at_once():
    """Sums over all texts at once against a walk from state to state."""
    rng, p, size = np.random.default_rng(3), lm_scoring.Parameters(), 6
    count, takes = np.array([0, 5, 9, 1, 7, 3]), np.array([0, 2.5, 4, 0, 6.5, 1.5])
    machine = lm_scoring.Automaton(lm_scoring.Corpus(25, 5), count, takes, p)
    texts = [rng.integers(0, size, n).tolist() + [5] for n in (0, 1, 7, 40)]  # 5 is the end
    flat = np.concatenate([np.array(t) for t in texts])
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keys, steps = np.unique(lm_scoring.pairs(flat, rows, 5, size), return_inverse=True)
    seen = np.where(rng.random(len(keys)) < 0.5, 0, rng.integers(1, 3, len(keys))) * (count[keys // size] > 0)
    got = machine.score(machine.compile(keys, seen), steps, rows, len(texts))
    arcs = {int(k): int(n) for k, n in zip(keys, seen) if n}
    for text, score in zip(texts, got):
        state, want = 5, 0.0
        for token in text:
            base = (max(count[token] - 0.5, 0) + 0.5 * 5 / 6) / 25
            left = max(1 - takes[state] / count[state], 1e-12) if count[state] else 1.0
            own = arcs.get(state * size + token)
            want += math.log10(left * base if own is None else (own - 0.5) / count[state] + left * base)
            state = token
        assert score == pytest.approx(want)
