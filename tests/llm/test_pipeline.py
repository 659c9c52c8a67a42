"""The stages in turn, each against a plain version of what it does to the rows that it gets."""

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import test_line_dedup
import test_models
import test_near_dedup
from test_packing import check

import __spark_entry__
from llm.common import SpanHash, mix
from llm.quality_rules import _MULTIPLIERS, BUCKETS, Parameters


@pytest.fixture(scope="module")
def outputs(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], smallest), "test"))
    return out


def test_columns_and_sizes(outputs):
    docs = outputs[0]
    sizes = [x.count() for x in outputs]
    assert all(x.columns == docs.columns for x in outputs[:5]) and sizes[:5] == sorted(sizes[:5], reverse=True) and sizes[4] > 0.5 * sizes[0]
    assert all(len(r.text or "") == r.n_chars for x in outputs[2:5] for r in x.collect())


def test_nothing_repeats_before_packing(outputs):
    texts = [(r.text or "").encode() for r in outputs[4].collect()]
    assert len(texts) == len(set(texts))


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_quality_stage(spark, smallest, outputs):
    """Base rules by their definition; scores from plain counts of n-grams in their buckets."""
    texts, p = texts_of(outputs[0]), Parameters()
    trusted = {r.doc_id for r in spark.read.parquet(f"{smallest}/labels.parquet").collect() if r.quality == 1}
    hash_of = {}

    def grams(text):
        words = [w.encode() for w in test_models.WORD.findall(text or "")]
        for w in set(words) - hash_of.keys():
            hash_of[w] = SpanHash(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0]
        pair = lambda a, b: int(mix(np.array([hash_of[a] * _MULTIPLIERS[0] + hash_of[b] * _MULTIPLIERS[1]]))[0]) >> 48
        with np.errstate(over="ignore"):
            return [int(hash_of[w]) >> 48 for w in words] + [pair(a, b) for a, b in zip(words, words[1:])]

    own = {k: grams(t) for k, t in texts.items()}
    raw, target = Counter(g for x in own.values() for g in x), Counter(g for k, x in own.items() if k in trusted for g in x)
    all_raw, all_target = sum(raw.values()) + BUCKETS, sum(target.values()) + p.prior
    ratio = lambda g: math.log((target[g] + p.prior * (raw[g] + 1) / all_raw) / all_target) - math.log((raw[g] + 1) / all_raw)
    want = set()
    for k, t in texts.items():
        n, _, _, _, repeated = test_models.base(t)
        if n >= p.min_words and 100 * repeated <= p.max_repeat_percent * n and sum(map(ratio, own[k])) / len(own[k]) >= p.min_score:
            want.add(k)
    assert texts_of(outputs[1]).keys() == want and len(want) < len(texts)


def test_line_stage(outputs):
    found = test_line_dedup.brute([(k, t) for k, t in texts_of(outputs[1]).items()])
    want = {}
    for (k, text), (lines, gone) in found.items():
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
        if not gone or left.strip():
            want[k] = left
    assert texts_of(outputs[2]) == want


def test_near_stage(outputs):
    assert sorted(texts_of(outputs[3])) == test_near_dedup.kept(texts_of(outputs[2]))


def test_passage_stage(outputs):
    """Bytes of repeated strings of 250 bytes go, and repeated runs of 51 words with what is between their words."""
    texts = {k: (t or "").encode() for k, t in texts_of(outputs[3]).items()}
    seen = Counter(t[i : i + 250] for t in texts.values() for i in range(len(t) - 249))
    words = {k: [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for k, t in texts.items()}
    runs = Counter(tuple(x[2] for x in w[i : i + 51]) for w in words.values() for i in range(len(w) - 50))
    want = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 249):
            if seen[t[i : i + 250]] > 1:
                gone[i : i + 250] = True
        for i in range(len(words[k]) - 50):
            if runs[tuple(x[2] for x in words[k][i : i + 51])] > 1:
                gone[words[k][i][0] : words[k][i + 50][1]] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any() or left.strip():
            want[k] = left
    got = {k: t or "" for k, t in texts_of(outputs[4]).items()}
    assert got == want and sum(len(t) for t in want.values()) < sum(len(t.decode()) for t in texts.values())


def test_packing_is_whole(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[4].collect()]
    assert check(rows, outputs[5].collect())[0] == 0


def test_registered(spark, smallest, outputs):
    q = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in q if x.startswith("op")} and q["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, smallest).count() == outputs[5].count()


def test_odd_rows(spark, smallest):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a few words only", None, "s", 16), (3, "a few words only", None, "s", 16), (None, "no id " * 20, "en", None, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, smallest)
        assert out.count() >= 0
        assert stage(spark, docs.where("doc_id < 0"), smallest).count() == 0


def test_extra_columns_of_any_name(spark):
    """Helper columns of the stages, and names that differ from the stages' own in case only, come back unchanged."""
    from llm import line_dedup, near_dedup, quality_rules, simhash_dedup, suffix_dedup

    r = np.random.default_rng(1)
    words = [f"word{i}" for i in range(500)]
    texts = ["\n".join(" ".join(r.choice(words, 9)) for _ in range(12)) for _ in range(8)]
    texts += [texts[0], texts[1] + "\nand more", None]
    names = ["__id", "__text", "__tie", "__runs", "__word_runs", "__lines", "id", "key", "hashes", "TEXT", "column_3"]
    rows = [(i, t, *(f"{n} {i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1), (2, 1), (4, 0)], "doc_id long, quality int")
    for stage in (lambda d: quality_rules.keep_good(d, labels, Parameters(min_score=-9.0)), line_dedup.remove_lines, near_dedup.keep_one, simhash_dedup.keep_one, suffix_dedup.remove_repeats, lambda d: suffix_dedup.remove_repeats(d, 250, 51)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = [tuple(x) for x in out.collect()]
        assert got and all(list(x[2:]) == [f"{n} {x[0]}" for n in names] for x in got)


def test_no_tables_stay_in_the_catalog(spark, outputs):
    assert outputs and not [t for t in spark.catalog.listTables() if not t.isTemporary]
