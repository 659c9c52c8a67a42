"""Texts of megabytes, and single words of megabytes, go through every operator whole."""

import hashlib
import random

import public_tokenizers as P
import pytest

from llm import bpe, fingerprints, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(20_000)]
    long = " ".join(r.choice(words) + ("\n" if r.random() < 0.05 else "") for _ in range(400_000))
    rows = [(1, long), (2, long[:1_000_000] + "x" + long[1_000_000:]), (3, "a" * 1_000_000), (4, "short"), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_exact_ones(docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    cut = by_id(suffix_dedup.repeated_bytes(docs))
    # at 1,000,000 a letter came in: every string but those over it is in both
    assert cut[1].n_removed == cut[1].n_bytes and cut[2].n_removed == cut[2].n_bytes - 1 and cut[2].n_spans == 2 and cut[3].n_removed == 1_000_000 and cut[4].n_removed == 0
    coded = by_id(bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken")))
    assert all(coded[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in text.items())
    packed = packing.pack(docs, P.path("byte_bpe_50k.json")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id: r["sum(length)"] for r in packed} == {i: coded[i].n_tokens + 1 for i in text} == {r.doc_id: r["max(doc_tokens)"] for r in packed}
    prints = by_id(fingerprints.fingerprint_edits(docs))
    assert all(prints[i].n_chars == len(t) for i, t in text.items()) and prints[1].near_next > 0.99


def test_others(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    assert by_id(quality_rules.score_documents(docs, labels))[1].n_words == 400_000
    assert quality_classifier.score_documents(docs, labels).count() == 5
    near = by_id(simhash_dedup.near_groups(docs))
    assert near[1].component_id == near[2].component_id == 1
    lines = by_id(line_dedup.deleted_lines(docs))
    assert lines[1].n_deleted == 0 and lines[2].n_deleted > 0.9 * lines[2].n_lines
    scored = by_id(lm_scoring.score_documents(docs))
    assert scored[1].n_tokens == 400_001 and all(r.score < 0 for r in scored.values())
