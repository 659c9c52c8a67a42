"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import near_dedup


def shingle_set(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def kept(texts):
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if similar(sets[i], sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(i for i in ids if root(i) == i)


def made(r, n, words=120):
    return [f"w{r.randrange(5000)}" for _ in range(n or words)]


def test_similar_texts_go(spark, smallest):
    r, texts = random.Random(7), {}
    for i in range(60):  # copies with one to eight words changed: similarities from 0.5 to 0.96
        words = made(r, r.choice([12, 40, 120, 300]))
        texts[10 * i] = " ".join(words)
        for k in range(1, 5):
            copy = list(words)
            for at in r.sample(range(len(copy)), min(len(copy) // 12 + 1, r.randrange(1, 5))):
                copy[at] = f"x{r.randrange(5000)}"
            texts[10 * i + k] = " ".join(copy).upper() if k == 3 else " ".join(copy)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(x.doc_id for x in corpus_pipeline.near(spark, docs, smallest).collect()) == kept(texts)


def test_given_texts(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert sorted(x.doc_id for x in corpus_pipeline.near(spark, docs, smallest).collect()) == kept(texts)


def test_blocks_of_a_key_meet(spark):
    """A cloud of texts around one, few of them similar to any single other: in blocks of a few sets the result is the same."""
    r, base = random.Random(9), made(random.Random(8), 150)
    texts = {}
    for i in range(120):
        copy = list(base)
        for at in r.sample(range(150), r.randrange(2, 12)):
            copy[at] = f"x{r.randrange(30)}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    few = near_dedup.Parameters(block_sets=4, block_shingles=2000)
    assert sorted(x.doc_id for x in near_dedup.keep_one(docs, few).collect()) == kept(texts)


def cloud(r, n, words=150):
    base = made(random.Random(8), words)
    texts = {}
    for i in range(n):
        copy = list(base)
        for at in r.sample(range(words), r.randrange(2, 12)):
            copy[at] = f"x{r.randrange(30)}"
        texts[i] = " ".join(copy)
    return texts


def test_fingerprints_of_the_stage(spark):
    """A bit is 1 if it is set in over half of the hashes of the distinct shingles; repeats, upper case and blanks do not count."""
    texts = {1: " ".join(made(random.Random(3), 80)), 2: "one two three", 3: "", 4: None, 5: "a b c d e " * 9}
    texts |= {6: texts[1].upper().replace(" ", "\n "), 7: "a b c d e " * 30}
    docs = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "__id long, __text long, text string")
    got = {x["__id"]: x.fp % (1 << 64) for x in near_dedup.sketch(docs, near_dedup.Parameters()).collect()}
    for i, t in texts.items():
        data = np.frombuffer((t or "").encode(), np.uint8)
        hashes = near_dedup.shingles(data, np.array([0, len(data)]), 5)[0].tolist()
        assert len(hashes) == len(shingle_set(t))
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got[1] == got[6] and got[5] == got[7] and got[3] == got[4] == 0


def test_tables_list_pairs_by_fingerprints(spark):
    """Of each table: every member with the nearest before it and with the first, within reach; several tables of a key share the first."""
    r, rows, p = random.Random(5), [], near_dedup.Parameters(reach=12)
    for key in range(40):
        centre = r.getrandbits(64)
        for sig in sorted(r.sample(range(-500, 500), r.choice([2, 3, 30, 400]))):
            rows.append((key, sig, r.choice([8, 10, 100]), centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 14)))))
    low = {k: min(s for q, s, *_ in rows if q == k) for k in range(40)}
    signed = [(k, s, n, f - (1 << 64) if f >> 63 else f, low[k], 1 + k % 3) for k, s, n, f in rows]
    held = spark.createDataFrame(signed, "key long, sig long, n long, fp long, a long, tables long")
    dealt = held.withColumn("own", F.pmod(F.xxhash64("sig"), "tables")).collect()
    want_near, want_first, fp = set(), set(), {(k, s): (n, f) for k, s, n, f in rows}
    for key in range(40):
        for t in range(1 + key % 3):
            members = sorted(x.sig for x in dealt if x.key == key and (x.sig == x.a or x.own == t))
            for i, b in enumerate(members):
                (n, f) = fp[key, b]
                within = [((f ^ fp[key, a][1]).bit_count(), at, a) for at, a in enumerate(members[:i]) if (f ^ fp[key, a][1]).bit_count() <= 12 and 10 * min(n, fp[key, a][0]) >= 8 * max(n, fp[key, a][0])]
                want_near |= {(min(within)[2], b)} if within else set()
                want_first |= {(a, b) for _, at, a in within if at == 0}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_a_batch in ("7", before):  # tables that go on over batches, too
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
            got = [tuple(x) for x in near_dedup.listed(held, p).collect()]
            assert len(got) == len(set(got)) and set(got) == want_near | want_first and want_near - want_first and want_first - want_near
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("reach", [0, 16, 64])
def test_no_reach_loses_a_link(spark, reach):
    """What the tables do not list is compared all the same."""
    texts = cloud(random.Random(9), 120) | {500 + i: t for i, t in enumerate(["", "a b", "A  b", "c d e f g h i j"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    own = near_dedup.Parameters(reach=reach, block_sets=7)
    assert sorted(x.doc_id for x in near_dedup.keep_one(docs, own).collect()) == kept({k: t for k, t in texts.items()})
