"""Targets against clamping round by round, taken words against one pass in order of the draw."""

import hashlib
import random
import re
from collections import Counter

from llm import mixing, queries
from llm.mixing import Parameters, mixture, taken_words


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def clamped(sizes, p):
    """Shares by weight; what is above its limit is clamped and the excess shared anew, till nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(names)}
    done, left = {}, p.share * sum(sizes.values())
    while len(done) < len(names):
        free = [s for s in names if s not in done]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > p.epochs * sizes[s]]
        if not over:
            return done | share
        for s in over:
            done[s] = p.epochs * sizes[s]
            left -= done[s]
    return done


def brute(rows, p=Parameters()):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    aims, out = clamped(sizes, p), []
    for s in sizes:
        budget = int(aims[s] + 0.5)
        whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        own = [r for r in rows if r[2] == s]
        key = lambda r: (int(hashlib.md5(f"{p.seed}:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, size(r[1]))
        for d, text, _ in sorted(own, key=key):
            n = size(text)
            out.append((d, n, sizes[s], round(aims[s], 3), whole * n + min(n, max(rest, 0))))
            rest -= n
    return out


def made(n):
    r = random.Random(4)
    rows = [(i if i % 17 else None, " ".join(r.choice(["a", "bb", "ü", "\t"]) for _ in range(r.randrange(0, 30))) if i % 13 else None, r.choice(["hot"] * 6 + ["b", "B", "ä", "", None])) for i in range(n)]
    return [*rows, *[(None, "one text of an unnamed row", "hot")] * 40, (7, "", "no words"), (8, None, "no words"), (9, "x" * 100_000 + " " + "w " * 50_000, "long")]


SCHEMA = "doc_id long, text string, source string"


def hold(docs, rows, p=Parameters()):
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in taken_words(docs, p).collect()]
    assert Counter(got) == Counter(brute(rows, p))
    assert all(0 <= words <= p.epochs * n for _, n, _, _, words in got)


def test_against_rounds_of_clamping(spark):
    rows = made(300)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for p in (Parameters(), Parameters(share=1.9), Parameters(share=2.0), Parameters(weights=(1.0, 50.0), share=0.7), Parameters(seed=5)):
        hold(docs, rows, p)


def test_words_of_a_source_come_to_its_target(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    hold(docs, rows)
    got = queries.op11_mixing(spark, smallest).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target").sum("taken").collect()
    assert got and all(abs(r["sum(taken)"] - r.target) <= 0.5 for r in got)


def test_mixture_has_the_words(spark):
    rows = made(150)
    docs = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], SCHEMA + ", draw long, id string").repartition(3)
    out = mixture(docs)
    assert out.columns == docs.columns
    words, want = Counter(), Counter()
    for r in out.collect():
        words[r.doc_id, r.source] += size(r.text)
    for (d, text, s), got in zip(rows, _in_order(rows, brute(rows))):
        want[d, s] += got
    assert +want == words
    assert mixture(docs.where("doc_id < 0")).count() == 0


def _in_order(rows, found):
    """The taken words of rows, in their order; of equal rows any."""
    held = {}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    by_source = {}
    for s in sizes:
        own = [r for r in rows if r[2] == s]
        key = lambda r: (int(hashlib.md5(f"{Parameters().seed}:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, size(r[1]))
        by_source[s] = sorted(own, key=key)
    at = iter(found)
    for s in sizes:
        for r in by_source[s]:
            held.setdefault(r, []).append(next(at)[4])
    return [held[r].pop() for r in rows]


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "three words here", None)], SCHEMA)
    assert [tuple(r) for r in taken_words(docs).collect()] == [(1, 3, 3, 4.5, 5)]
    assert taken_words(docs.where("doc_id = 2")).count() == 0
    assert [tuple(r) for r in taken_words(docs.withColumn("text", docs.text.substr(1, 0))).collect()] == [(1, 0, 0, 0.0, 0)]


def test_plan_is_native(spark, smallest):
    plan = queries.op11_mixing(spark, smallest)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert mixing.Parameters().epochs == 2.0
