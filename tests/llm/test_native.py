"""URL filters against SQL, fingerprints against Python; both must run no Python on executors."""

import hashlib
import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from llm import fingerprints, queries, url_filters


@pytest.mark.parametrize("name", ["op4_url_filters", "op9_fingerprints"])
def test_plan_is_native(name, spark, smallest):
    plan = queries.queries()[name](spark, smallest)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rules_of_the_query(spark, smallest):
    got = sorted(map(tuple, queries.op4_url_filters(spark, smallest).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{smallest}/pages.parquet'")
    fields = ["page_id", "host", "path", "rule", "verdict"]
    assert got == sorted(con.execute(f"select {', '.join(fields)} from ({queries.oracle_sql()['op4_url_filters']})").fetchall())


def test_rule_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("", "", "block")], "host string, path string, verdict string")
    assert sorted(map(tuple, url_filters.judge(pages, rules.where("host = 'x'")).collect())) == [(1, "a.com", "/x", None, "allow"), (2, "", "", None, "allow")]
    assert sorted(map(tuple, url_filters.judge(pages, rules).collect())) == [(1, "a.com", "/x", None, "allow"), (2, "", "", "", "block")]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_verdicts_of_the_contract(spark, tmp_path):
    """Each rule's word, written out here from the contract and taken neither from the query nor from its SQL."""
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    hosts = ["com", "a.com", "example.com", "w.EXAMPLE.com", "net", "a.net", "example.net", "w.example.net", "myexample.net", "org", "a.org", "xnet"]
    urls = [f"http://{h}{p}" for h in hosts for p in ["", "/en/", "/en/7", "/en/71", "/de/", "/de/1", "/de/8", "/de/8x?q", "/de", "/es/1#a", "/x/de/8"]] + [None, "net/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op4_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [(i, *plain(u, rules)) for i, u in enumerate(urls)]
    assert {x[3:] for x in got} == {(h + p, v) for h, p, v in rules} | {(None, "allow")}


def test_nested_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "KEYS_PER_SWEEP", 20)
    r = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "com.com", "x", "example.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/ü", "/\U0010ffff", "/\U0010ffff/a"]
    rules = sorted({(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(25)})
    kept = {(h, p): max(v for a, b, v in rules if (a, b) == (h, p)) for h, p, _ in rules}
    rules_once = [(h, p, v) for (h, p), v in kept.items()]
    urls = [f"http://{r.choice(['', 'w.', 'W.q.'])}{r.choice(hosts).upper()}{r.choice(paths)}{r.choice(['', 'b', '/c', '?q=/a', '#a/b'])}" for _ in range(400)] + [None, "", "com/a", "://", "x://?a", "a://b://c", "http://com", "http://.com/a", "http://com./a", "http://b,a.com/a/b", "http://a,com/a", "http://com0/a", "http://a.com0/a", "http://" + "w." * 3000 + "a.com/a/" + "b" * 200_000, "http://a.com/a/\U0010ffff", "http://a.com/a/\U0010ffffx", "http://x/\U0010ffff\U0010ffff", "http://a.com/a\ud7ff"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(5, urls[5], "again")], "page_id long, url string, host string")
    got = sorted((tuple(x) for x in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()), key=str)
    assert got == sorted(((i, *plain(u, rules_once)) for i, u in [*enumerate(urls), (5, urls[5])]), key=str)
    assert url_filters.judge(pages.where("page_id < 0"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def plain_print(text):
    """The fingerprint by its definition, with one 64-bit hash after another."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    terms = list(zip(words, words[1:])) if len(words) > 1 else [(w,) for w in words]
    votes, total = [0] * 64, 0
    for term in terms:
        h = 42
        for part in term:
            h = xxhash.xxh64_intdigest(part.encode(), h)
        weight = min(4, 1 + sum(len(p.encode()) for p in term) // 8)
        total += weight
        for bit in range(64):
            votes[bit] += weight * (h >> bit & 1)
    return f"{sum(1 << b for b in range(64) if 2 * votes[b] > total):016x}"


def edits(rows):
    """What each row, in order, should give but for near_docs."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (k, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + nxt[:n]
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_print(text), plain_print(edited), like(plain_print(text), plain_print(edited)), like(plain_print(text), plain_print(nxt))))
    near = lambda p: sum((int(p, 16) ^ int(x[3], 16)).bit_count() <= 3 for x in out)
    return [(*x, near(x[3]) if x[0] is not None and x[0] % 20 == 0 else None) for x in out]


def hold(docs):
    got = sorted(map(tuple, fingerprints.fingerprint_edits(docs).collect()), key=str)
    want = sorted(edits([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]), key=str)
    assert [g[:5] + g[7:] for g in got] == [w[:5] + w[7:] for w in want]
    assert all(g[5:7] == pytest.approx(w[5:7]) for g, w in zip(got, want))
    return got


def test_edits_and_likeness(spark, smallest):
    got = hold(spark.read.parquet(f"{smallest}/documents.parquet"))
    assert sum(r[5] > r[6] for r in got) > 0.9 * len(got) and any(r[7] and r[7] > 1 for r in got)


def like(a, b):
    import math

    return max(0.0, math.cos(math.pi / 64 * (int(a, 16) ^ int(b, 16)).bit_count()))


def test_odd_rows(spark):
    one = spark.createDataFrame([(7, "only one here", "x")], "doc_id long, text string, next string")
    r = fingerprints.fingerprint_edits(one).first()
    assert (r.doc_id, r.n_chars) == (7, 13) and r.near_next == 1.0
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(40)] + [(100, ""), (101, "é🙂" * 9), (102, None), ((1 << 62) + 1, "a b c d e f g h i"), (-5, "below zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hold(docs)
    hold(docs.unionByName(docs).unionByName(docs.where("doc_id = 20")))
    assert fingerprints.fingerprint_edits(docs.where("doc_id < -9")).count() == 0


def test_many_rows_of_one_id(spark):
    """Equal ids are several ranges; among them the order is that of a hash, so only what does not depend on it is compared."""
    rows = [(None, f"no id {i} " * 3) for i in range(500)] + [(40, f"one id {i} and more") for i in range(500)] + [(7, "same text in all of these")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert fingerprints.in_order(docs).select("part").distinct().count() == 4
    got = fingerprints.fingerprint_edits(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.fingerprint) for r in got) == sorted((str(k), len(t), plain_print(t)) for k, t in rows)
    assert sum(r.doc_id == 7 and r.near_next == 1.0 for r in got) == 299


def test_votes(spark):
    """The sums of lanes against one by one."""
    r = random.Random(2)
    pairs = [(r.getrandbits(64) - (1 << 63), r.randrange(1, 5)) for _ in range(500)]
    got = spark.createDataFrame(pairs, "h long, w long").agg(*fingerprints.vote_sums()).select(fingerprints.signs().alias("fp")).first().fp
    total = sum(w for _, w in pairs)
    want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in pairs if h >> b & 1) > total)
    assert got % (1 << 64) == want


def test_search_finds_all_within_the_radius(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) - (1 << 63) for _ in range(200)]
    near = [f ^ sum(1 << b for b in r.sample(range(63), r.randrange(0, 6))) for f in fps[:100]]
    frame = spark.createDataFrame([(f,) for f in fps + near], "fp long")
    asked = frame.select(F.col("fp").alias("query")).limit(150)
    got = {(x.query, x.fp, x.distance) for x in fingerprints.within(frame, asked, 3).collect()}
    want = {(q.query, f, ((q.query ^ f) % (1 << 64)).bit_count()) for q in asked.collect() for f in set(fps + near)}
    assert got == {x for x in want if x[2] <= 3}
