"""Documents of settings, entities, tokens, candidate paths, order by names, batches without samples."""

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from trajlake import sinks, sources
from trajlake.functions import text as tx
from trajlake.functions.tokens import tokenized
from trajlake.operators import batches, lookups, negatives, ranking

FIELDS = "min array<double>, max array<double>"


def test_json_and_yaml_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.json").write_text(json.dumps({"one": {"min": [1.0, 2.0], "max": [3, 4], "n": 7}}, indent=2))
    (tmp_path / "b.yaml").write_text("two:\n  min: [0.5]\n  max:\n    - 1\n  note: |\n    several\n    lines\nthree: {min: [], max: [2.5e+3]}\n")
    entries = sources.read_entries(spark, str(tmp_path), FIELDS)
    got = {r["name"]: (r["min"], r["max"]) for r in entries.collect()}
    assert got == {"one": ([1.0, 2.0], [3.0, 4.0]), "two": ([0.5], [1.0]), "three": ([], [2500.0])}
    assert sources.read_entries(spark, f"{tmp_path}/none", FIELDS).count() == 0


def test_entries_are_joined_and_may_not_lack(spark, tmp_path):
    path, name = f"{tmp_path}/doc", 'a "quoted" \\ name'
    stats = spark.createDataFrame([(name, [1.0], [2.0]), ("b", [0.0], [9.0])], "name string, min array<double>, max array<double>")
    sinks.write_document(stats.where("name = 'b'"), "name", path)
    sinks.write_document(stats, "name", path)
    entries = sources.read_entries(spark, path, FIELDS)
    rows = spark.createDataFrame([(1, name), (2, "b"), (3, "b")], "k int, task string")
    got = {r.k: (r["min"], r["max"]) for r in sources.with_entry(rows, F.col("task"), entries, ["min", "max"]).collect()}
    assert got == {1: ([1.0], [2.0]), 2: ([0.0], [9.0]), 3: ([0.0], [9.0])}
    more = rows.unionByName(spark.createDataFrame([(4, "c")], "k int, task string"))
    with pytest.raises(Exception, match="no entry of c"):
        sources.with_entry(more, F.col("task"), entries, ["min"]).collect()
    assert sources.with_entry(more, F.col("task"), entries, ["min"], missing_ok=True).where("min is null").first().k == 4


def test_all_entities(spark):
    r, names = random.Random(1), sorted(html.entities.html5)
    made = ["".join(r.choice(["&", "&amp;", "&amp;amp;", "x", " ", ";", f"&{r.choice(names)}", f"&{r.choice(names).rstrip(';')}", f"&#{r.randrange(0, 9000)};", f"&#x{r.randrange(0, 1 << 21):x}", "&#150;", "é"]) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(i, made[i : i + 3]) for i in range(0, 300, 3)] + [(1000, []), (1001, ["plain", " line "])], "k int, ls array<string>")
    got = {x.k: x.ls for x in rows.select("k", tx.clean_lines(F.col("ls")).alias("ls")).collect()}
    for i in range(0, 300, 3):
        assert got[i] == [html.unescape(html.unescape(t)).strip() for t in made[i : i + 3]]
    assert got[1000] == [] and got[1001] == ["plain", "line"]
    assert spark.createDataFrame([(None,)], "ls array<string>").select(tx.clean_lines(F.col("ls")).alias("ls")).first().ls is None


@pytest.mark.parametrize("how", [None, "whitespace", "lower", "canonicalize"])
def test_tokens_of_a_vocabulary(spark, how):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = ["A  robot\tarm, picks_up &amp; places.", "", None, "word " * 50]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, t string, __mask string")
    plain = {"whitespace": lambda t: " ".join(t.split()), "lower": lambda t: " ".join(t.split()).lower(), "canonicalize": None, None: lambda t: t}[how]
    for length in (16, None):
        got = {r.k: (r.ids, r.mask) for r in tokenized(rows, "t", path, length, pad_id=49407, how=how).collect()}
        assert all(len(i) == len(m) and (length is None or len(i) == length) for i, m in got.values()) and got[1] == got[2]
        if plain:
            for i, t in enumerate(texts):
                clean = html.unescape(t or "") if how else t or ""
                ids = Tokenizer.from_file(path).encode(plain(clean)).ids[:length]
                assert got[i][0][: len(ids)] == ids and sum(got[i][1]) == len(ids) and set(got[i][0][len(ids) :]) <= {49407}
        else:
            assert got[0][0][: sum(got[0][1])] == Tokenizer.from_file(path).encode("a robot arm picks up places").ids[:length]
    with pytest.raises(ValueError):
        tokenized(rows, "t", path, how="other")


def test_first_of_three_paths(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, e string")
    files = spark.createDataFrame([("x/a",), ("y/a",), ("y/b",), ("y/b",), ("z/b",)], "path string")
    places = [F.concat(F.lit(f"{p}/"), "e") for p in "xyz"]
    assert {r.k: r.found for r in lookups.first_path(rows, ["k"], places, files).collect()} == {1: "x/a", 2: "y/b", 3: None}
    lengths = spark.createDataFrame([("a", 5)], "e string, n long")
    assert {r.k: r.n for r in lookups.with_length(rows, lengths, "e", "n", F.lit(-1)).collect()} == {1: 5, 2: -1, 3: -1}
    assert lookups.with_length(rows, lengths, "e", "n").where("n is null").count() == 2


def test_places_in_an_order_of_names(spark):
    r = random.Random(3)
    rows = [(r.choice(["clean", "randomized", None]), r.choice(["t2", "t10", "é", ""]), str(r.randrange(40))) for _ in range(500)]
    got = ranking.ordered_positions(spark.createDataFrame(rows, "s string, t string, e string").repartition(5), "s", "t", "e").collect()
    key = lambda x: (x[0] is not None, (x[0] or "").encode(), x[1].encode(), x[2].encode())
    assert [tuple(x)[:3] for x in sorted(got, key=lambda x: x.rn)] == sorted(rows, key=key) and sorted(x.rn for x in got) == list(range(500))


def test_empty_batches_and_free_dimensions(spark):
    rows = spark.createDataFrame([(0, 1, 5), (0, 2, None), (1, 3, None), (1, 4, None), (2, 5, 7)], "b int, k int, v int")
    assert sorted(map(tuple, batches.without_null(rows, "b", "v").collect()), key=str) == sorted([(0, 1, 5), (1, None, None), (2, 5, 7)], key=str)
    free = spark.createDataFrame([(4, [1, 9]), (3, [])], "n int, avoid array<int>").select(negatives.free_dims_of(F.col("n"), F.col("avoid")).alias("f"))
    assert sorted(x.f for x in free.collect()) == [[0, 1, 2], [0, 2, 3]]
