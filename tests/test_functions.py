"""Column functions and operators on small made-up rows."""

import math

import pytest

from pyspark.sql import functions as F

from trajlake.functions import geometry, schedules, text, vectors
from trajlake.functions.keyed import draw
from trajlake.operators import lookups, negatives, ranking, sampling, statistics, windows
from trajlake.operators.windows import Spec


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def array(*x):
    return F.array(*map(F.lit, x))


def test_vectors(spark):
    r = one(spark, vectors.has_equal_neighbours(array(1, 2, 2)), vectors.has_equal_neighbours(array(1)), vectors.has_equal_neighbours(array(1, 2, 1)), vectors.pad(array(1, 2, 3), 2, F.lit(0)), vectors.pad(array(1), 3, F.lit(0)), vectors.normalise(F.lit(5.0), F.lit(3.0), F.lit(3.0)), vectors.swap(array(1, 2, 3), F.lit(0), F.lit(2)), vectors.valid_only(array(1, 2), array(True)), vectors.valid_only(array(1, 2), array(False, True)))
    assert list(r) == [True, False, False, [1, 2], [1, 0, 0], 2.0, [3, 2, 1], None, [2]]


def test_bounds_pass_nan(spark):
    r = one(spark, vectors.within_bounds(F.array(array(1.0, float("nan"))), 4.0), vectors.within_bounds(F.array(array(4.0)), 4.0), vectors.within_bounds(F.array(array(-4.1)), 4.0))
    assert list(r) == [True, True, False]


def test_dimensions(spark):
    r = one(spark, vectors.to_two_dimensions(1, array(1, 2)), vectors.to_two_dimensions(3, F.array(F.array(array(1), array(2)), F.array(array(3)))), vectors.squeeze(F.array(array(1))))
    assert list(r) == [[[1, 2]], [[1], [2], [3]], [1]]


def test_negative_matrices(spark):
    m = F.array(*(array(*(float(10 * t + d) for d in range(8))) for t in range(4)))
    r = one(spark, negatives.flip(m), negatives.joint_swap(m, 4, 2, F.lit(1), avoid=(0, 1)), negatives.half_noise(m, 4, F.lit(1)), negatives.time_swap(m, 4, F.lit(5)))
    assert r[0][1] == [10, 11, 12, 13, 14, 15, -16, 17] and r[1][3][7] == 37
    assert r[2][1] == [float(10 + d) for d in range(8)] and all(a != b for a, b in zip(r[2][2], [20 + d for d in range(8)]))
    assert sorted(r[3]) == [[float(10 * t + d) for d in range(8)] for t in range(4)]


def test_text(spark):
    r = one(spark, text.canonical(F.lit("A_b,  C!")), text.clean(F.lit(" &amp;lt;x&amp;gt; ")), text.integers(F.lit("6, ,13")), text.boolean(F.lit("Yes")), text.mode_name(F.lit(" Random-Start ")), text.number(F.lit(" 1e-5 ")), text.kept_lines(F.lit("a\n \n\nb")), text.lines(F.lit("a\n \n\nb")), text.stem(F.lit("x/y.z/ep1.pt")), text.padded("episode_", F.lit(7), 6))
    assert list(r) == ["a b c", "<x>", [6, 13], True, "random_start", 1e-5, ["a", " ", "b"], ["a", "b"], "ep1", "episode_000007"]


def test_instruction_shapes(spark):
    shapes = {'[{"caption": "x"}]': ["x"], '[{"caption": ["x", "y"]}]': ["x", "y"], '["x", "y"]': ["x", "y"], '{"captions": ["x"]}': ["x"], '{"caption": "x"}': ["x"], '{"caption": ["x", "y"]}': ["x", "y"], '{"seen": ["z"]}': ["z"], '{"other": 1}': []}
    frame = spark.createDataFrame([(k,) for k in shapes], "j string")
    assert {r.j: r.t for r in frame.select("j", text.instruction_texts(F.col("j")).alias("t")).collect()} == shapes


def test_schedules(spark):
    r = one(spark, schedules.sigmoid(F.lit(0.0)), schedules.logit_loss(F.lit(100.0), F.lit(0.0)), schedules.to_byte(F.lit(2.0)), schedules.sinusoid(F.lit(0.0), 4), schedules.interpolated_shift(F.lit(256.0)), schedules.shifted(schedules.even_sigma(F.lit(0), F.lit(10)), 5.0), schedules.relative_bucket(F.lit(-500)), schedules.relative_bucket(F.lit(3)))
    assert list(r) == [0.5, 100.0, 255, [1.0, 1.0, 0.0, 0.0], 0.5, 1.0, 15, 19]


def test_geometry(spark):
    r = one(spark, *geometry.letterbox(F.lit(240), F.lit(320), 384, 320).values(), geometry.sequence_length(F.lit(3), F.lit(10), F.lit(10), (2, 2), 4), geometry.to_multiple(F.lit(42), 28))
    assert list(r) == [240, 320, 72, 0, 76, 56]


def lengths(spark, *n):
    return spark.createDataFrame(list(enumerate(n)), "user_id long, n long")


def test_feasible_starts(spark):
    s = Spec(frames=8, ratio=4, stride=2)
    got = [r.m for r in lengths(spark, 16, 17, 18).orderBy("user_id").select(windows.greatest_start(F.col("n"), s).alias("m")).collect()]
    assert got == [None, 0, 1]
    assert {r[0] for r in lengths(spark, 50).select(windows.greatest_start(F.col("n"), Spec(1, 4, 1))).collect()} == {None}


def test_short_episodes(spark):
    s = Spec(frames=2, ratio=2, stride=2)
    got = [r.action_idx for r in windows.strict(lengths(spark, 3), s).orderBy("pos").collect()]
    assert got == [2, 2, 2, 2]
    assert windows.tail_padding(lengths(spark, 3), s).count() == 0
    filled = windows.random_strict_fill(lengths(spark, 3), s).collect()
    assert all(r.fallback and r.c == 0 for r in filled) and len(filled) == 4
    assert windows.latent(lengths(spark, 2), 2, 1).count() == 0 and windows.tiled(lengths(spark, 0), s).count() == 0


def test_source_lengths(spark):
    def count(size):
        rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(size)).alias("idx"))
        return [r.s for r in windows.source_slices(rows, "idx").orderBy("s").collect()]

    assert count(31) == [] and count(63) == [15, 31] and count(64) == [15, 31, 47] and count(80) == [15, 31, 47, 63]


def test_uniform_starts(spark):
    got = spark.range(20_000).select((draw(7, "x", F.col("id")) % 10).alias("d")).groupBy("d").count().collect()
    assert len(got) == 10 and all(abs(r["count"] - 2000) < 250 for r in got)


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("tie"))
    got = ranking.positions(rows.unionByName(rows), F.col("x"), "tie").collect()
    assert sorted(r.rn for r in got) == list(range(2000)) and all(r.rn // 2 == r.x for r in got)
    assert ranking.positions(rows.where("x < 0"), F.col("x")).count() == 0


def test_merges(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, lookups.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, lookups.upsert(old, new, ["k"], insert=False).collect())) == [(1, "a"), (2, None)]
    assert sorted(map(tuple, lookups.override(old, new, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]


def test_nearest_at_bucket_edges(spark):
    points = spark.createDataFrame([(1, 10), (1, 100), (1, 55)], "g int, at long")
    events = spark.createDataFrame([(1, 0, 1), (1, 20, 2), (1, 111, 3), (2, 100, 4), (1, 45, 5), (1, 65, 6)], "g int, w long, id long")
    got = {r["at"]: (r.id, r.off) for r in lookups.nearest(points, events, "g", "at", "w", "id", 10, ["id"]).collect()}
    assert got == {10: (1, 10), 55: (5, 10)}


def test_merged_moments(spark):
    values = spark.createDataFrame([(i % 3, 0, float(i * i)) for i in range(20)], "label int, dim int, x double")
    a, b = statistics.moments(values, "dim").first(), statistics.merged_moments(statistics.partial_moments(values, "label", "dim"), "dim").first()
    assert a.n == b.n and math.isclose(a.mean, b.mean) and math.isclose(a.std, b.std)


def test_pairs_of_odd_pool(spark):
    got = negatives.pairs(spark.range(7).withColumnRenamed("id", "k"), "k").collect()
    assert len(got) == 6 and {(r.k, r.partner) for r in got} == {(r.partner, r.k) for r in got}
    rows = spark.range(10).select(F.col("id").alias("k"), (F.col("id") % 5).alias("task"))
    assert all(r.task != r.partner_task for r in negatives.pairs_across(rows, "k", "task").collect())


def test_each_pass_covers_all(spark):
    got = sampling.coverage(spark.range(10).withColumnRenamed("id", "k"), "k", 3, 5).collect()
    assert all(sorted(r.k for r in got if r["pass"] == p) == list(range(10)) for p in range(3))
    assert {r.batch_id for r in got} == set(range(6))


def test_layouts(spark):
    from trajlake.functions import layouts

    rows = spark.createDataFrame([(" ", "b", [1.0]), ("a", "b", [2.0])], "language_instruction string, task string, action array<double>")
    got = rows.select(layouts.language(rows.schema).alias("text"), layouts.first_column(rows.schema, layouts.STATE).alias("state")).collect()
    assert [(r.text, r.state) for r in got] == [("b", [1.0]), ("a", [2.0])]
    view = "observation.images."
    assert layouts.view_layout([view + n for n in ("cam_high", "cam_left_wrist", "cam_right_wrist")])[0] == "three"
    assert layouts.view_layout([view + "cam_concatenated", view + "cam_high"]) == ("joined", [view + "cam_concatenated"])
    assert layouts.view_layout([view + "top", view + "a", "state"]) == ("single", [view + "a"])


def test_full_batches_only(spark):
    pos = spark.range(7).select(F.col("id").alias("key"), F.col("id").alias("rn"))
    neg = spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("rn"))
    got = sampling.balanced(pos, neg, 3).collect()
    assert len(got) == 12 and all(sum(r.label for r in got if r.batch_id == b) == 3 for b in (0, 1))
    assert sorted(r.place for r in got if r.batch_id == 0) == list(range(6))


def fails(frame):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        frame.collect()


def test_strict_functions_fail(spark):
    from trajlake.functions import geometry, text, vectors
    from trajlake.operators import batches, lookups, records, windows

    row = spark.range(1)
    fails(row.select(*geometry.budget_size(F.lit(10_000), F.lit(10))))
    assert tuple(row.select(*geometry.budget_size(F.lit(2000), F.lit(10))).first())
    fails(row.select(vectors.squeeze(F.array(F.lit(1), F.lit(2)))))
    assert row.select(vectors.squeeze(F.array(F.lit(4)))).first()[0] == 4 and row.select(vectors.squeeze(F.lit(None).cast("array<int>"))).first()[0] is None
    fails(row.select(text.relative(F.lit("/b/x"), F.lit("/a"))))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    fails(batches.required(rows, "v"))
    assert batches.required(rows, "k").count() == 2
    frames = spark.createDataFrame([(1, 0, 5.0)], "user_id long, frame_idx long, value double")
    asked = spark.createDataFrame([(1, 0), (1, 3)], "user_id long, at long")
    fails(lookups.gather_strict(asked, frames, "at", ["value"]))
    assert lookups.gather_strict(asked.where("at = 0"), frames, "at", ["value"]).first().value == 5.0
    fails(row.select(records.strictly(F.lit(1.0), F.lit("a list"), F.lit("file"))))
    document = F.lit('{"a": {"low": [1.0, 2.0]}}')
    assert row.select(records.statistic(document, F.lit("a"), "low")).first()[0] == [1.0, 2.0] and row.select(records.statistic(F.lit(None).cast("string"), F.lit("a"), "low")).first()[0] is None
    fails(row.select(records.statistic(document, F.lit("b"), "low")))
    with pytest.raises(ValueError):
        windows.sample(rows, windows.Spec(2, 2, 2), "other")


def test_long_numbers_and_names(spark):
    from trajlake.functions import text
    from trajlake.operators import records

    row = spark.range(1)
    assert row.select(text.padded("e_", F.lit(1234567), 6)).first()[0] == "e_1234567"
    assert row.select(text.with_extension(F.lit("a.b/c.mp4"), ".pt"), text.with_extension(F.lit("a.b/c"), ".pt"), text.with_extension(F.lit("a/.hid"), ".pt")).first()[:] == ("a.b/c.pt", "a.b/c.pt", "a/.hid.pt")
    assert records.without_internal(row.selectExpr("1 as a", "2 as block_correct")).columns == ["a"]


def test_schedule_as_defined(spark):
    """Sigmas, timesteps and weights of ten steps, by plain arithmetic."""
    import math

    from pyspark.sql import Window

    from trajlake.functions import schedules as sch

    n, low, shift = 10, 0.003 / 1.002, 5.0
    even = [1 - i * (1 - low) / (n - 1) for i in range(n)]
    sigma = [shift * s / (1 + (shift - 1) * s) for s in even]
    bells = [math.exp(-2 * ((s * 1000 - n / 2) / n) ** 2) for s in sigma]
    want = [(b - min(bells)) * n / sum(x - min(bells) for x in bells) for b in bells]
    rows = spark.range(n).withColumn("sigma", sch.shifted(sch.even_sigma(F.col("id"), F.lit(n)), shift))
    got = rows.select("id", "sigma", sch.bell_weights(sch.bell(F.col("sigma") * 1000, F.lit(n)), F.lit(n), Window.partitionBy()).alias("w")).orderBy("id").collect()
    assert [r.sigma for r in got] == pytest.approx(sigma) and [r.w for r in got] == pytest.approx(want)
    mu = spark.range(1).select(sch.interpolated_shift(F.lit(8192.0)), sch.interpolated_shift(F.lit(256.0))).first()
    assert mu[:] == pytest.approx((0.9, 0.5))


def test_places_within_a_large_group(spark):
    from trajlake.operators.ranking import positions_within

    rows = [(1, i * 7 % 1000 // 3, i) for i in range(1000)] + [(None, i % 50, 5000 + i) for i in range(700)] + [(k, k, 9000 + k) for k in range(2, 20)]
    frame = spark.createDataFrame(rows, "g long, t long, e long").repartition(3)
    got = {r.e: r.rn for r in positions_within(frame, "g", F.col("t"), "e").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {e: i for i, (_, e) in enumerate(sorted((t, e) for k, t, e in rows if k == g))}
    assert got == want


def test_repair_and_blanks(spark):
    row = spark.range(1)
    texts = ["é è 中🙂", "plain", "caf\u00e9", "Ã©tÃ© and é", "\u00c2\u00a0x", "a" * 100_000 + "é"]
    for t in texts[:1] + texts[1:3] + texts[5:]:
        broken = t.encode().decode("latin-1")
        assert row.select(text.repaired(F.lit(broken))).first()[0] == t
    for t in ("caf\u00e9", "é", "Ã©tÃ© and é and 中", "\u00c2"):
        assert row.select(text.repaired(F.lit(t))).first()[0] == t
    assert row.select(text.collapse(F.lit(" a\u00a0\u2003b\x85c\u3000"))).first()[0] == "a b c"


@pytest.mark.parametrize("counts", [(6, 0, 0), (5, 3, 2), (9, 1, 2), (4, 4, 4), (1, 0, 0), (7, 8, 0), (11, 1, 1), (3, 3, 1)])
def test_matching_has_as_many_mixed_pairs_as_can_be(spark, counts):
    """All but one row are paired, both ways; two of a task meet only if other rows are used up."""
    from trajlake.operators.negatives import pairs_across

    for seed in (1, 2):
        rows = [(100 * t + i, None if t == 2 else f"task {t}") for t, n in enumerate(counts) for i in range(n)]
        task = dict(rows)
        got = pairs_across(spark.createDataFrame(rows, "k long, task string").repartition(3), "k", "task", seed).collect()
        partner = {r.k: r.partner for r in got}
        n, most = len(rows), max(counts)
        assert len(got) == len(partner) == n - n % 2 and all(partner[p] == k != p for k, p in partner.items())
        assert all((r.task, r.partner_task) == (task[r.k], task[r.partner]) for r in got)
        mixed = sum(r.task != r.partner_task for r in got) // 2
        assert mixed >= min(n // 2, n - most) - (n % 2)


def test_strip_and_lines(spark):
    """Every kind of white space goes, at the ends of a text and of its lines."""
    from trajlake.functions import text as tx

    cases = ["a\n\t\n b\r\n ", "\x1c x  ", "\x85\n　", "", "one", "\r\n\r\n a​b \x0b", " ﻿"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k int, t string")
    got = {r.k: (r.s, r.ls) for r in rows.select("k", tx.strip(F.col("t")).alias("s"), tx.lines(F.col("t")).alias("ls")).collect()}
    assert got == {i: (c.strip(), [x.strip() for x in c.strip().split("\n") if x.strip()]) for i, c in enumerate(cases)}
    held = rows.where("k = 0").select(tx.lines_or_fail(F.col("t"), F.col("k")).alias("ls"))
    assert held.first().ls == ["a", "b"]
    with pytest.raises(Exception, match="no line in 2"):
        rows.where("k = 2").select(tx.lines_or_fail(F.col("t"), F.col("k")).alias("ls")).collect()
    assert [r.m for r in spark.sql("select '\t Fast-Mode ' as m").select(tx.mode_name(F.col("m")).alias("m")).collect()] == ["fast_mode"]


def test_first_sight(spark):
    from trajlake.operators.batches import first_sight

    rows = spark.createDataFrame([(1, 0, "b"), (1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 0, "x")], "g int, at int, name string").repartition(3)
    assert {r.g: r["keys"] for r in first_sight(rows, "g", "name", ["at"], ("x", "y")).collect()} == {1: ["x", "y", "b", "a"], 2: ["x", "y"]}
