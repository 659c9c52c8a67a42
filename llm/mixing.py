"""Mixing sources to target weights by capped water-filling.  DataFrame functions only.

Targets.  Every source gets words in proportion to its weight, but no more than `epochs` times what it has; what is cut off goes to the
others by weight, till none is above.  In order of capacity by weight the clamped sources come first, so with the capacities before and
the weights from a source on as running sums, the level at which the rest is shared is the greatest of (total - capacities before) /
(weights from here on): clamping one more raises the level as long as that one was above its capacity, and lowers it after.

Sampling.  A source's target is a number of whole repetitions of all its documents and a rest in words.  The documents of a source stand
in the order of a seeded draw, a hash of seed, doc_id and text; those within the first words of that order, as many as the rest, are
taken once more, the one on which the limit falls by its first words only.  So each source's words come to its target, rounded to whole
words, and reruns agree on any cluster.

The order of a large source is no task: draws are cut into ranges, running sums are taken within (source, range), and moved up by the sums
of the ranges before.  Rows of equal source, doc_id, text and size are combined first, with their number.  Texts are read once, for size
and draw; what moves is a few numbers for each row.  The table of sources has one row for each; its windows are one task.

Defined results: null texts have size 0 and are taken with 0 words; a source without words has target 0; null is a source of its own,
the last; repeated rows are taken each; texts of any length count whole; extra columns are ignored by `mix` and kept by `mixture`; an empty
table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import materialize, partitions

BLANKS, BREAK = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
DRAWS = float(1 << 60)
ROWS_PER_RANGE = 20_000


@dataclass(frozen=True)
class Parameters:
    #: Weights of the sources in order of name, used again from the first when there are more sources.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: Words of the mix for each word of all sources.
    share: float = 1.5
    epochs: float = 2.0
    seed: int = 11


def n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare != "", F.size(F.split(bare, BREAK))).otherwise(0).cast("long")


def draw(seed: int) -> Column:
    """60 bits of a hash of seed, doc_id and text."""
    parts = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("long")


SOURCE = ["unnamed", "source"]  #: null is "" with unnamed; their order is that of the sources


def _source() -> list[Column]:
    return [F.col("source").isNull().alias("unnamed"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")]


def rows_of(documents: DataFrame, p: Parameters) -> DataFrame:
    """unnamed, source, doc_id, draw, size and the number of equal rows (copies)."""
    rows = documents.select(*_source(), F.col("doc_id").cast("long").alias("doc_id"), draw(p.seed).alias("draw"), n_words(F.col("text")).alias("size"))
    return rows.groupBy(*SOURCE, "doc_id", "draw", "size").agg(F.count("*").alias("copies"))


def weighted(sizes: DataFrame, p: Parameters) -> DataFrame:
    """Adds the weights, by the place of a source in order of name."""
    place = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    return sizes.withColumn("weight", F.get(F.array(*map(F.lit, p.weights)), (place % len(p.weights)).cast("int")))


def targets(sizes: DataFrame, p: Parameters) -> DataFrame:
    """Adds target to rows of unnamed, source, source_size and weight, one for each source."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), *SOURCE)
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.col("source_size").cast("double")
    before = p.epochs * (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = sizes.withColumn("level", (p.share * F.sum(size).over(all_) - before) / after)
    full = level.withColumn("target", F.least(p.epochs * size, F.max("level").over(all_) * F.col("weight")))
    return full.drop("level", "weight")


def mix(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, draw, size, unnamed, source, source_size, target, repeats (whole repetitions), start, rest, copies: one row for each document,
    equal ones once.  Words are taken once more as far as start, the place of the first copy's first word in its source's order, and those
    after it lie below rest."""
    rows = materialize(rows_of(documents, p), "sizes")
    sizes = rows.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    plan = targets(weighted(sizes, p), p).withColumn("budget", budget).withColumn("repeats", whole).withColumn("rest", F.col("budget") - F.col("repeats") * F.col("source_size")).drop("budget")
    plan = materialize(plan, "targets")
    total = rows.agg(F.count("*")).first()[0]
    ranges = max(1 + total // ROWS_PER_RANGE, 4 * partitions(documents.sparkSession))
    cut = rows.withColumn("range", F.floor(F.col("draw") / DRAWS * ranges).cast("int"))
    words = F.col("size") * F.col("copies")
    sums = cut.groupBy(*SOURCE, "range").agg(F.sum(words).alias("own"))
    upto = Window.partitionBy(*SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range, not for each document
    info = sums.withColumn("before", F.sum("own").over(upto) - F.col("own")).drop("own").join(plan, SOURCE)
    inside = Window.partitionBy(*SOURCE, "range").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("inside", F.sum(words).over(inside) - words).join(info, [*SOURCE, "range"])
    return placed.select("doc_id", "draw", "size", *SOURCE, "source_size", "target", "repeats", (F.col("before") + F.col("inside")).alias("start"), "rest", "copies")


def taken_words(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    each = mix(documents, p).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("copy") * F.col("size")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size") + more).alias("taken"))


def mixture(documents: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The mix itself: each document as often as it is taken, a partial repetition with its first words joined by one space.  All columns
    are kept; rows equal in source, doc_id and text come with the other columns of one of them.  Documents without words are left out."""
    key = ["unnamed", "source", "no_id", "id", "draw", "size"]
    id_ = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id")]
    rows = documents.select(*_source(), *id_, draw(p.seed).alias("draw"), n_words(F.col("text")).alias("size"), F.struct(*documents.columns).alias("row"))
    one = rows.where("size > 0").groupBy(*key).agg(F.first("row").alias("row"))
    extra = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0).cast("long")), F.col("size") * F.col("copies")).alias("extra")
    plan = mix(documents, p).where("size > 0").select(*SOURCE, *id_, "draw", "size", "copies", "repeats", extra)
    met = one.join(plan, key)
    whole = F.expr("cast(repeats * copies + extra div size as int)")
    turns = F.concat(F.array_repeat("size", whole), F.expr("if(extra % size > 0, array(extra % size), array())"))
    words = F.slice(F.split(F.btrim(F.col("row.text"), F.lit(BLANKS)), BREAK), F.lit(1), F.col("turn").cast("int"))
    text = F.when(F.col("turn") < F.col("size"), F.array_join(words, " ")).otherwise(F.col("row.text"))
    each = met.withColumn("turn", F.explode(turns))
    return each.select(*(text.alias(n) if n == "text" else F.col("row")[n].alias(n) for n in documents.columns))
