"""SimHash document fingerprints and the search for near ones by permuted block tables.  DataFrame functions only.

The weighted terms of a text (pairs of neighbouring words, the word itself where there is one only; longer terms weigh more) are
hashed to 64 bits; each bit of the fingerprint is the sign of the weighted votes of its terms.  Votes are sums of longs that hold two
32-bit lanes, so a document is one row of 32 sums while its terms stream by.  The likeness of two fingerprints is the cosine of the angle
their differing bits stand for, at least 0.

Neighbours in id order: rows of equal doc_id and text are combined, with a count; the others are sorted into ranges by doc_id and a
hash of the text, so that many rows of one id, or without, are several ranges, and written as a table bucketed by range.  Windows, terms
and votes then work range by range without another shuffle of texts; the last row of a range is joined with the first of the next.

The search: bits are cut into blocks, and for each choice of two blocks a table is keyed by their bits, so that all fingerprints within
the radius of a query's share one of its keys.  Queries are the rows whose doc_id is divisible by 20, against all rows.

Defined results: null or empty text has no terms and fingerprint 0; one document is its own next; rows are ordered by doc_id (null
first), then by a hash of the text; repeated rows follow one another; texts of any length are taken whole; extra columns are ignored; an
empty table gives an empty one.  `within` ignores null fingerprints and queries, and takes equal ones once.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import bucketed, discard, materialize, partitions

LANES = 0x0000000100000001


def with_terms(texts: DataFrame) -> DataFrame:
    """Rows with a column text become rows of one term each, with its hash h and weight w; a text without terms keeps one row, of
    nulls.  Neighbours are paired by zipping the words with themselves moved by one, so that everything after the split is compiled."""
    keep = [c for c in texts.columns if c != "text"]
    words = texts.select(*keep, F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+").alias("words"))
    moved = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(1)))
    pairs = words.select(*keep, F.size("words").alias("n"), F.explode(F.arrays_zip(F.col("words").alias("a"), moved.alias("b"))).alias("p")).select(*keep, "n", "p.a", "p.b")
    term = F.when((F.col("a") != "") & (F.col("b").isNotNull() | (F.col("n") == 1)), True)
    weight = F.least(F.lit(4), 1 + F.floor((F.octet_length("a") + F.coalesce(F.octet_length("b"), F.lit(0))) / 8)).cast("long")
    return pairs.select(*keep, F.when(term, F.xxhash64("a", "b")).alias("h"), F.when(term, weight).alias("w"))


def vote_sums() -> list[Column]:
    """Aggregates over rows with columns h and w: the lanes of all bits, and the weight of all terms."""
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{i}") for i in range(32)]
    return [*lanes, F.sum("w").alias("w")]


def signs() -> Column:
    """The fingerprint, from the columns of vote_sums()."""
    out = F.lit(0).cast("long")
    for bit in range(64):
        lane = F.col(f"v{bit % 32}")
        votes = F.shiftrightunsigned(lane, 32) if bit >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        out = out.bitwiseOR(F.when(2 * votes > F.col("w"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / 64) * F.bit_count(F.col(a).bitwiseXOR(F.col(b)))))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def in_order(documents: DataFrame) -> DataFrame:
    """Rows of equal doc_id and text once, with their number (copies) and the text that follows the last of them (next), in ranges
    (part) of the order."""
    n = partitions(documents.sparkSession)
    known, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = documents.select(known.alias("doc_id"), text.alias("text"), F.coalesce(known, F.lit(-(1 << 63))).alias("id"), F.xxhash64(known.isNull(), text).alias("tie"))
    single = rows.groupBy("id", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    single = materialize(single, "single")
    sorted_ = single.repartitionByRange(n, "id", "tie").select(F.spark_partition_id().alias("part"), "*")
    docs = bucketed(sorted_, "in_order", "part")
    discard(single)
    # one row for each range, without texts
    order = Window.orderBy("part")
    after = docs.select("part").distinct().select("part", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("before"))
    first = docs.groupBy("part").agg(F.min_by("text", F.struct("id", "tie")).alias("head"))  # where they lie: one row for each range
    heads = first.join(after, "part").select(F.col("before").alias("part"), "head")
    own = Window.partitionBy("part").orderBy("id", "tie")
    placed = docs.withColumns({"next": F.lead("text").over(own), "row": F.row_number().over(own), "final": F.row_number().over(Window.partitionBy("part").orderBy(F.desc("id"), F.desc("tie"))) == 1})
    return placed.join(heads, "part", "left").withColumn("next", F.when(F.col("final"), F.col("head")).otherwise(F.col("next"))).drop("head")


def fingerprint_edits(documents: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per document; its edit has
    the last quarter of its code points replaced by the first of the next document's.  near_docs: for doc_ids divisible by 20, how
    many rows (this one included) have a fingerprint within `radius` bits of its own; else null."""
    chars = F.length("text")
    quarter = F.floor(chars / 4).cast("int")
    # all but the last of repeated rows are followed by their own text
    turns = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(1).cast("long").alias("times"), F.col("next").alias("next")), F.struct((F.col("copies") - 1).alias("times"), F.col("text").alias("next")))).otherwise(F.array(F.struct(F.lit(1).cast("long").alias("times"), F.col("next").alias("next"))))
    turned = in_order(documents).select("part", "row", "id", "doc_id", "text", F.posexplode(turns).alias("turn", "t"))
    edit = F.concat(F.substring("text", F.lit(1), chars - quarter), F.substring("t.next", F.lit(1), quarter))
    edited = turned.select("part", "row", "turn", "doc_id", "t.times", chars.cast("long").alias("n_chars"), "text", edit.alias("edited"))
    key = ["part", "row", "turn", "doc_id", "times", "n_chars", "edited_sha256"]
    sides = edited.withColumn("edited_sha256", F.sha2("edited", 256)).select(*key, F.posexplode(F.array("text", "edited")).alias("side", "text")).where("turn = 0 or side = 1")
    prints = with_terms(sides).groupBy(*key, "side").agg(*vote_sums()).select(*key, "side", signs().alias("fp"))
    both = prints.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    done = materialize(both, "prints")
    rows = done.where("turn = 0").select("part", "row", "fp")
    firsts = rows.where("row = 1").select("part", F.col("fp").alias("first_fp"))
    order = Window.orderBy("part")
    firsts = firsts.select(F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("part"), "first_fp")
    follow = rows.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("part").orderBy("row"))).join(firsts, "part")
    follow = follow.select("part", "row", F.col("fp").alias("own_fp"), F.coalesce("next_fp", "first_fp").alias("next_fp"))
    full = done.drop("fp").join(follow, ["part", "row"]).withColumn("next_fp", F.when(F.col("turn") == 0, F.col("next_fp")).otherwise(F.col("own_fp")))
    asked = full.where("doc_id % 20 = 0").select(F.col("own_fp").alias("query"))
    number = full.groupBy(F.col("own_fp").alias("fp")).agg(F.sum("times").alias("times"))
    near = within(number, asked, radius).join(number, "fp").groupBy(F.col("query").alias("own_fp")).agg(F.sum("times").alias("near_docs"))
    near = materialize(near, "near")
    out = full.join(near, "own_fp", "left").withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    return out.select("doc_id", "n_chars", "edited_sha256", hexadecimal("own_fp").alias("fingerprint"), hexadecimal("edited_fp").alias("edited_fingerprint"), likeness("own_fp", "edited_fp").alias("near_edited"), likeness("own_fp", "next_fp").alias("near_next"), F.when(F.col("doc_id") % 20 == 0, F.col("near_docs")).alias("near_docs"))


def within(fingerprints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """query, fp, distance: all fingerprints (column fp, long) within `radius` bits of a query's (column query), by permuted block
    tables: the bits are cut into radius + 2 blocks, any two fingerprints that near agree on two of them at least, and each pair of
    blocks keys one table."""
    m = radius + 2
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [x - (1 << 64) if x >> 63 else x for x in (a | b for a, b in combinations(blocks, 2))]

    def tables(frame: DataFrame, name: str) -> DataFrame:
        keyed = F.array(*(F.struct(F.lit(i).alias("table"), F.col(name).bitwiseAND(F.lit(x).cast("long")).alias("key")) for i, x in enumerate(masks)))
        return frame.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(keyed).alias("k")).select(name, "k.table", "k.key")

    near = tables(queries, "query").join(tables(fingerprints, "fp"), ["table", "key"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return near.select("query", "fp", distance.alias("distance")).where(F.col("distance") <= radius).distinct()
