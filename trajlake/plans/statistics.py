"""Statistics by dimension, normalisation, outliers, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.schedules import logit_loss
from trajlake.functions.vectors import clip, denormalise, normalise, rounded
from trajlake.operators import histograms
from trajlake.operators import statistics as st
from trajlake.operators.lineage import scratch
from trajlake.plans.registry import query
from trajlake.sources import table
from trajlake.streaming.statistics import keep_statistics, statistics

VALUES = "(select vec_id, label, unnest(range(len(embedding))) as dim, unnest(embedding)::double as x from embeddings)"
RANGES = f"(select dim, min(x) as low, max(x) as high from {VALUES} group by dim)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.by_dimension(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    return values.join(F.broadcast(st.spread(values, "dim").drop("n")), "dim")  # a row for each of a vector's dimensions


@query(f"select vec_id, dim, round((x - low) / case when high = low then 1 else high - low end, 6) as y from {VALUES} join {RANGES} using (dim)")
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).select("vec_id", "dim", rounded(normalise(F.col("x"), F.col("low"), F.col("high"))).alias("y"))


@query(f"select dim, round(max(abs(x - ((x - low) / case when high = low then 1 else high - low end * (high - low) + low))), 6) as worst from {VALUES} join {RANGES} using (dim) group by dim")
def denormalize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    back = denormalise(normalise(F.col("x"), low, high), low, high)
    return _ranged(spark, sf_dir).groupBy("dim").agg(rounded(F.max(F.abs(F.col("x") - back))).alias("worst"))


BINS = 256
_QUANTILES = f"""(with r as (select dim, min(x) as low, max(x) as high, count(*) as total from {VALUES} group by dim),
b as (select dim, low, high, total, least(greatest(floor((x - low) * ({BINS - 1} / greatest(high - low, 1e-12))), 0), {BINS - 1}) as bin from {VALUES} join r using (dim)),
k as (select dim, low, high, total, bin, count(*) as k from b group by all),
c as (select *, sum(k) over (partition by dim order by bin rows unbounded preceding) as upto from k),
f as (select dim, low - 1e-12 as low, high + 1e-12 as high, min(case when upto >= total * 0.01::double then bin end) as b0, min(case when upto >= total * 0.99::double then bin end) as b1 from c group by dim, low, high)
select dim, low + b0 * ((high - low) / {BINS}) as q01, low + b1 * ((high - low) / {BINS}) as q99 from f)"""


@query(f"select dim, round(q01, 6) as q01, round(q99, 6) as q99 from {_QUANTILES}")
def stats_hist_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.histogram_quantiles(_values(spark, sf_dir), [0.01, 0.99], BINS)
    return found.select("dim", rounded(F.col("q01")).alias("q01"), rounded(F.col("q99")).alias("q99"))


@query(f"select vec_id, dim, round((least(greatest(x, q01), q99) - q01) / case when q99 = q01 then 1 else q99 - q01 end, 6) as y from {VALUES} join {_QUANTILES} using (dim)")
def normalize_quantile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    low, high = F.col("q01"), F.col("q99")
    joined = values.join(F.broadcast(st.histogram_quantiles(values, [0.01, 0.99], BINS)), "dim")
    return joined.select("vec_id", "dim", rounded(normalise(clip(F.col("x"), low, high), low, high)).alias("y"))


@query(f"select label, dim, min(x) as low, max(x) as high, count(*) as n from {VALUES} group by grouping sets ((label, dim), (dim))")
def stats_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By task and dimension, and over all tasks (label null), from one pass."""
    values = _values(spark, sf_dir)
    return values.groupingSets([["label", "dim"], ["dim"]], "label", "dim").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))


_MOMENTS = f"select dim, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from {VALUES} group by dim"


def _rounded_moments(found: DataFrame, *more: str) -> DataFrame:
    return found.select("dim", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), *more)


@query(_MOMENTS)
def stats_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_moments(st.moments(_values(spark, sf_dir), "dim"))


@query(_MOMENTS)
def stats_merge_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From partials by task."""
    return _rounded_moments(st.merged_moments(st.partial_moments(_values(spark, sf_dir), "label", "dim"), "dim"))


@query(f"select dim, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, min(x) as low, max(x) as high from {VALUES} group by dim")
def stats_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From partials of files that came one after another, each read once."""
    files, kept, check = (scratch(spark, n) for n in ("files", "partials", "checkpoint"))
    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").repartition(6, "vec_id").write.parquet(files)
    stream = spark.readStream.schema("vec_id long, label int, embedding array<float>").option("maxFilesPerTrigger", 2).parquet(files)
    keep_statistics(stream, lambda batch: st.by_dimension(batch, "embedding", "file"), kept, check, "dim").awaitTermination()
    return _rounded_moments(statistics(spark, kept, "dim"), "low", "high")


_LEVELS = 64


@query(f"""with r as (select dim, min(x) as lo, max(x) as hi, count(*) as n from {VALUES} group by dim),
v as (select dim, n, min(e) as level from (select *, unnest(range(-40, 41)) as e from r) where floor(hi / pow(2.0::double, e)) - floor(lo / pow(2.0::double, e)) < {_LEVELS} group by dim, n),
b as (select dim, n, pow(2.0::double, level) as width, floor(x / pow(2.0::double, level)) as bin, count(*) as k from {VALUES} join v using (dim) group by all),
c as (select *, sum(k) over (partition by dim order by bin rows unbounded preceding) as upto from b)
select dim, width, min(bin) filter (upto >= n * 0.01::double) * width as q01, min(bin) filter (upto >= n * 0.5::double) * width as q50, min(bin) filter (upto >= n * 0.99::double) * width as q99 from c group by dim, width""")
def stats_doubling_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one pass over the values, with bins that double where the range grows; partials of two halves are merged."""
    vectors = table(spark, sf_dir, "embeddings").select("embedding", F.coalesce(F.col("label") < 5, F.lit(False)).alias("low"))
    halves = [histograms.partial_histograms(vectors.where(some), "embedding", _LEVELS) for some in ("low", "not low")]
    found = histograms.quantiles(histograms.merged_histograms(halves[0].unionByName(halves[1]), _LEVELS), [0.01, 0.5, 0.99])
    return found.withColumnRenamed("group", "dim")


@query(f"""select label, max(abs(x)) as max_abs, count(distinct case when abs(x) > 0.45 then dim end) as n_dims,
coalesce(array_to_string(list_sort(list_distinct(list(dim) filter (where abs(x) > 0.45))), ','), '') as dims from {VALUES} group by label""")
def stats_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.beyond(_values(spark, sf_dir), 0.45, "label")


@query(f"""select vec_id, max(abs(x)) as max_abs, max(abs(x)) <= 0.45 as valid from {VALUES} group by vec_id""")
def trajectory_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without exploding: each vector is judged where it is."""
    from trajlake.functions.vectors import within_bounds

    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", F.array_max(F.transform("x", lambda v: F.abs(v))).alias("max_abs"), within_bounds(F.array("x"), 0.45).alias("valid"))


@query("""with c as (select l_orderkey, unnest(['quantity', 'price', 'discount', 'tax']) as channel, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as x from lineitem)
select l_orderkey, channel, count(*) as n, min(x) as low, max(x) as high, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from c group by 1, 2""")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels are aggregated in one row for each order; only these rows become four."""
    channels = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    statistics = {"low": F.min, "high": F.max, "mean": F.avg, "std": F.stddev_pop}
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{s}") for name, c in channels.items() for s, f in statistics.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("channel"), *((rounded(F.col(f"{name}_{s}")) if s in ("mean", "std") else F.col(f"{name}_{s}")).alias(s) for s in statistics)) for name in channels))
    return wide.select("l_orderkey", "n", F.inline(rows)).select("l_orderkey", "channel", "n", *statistics)


@query("""select l.toxic, count(*) as n, round(avg(greatest(z, 0) - z * l.quality + ln(1 + exp(-abs(z)))), 6) as loss
from (select vec_id, 8.0::double * unnest(embedding) as z from embeddings) e join labels l on l.doc_id = e.vec_id group by l.toxic""")
def bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a vector is a logit of its document's label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = table(spark, sf_dir, "labels").join(vectors, "doc_id").select("toxic", "quality", F.explode("embedding").alias("x")).withColumn("z", 8.0 * F.col("x").cast("double"))
    return joined.groupBy("toxic").agg(F.count("*").alias("n"), rounded(F.avg(logit_loss(F.col("z"), F.col("quality")))).alias("loss"))


@query("select lang, count(*) as n, count(l.doc_id) as labelled, floor(100.0 * count(l.doc_id) / count(*))::bigint as percent from documents d left join labels l using (doc_id) group by lang")
def coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    found = docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("labelled"))
    return found.withColumn("percent", F.floor(100 * F.col("labelled") / F.col("n")).cast("long"))


@query("""select l_shipdate_year, l_returnflag, n from (select year(l_shipdate) as l_shipdate_year, l_returnflag, count(*) as n,
row_number() over (order by year(l_shipdate), l_returnflag) as k from lineitem group by 1, 2) where k <= 10""")
def report_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten groups of a report."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("l_shipdate_year"), "l_returnflag").agg(F.count("*").alias("n"))
    return counts.orderBy("l_shipdate_year", "l_returnflag").limit(10)


@query("""select d.doc_id // 32 as batch_id, count(*) as n, bool_and(l.quality is not null) as all_labelled, bool_or(l.quality is not null) as any_labelled,
bool_and(d.n_chars > 100) as all_long, bool_or(d.n_chars > 100) as any_long from documents d left join labels l using (doc_id) group by 1""")
def batch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.operators.batches import flags

    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return flags(rows, F.floor(F.col("doc_id") / 32).cast("long"), labelled=F.col("quality").isNotNull(), long=F.col("n_chars") > 100)
